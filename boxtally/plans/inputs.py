"""Derived tables in the shape the operators take (boxes as structs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.functions.geometry import box
from boxtally.plans.fixtures import build
from boxtally.session import cut_lineage


def images(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, d, "images")


def labels(spark: SparkSession, d: str) -> DataFrame:
    t = build(spark, d, "label_boxes")
    return t.select("image_id", "label_index", "status", "confidence",
                    box("lx1", "ly1", "lx2", "ly2").alias("label_box"),
                    F.when(F.col("bx1").isNotNull(), box("bx1", "by1", "bx2", "by2")).alias("barcode_box"))


def _readings(t: DataFrame, *ids: str) -> DataFrame:
    return t.select("image_id", *ids, "value", "format", box("x1", "y1", "x2", "y2").alias("box"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    return _readings(build(spark, d, "detection_boxes"), "det_index")


def recovery_detections(spark: SparkSession, d: str) -> DataFrame:
    return _readings(build(spark, d, "recovery_detections"), "det_index")


def raw_detections(spark: SparkSession, d: str) -> DataFrame:
    return _readings(build(spark, d, "raw_detections"), "ord")


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Written once: the conditions on a region would otherwise be unfolded into
    the formulas that derive it, over and over, in the filter of the scan."""
    t = build(spark, d, "proposals")
    return cut_lineage(t.select(
        "image_id", "proposal_id", box("x1", "y1", "x2", "y2").alias("box"), "rectangularity", "white_ratio"))


def flat(df: DataFrame, column: str = "box", prefix: str = "") -> DataFrame:
    """Replace a box column by its four coordinates."""
    b = F.col(column)
    parts = [b[c].alias(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")]
    return df.select(*[c for c in df.columns if c != column], *parts)
