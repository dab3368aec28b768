"""Ranking of regions that may be labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions import arrays
from boxtally.functions import geometry as g
from boxtally.operators.greedy import FOLD_LIMIT, ordered_greedy

TOP_PROPOSALS = 24
PADDING_RATIO = 0.12


def overlaps(a: Column, b: Column) -> Column:
    x, y = a["box"], b["box"]
    return (g.iou(x, y) >= 0.35) | (g.containment(x, y) >= 0.75) | (g.containment(y, x) >= 0.75)


def suppress_overlaps(scored: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame:
    """Keep the best-scored of overlapping boxes; equal scores keep input order."""
    return _suppress(scored, lambda df: df, limit)


def _suppress(rows: DataFrame, prepare, limit: int = FOLD_LIMIT) -> DataFrame:
    order = {"score": -F.col("score"), "ord": F.col("proposal_id")}
    return ordered_greedy(rows, "image_id", order, overlaps, reach=lambda row: row["box"],
                          test=arrays.overlaps, fields=["box"], prepare=prepare, limit=limit)


def clear_proposals(proposals: DataFrame, images: DataFrame) -> DataFrame:
    """Score the regions that may be labels and suppress the overlapping ones."""
    return _suppress(proposals, lambda rows: score_proposals(rows, images).select(
        "image_id", "proposal_id", "box", "score"))


def score_proposals(proposals: DataFrame, images: DataFrame) -> DataFrame:
    """Drop regions that cannot be labels and score the others."""
    box = F.col("box")
    w, h = g.width(box), g.height(box)
    image_area = F.col("image_width").cast("long") * F.col("image_height")
    size = w.cast("long") * h
    short, long_ = F.least(w, h), F.greatest(w, h)
    aspect = long_ / F.greatest(F.lit(1), short)
    shorter_side = F.least("image_width", "image_height")
    fits = (
        size.between(image_area * F.lit(0.003), image_area * F.lit(0.10))
        & (short >= F.greatest(F.lit(35), F.rint(shorter_side * F.lit(0.035))))
        & aspect.between(1.05, 4.5)
        & (F.col("rectangularity") >= 0.35) & (F.col("white_ratio") >= 0.32))
    score = F.col("rectangularity") * 2 + F.col("white_ratio") + F.least(
        size / image_area / F.lit(0.02), F.lit(1.5))
    sized = proposals.join(images.select("image_id", "image_width", "image_height"), "image_id")
    return sized.filter(fits).select("image_id", "proposal_id", "box", score.alias("score"),
                                     "image_width", "image_height")


def top_proposals(kept: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` best per image, where the scan cannot afford a decode of each; all by default."""
    if k is None:
        return kept
    best = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "proposal_id")
    return kept.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def rank_label_proposals(proposals: DataFrame, images: DataFrame, k: int | None = None) -> DataFrame:
    """Filter, score, suppress, cut to ``k`` if given, pad, number in reading order."""
    kept = top_proposals(clear_proposals(proposals, images), k).join(
        images.select("image_id", "image_width", "image_height"), "image_id")
    padded = kept.select("image_id", "proposal_id", "score", g.pad_ratio(
        F.col("box"), PADDING_RATIO, F.col("image_width"), F.col("image_height")).alias("box"))
    reading = Window.partitionBy("image_id").orderBy("box.y1", "box.x1", F.col("score").desc(), "proposal_id")
    return padded.withColumn("read_no", F.row_number().over(reading))
