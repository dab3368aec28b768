"""Ground-truth documents and image inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.functions.messages import sniff_image_type
from boxtally.schemas import GROUND_TRUTH

# Media type by file name.
SUFFIX_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
                ".webp": "image/webp", ".heic": "image/heic"}


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per image of the documents at ``path``."""
    docs = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
    return examples(docs)


def examples(docs: DataFrame) -> DataFrame:
    """Expected values and counts per image; only decoded boxes are expected."""
    rows = docs.select(F.explode("images").alias("i"))
    decoded = F.filter("i.boxes", lambda b: b["status"] == "decoded")
    filled = F.filter("decoded", lambda b: F.coalesce(b["value"], F.lit("")) != "")
    values = F.transform(filled, lambda b: b["value"])
    out = rows.withColumn("decoded", decoded).select(
        F.col("i.image").alias("image"),
        F.col("i.expected_barcode_symbol_count").alias("expected_barcode_symbol_count"),
        F.size("decoded").alias("expected_decoded_count"), values.alias("expected_values"),
        F.lit("complete").alias("expected_outcome"))
    unique = F.array_sort(F.array_distinct("expected_values"))
    return out.withColumn("expected_unique_values", unique).withColumn(
        "expected_unique_count", F.size("expected_unique_values"))


def image_inventory(spark: SparkSession, path: str, *, sniff: bool = False) -> DataFrame:
    """Files below ``path`` with size and media type.

    By name alone no file is opened. ``sniff`` judges files whose name says nothing by their first bytes; the
    source then reads every file whole, so it is for folders of uploads, not for large stores.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_TYPES.items() for x in pair])
    named = F.try_element_at(table, suffix)
    kind = F.coalesce(named, sniff_image_type(F.col("content"))) if sniff else named
    return files.select("path", "length", "modificationTime", kind.alias("media_type"))
