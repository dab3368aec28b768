"""Positions and blocks of ordered rows inside groups of any size.

A nested result is one row per group and block. Block ``k`` holds the rows at the places ``k * block`` up to the
next block, in order, so a reader knows where a row stands and no array grows with its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxtally.session import broadcast_if_small, cut_lineage, deal, tasks

BLOCK = 512
#: starts of ranges (a key and two numbers) that are broadcast to the rows; more are joined by shuffle
SMALL = 1_000_000


def in_blocks(rows: DataFrame, key: str, order: list[str], block: int = BLOCK, whole: int = BLOCK) -> DataFrame:
    """Add ``place`` (from 0 within the group, in ``order``) and ``block``.

    Groups of up to ``whole`` rows, or one block, are numbered by a window, on one shuffle that the reader's grouping
    by key and block shares. Larger ones are dealt to tasks by ranges of the order, sorted and written with their
    number in the task, and shifted by the sizes of the ranges before; no task sees a whole group.
    """
    whole = max(block, whole)
    rows = cut_lineage(rows)
    total, spark = rows.count(), rows.sparkSession
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > whole).select(key)
    small = deal(rows, total, key).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    large, spread = cut_lineage(large), None
    if not large.isEmpty():
        small = deal(rows.join(large, key, "left_anti"), total, key).withColumn(
            "place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
        # Written, so that a range has the same rows when it is counted and when it is numbered.
        ranged = cut_lineage(rows.join(large, key, "left_semi").repartitionByRange(tasks(spark, total), key, *order).sortWithinPartitions(
            key, *order).withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
        sizes = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
        before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(key, "_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
        # A group meets few ranges, so its starts are few against its rows.
        spread = ranged.join(broadcast_if_small(cut_lineage(starts), SMALL), [key, "_range"]).withColumn("place", F.col("_id") + F.col("_start"))
        small = small.unionByName(spread.select(*rows.columns, "place"))
    place = F.col("place").cast("long")
    placed = small.withColumns({"place": place, "block": F.floor(place / block)})
    return placed if spread is None else deal(placed, total, key, "block")
