"""One reading per printed code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions import arrays
from boxtally.functions import geometry as g
from boxtally.operators.greedy import FOLD_LIMIT, ordered_greedy

#: readings of different values this near each other are one misread code
MISREAD_TOLERANCE = 15


def same_reading(a: Column, b: Column) -> Column:
    same_value = (a["value"] == b["value"]) & g.same_physical(a["box"], b["box"])
    misread = (a["value"] != b["value"]) & g.centers_within(a["box"], b["box"], MISREAD_TOLERANCE)
    return (a["format"] == b["format"]) & (same_value | misread)


def reading_reach(row: Column) -> Column:
    """Two readings of one code have centres within 40 pixels, or within 0.35 of the longest side of either, or
    share an area once grown by 20; in each case the regions below share a point."""
    b = row["box"]
    grow = F.greatest(F.lit(20), F.ceil(F.greatest(g.width(b), g.height(b)) * F.lit(0.35))).cast("int")
    return g.pad(b, grow, grow)


def dedup_detections(detections: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame:
    """Keep the largest reading of each printed code of an image.

    Order: area descending, then input order (``ord``). A later reading is never
    larger than a kept one, so whichever value is more plausible, the later one
    goes. Identical readings collapse first: whatever decides one of them
    decides them all.
    """
    def collapse(rows: DataFrame) -> DataFrame:
        return rows.groupBy("image_id", "value", "format", "box").agg(F.min("ord").alias("ord"))

    order = {"area": -g.area(F.col("box")), "ord": F.col("ord")}
    return ordered_greedy(detections, "image_id", order, same_reading, reach=reading_reach, within=["format"],
                          test=lambda a, b: arrays.same_reading(a, b, MISREAD_TOLERANCE), fields=["value", "format", "box"],
                          alike=["value", "format", "box"], prepare=collapse, limit=limit)


def reading_order(df: DataFrame, box: str = "box") -> DataFrame:
    """Top to bottom, then left to right within each image; equal corners by ``det_index``.

    Rows of an image are together and in order; images are in no order among themselves, so nothing is
    sorted across the table.
    """
    return df.repartition("image_id").sortWithinPartitions("image_id", f"{box}.y1", f"{box}.x1", "det_index")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of every key.

    ``row_number() = 1`` is limited inside each task before the shuffle, so a
    key with very many rows sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")
