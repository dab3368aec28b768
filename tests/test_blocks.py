"""Numbering in blocks: the window and the ranges give the same places, and short groups move once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from boxtally.operators import tables
from boxtally.operators.blocks import in_blocks


@pytest.mark.parametrize("whole", [1, 4, 512])
def test_places_by_window_and_by_ranges(spark, whole):
    rows = [(f"k{i % 7}", i * 37 % 101) for i in range(90)] + [("long", i) for i in range(60)] + [("one", 1)]
    got = in_blocks(spark.createDataFrame(rows, "k string, v int"), "k", ["v"], 3, whole).collect()
    want = {}
    for k in {k for k, _ in rows}:
        for place, v in enumerate(sorted(v for q, v in rows if q == k)):
            want[k, v] = (place, place // 3)
    assert len(got) == len(rows) and {(r.k, r.v): (r.place, r.block) for r in got} == want


def test_sessions_of_some_blocks_move_once(spark):
    """A session of more lines than a block is no reason to deal its lines by ranges."""
    items = spark.range(400).select(F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("session_id"), F.col("id").alias("line_id"),
                                    F.lit("c").alias("barcode_value"), F.lit(1).alias("label_index"), F.lit(0).alias("source_image"))
    missing = items.drop("barcode_value").withColumn("resolved", F.lit(False)).limit(0)
    sessions = spark.range(41).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("active").alias("status"))
    nested = tables.session_result(sessions, items, missing, block=3)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(session_id") <= 2 and "block" not in "".join(
        line for line in initial.splitlines() if "Exchange" in line)
    assert sorted((r.session_id, r.block, len(r["items"] or [])) for r in nested.collect()) == sorted(
        [(f"s{s}", b, n) for s in range(40) for b, n in ((0, 3), (1, 3), (2, 3), (3, 1))] + [("s40", 0, 0)])
