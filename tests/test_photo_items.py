"""Items of small photos come from one row per photo; they are those that joins make."""

from __future__ import annotations

from collections import Counter

import pytest

from boxtally.operators import matching, results
from boxtally.plans.catalog import REGISTRY
import boxtally.plans.result_queries  # noqa: F401

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[-1].count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated labels and readings, photos without a size, without labels, with failed states and unknown ones."""
    def box(x, y, w=100, h=50):
        return (x, y, x + w, y + h)

    labels, dets = [], []
    for i in range(1, 12):
        for k in range(4):
            x = 220 * k
            labels.append((i, None if (i, k) == (2, 3) else k, ["clear", None][k % 2], "high", box(x, 0, 210, 200), None if k % 2 else box(x + 10, 20, 190, 100)))
            dets.append((i, None if (i, k) == (3, 2) else k, None if (i, k) == (4, 1) else f"v{k}", "QRCode", box(x + 50 + 90 * (i % 3), 40)))
    labels += [labels[0], (7, 1, "blurred", "low", box(220, 0, 210, 200), None), (99, 0, "clear", "high", box(0, 0), None),
               (None, 0, "clear", "high", box(0, 0), None)]
    dets += [dets[0], (7, 1, "again", None, box(600, 40)), (12, 5, "alone", "QRCode", box(0, 0)), (None, 1, "lost", "QRCode", box(0, 0))]
    images = [(i, None if i == 5 else 3000, 4000, {6: "error", 8: None}.get(i, "ok"), {9: "error", 10: None}.get(i, "ok")) for i in range(1, 13)]
    return (spark.createDataFrame(labels, f"image_id long, label_index long, status string, confidence string, label_box {BOX}, barcode_box {BOX}"),
            spark.createDataFrame(dets, f"image_id long, det_index long, value string, format string, box {BOX}"),
            spark.createDataFrame(images, "image_id long, image_width int, image_height int, scan_state string, audit_state string"))


def by_joins(labels, dets, images):
    usable = results.usable_inputs(labels, dets, images)
    return results.assemble_items(*usable, matching.match_labels(*usable, images))


@pytest.mark.parametrize("limit", [512, 9])
def test_items_in_a_row_are_those_of_joins(spark, odd, limit):
    items, joined = results.photo_items(*odd, limit=limit).rows(), by_joins(*odd)
    want = Counter(joined.collect())
    assert {r.kind for r in want} == {"found", "missing", "unassigned"} and items.columns == joined.columns
    assert Counter(items.collect()) == want


def test_items_take_one_shuffle(spark, sf_dir):
    assert shuffles(REGISTRY["assemble_items"].run(spark, sf_dir)) == 1


def test_nested_items_and_replies_in_a_row_are_those_of_rows(spark, odd):
    """Blocks of a small photo are cut, and its lines numbered, as windows over item rows do it."""
    items = results.photo_items(*odd, limit=9)
    assert items.many is not None
    few = results.PhotoItems(items.few, None)
    rows = few.rows().localCheckpoint()
    for got, want in ((results.nest_photos(few, 3), results.nest_items(rows, 3)), (results.reply_photos(few), results.reply_lines(rows)),
                      (results.explode_items(results.nest_photos(few, 3)), results.explode_items(results.nest_items(rows, 3)))):
        assert got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["explode_items", "reply_lines"])
def test_nested_items_and_replies_take_one_shuffle(spark, sf_dir, name):
    assert shuffles(REGISTRY[name].run(spark, sf_dir)) == 1
