"""Two-phase export: stopped anywhere and run again, nothing is lost or doubled."""

from __future__ import annotations

import pytest

from boxtally.operators import review
from boxtally.session import scratch_path
from boxtally.sources.change_log import LoggedTable
from boxtally.sources.export import BOXES, IMAGES, GroundTruthStore

QUEUE = """id string, run_id string, image_ref string, reviewed_us long, added_to_dataset boolean,
    expected_barcodes array<struct<value:string,format:string>>"""


@pytest.mark.parametrize("stop_at", [None, "images", "queue"])
def test_export_can_be_repeated(spark, monkeypatch, stop_at):
    def table(name, schema, key):
        return LoggedTable(spark, scratch_path(spark, name), schema, key, buckets=2)

    store = GroundTruthStore(table("images", IMAGES, ["image"]), table("boxes", BOXES, ["image", "box_no"]))
    store.images.create(spark.createDataFrame([("old.jpg", "manual", None, 3, 2)], IMAGES))
    queue = table("queue", QUEUE, ["id"])
    queue.create(spark.createDataFrame([
        ("a", "1", "/u/1.png", 5, False, [("72", None), (None, "QR")]), ("b", "2", "/u/2", 5, False, []), ("c", "3", "/u/3.jpg", None, False, None),
        ("d", "4", None, 5, False, [("1", "x")]), ("e", "5", "/gone/5.jpg", 5, False, [("1", "x")]), ("f", "6", "/u/6.jpg", 5, True, [("1", "x")])], QUEUE))
    inventory = spark.createDataFrame([("/u/1.png",), ("/u/2",), ("/u/3.jpg",), ("/u/6.jpg",)], "path string")

    def run():
        return store.export(queue, review.reviewed_codes(queue.read()), inventory).first()

    if stop_at:
        broken = {"images": (store.images, "put"), "queue": (queue, "update")}[stop_at]
        with monkeypatch.context() as m:
            m.setattr(*broken, lambda *a: (_ for _ in ()).throw(RuntimeError("down")))
            with pytest.raises(RuntimeError):
                run()
        assert not queue.read().where("added_to_dataset and id <> 'f'").count()
    for _ in range(2):
        assert tuple(run()) == (3, 5, 4)
        assert {r.id for r in queue.read().where("added_to_dataset").collect()} == {"a", "b", "f"}
        assert {(r.image, r.box_no, r.status, r.value, r.format) for r in store.boxes.read().collect()} == {
            ("annotation_1.png", 1, "decoded", "72", "Code128"), ("annotation_1.png", 2, "decoded", "", "QR")}
        assert {tuple(r) for r in store.images.read().collect()} == {
            ("old.jpg", "manual", None, 3, 2), ("annotation_1.png", "annotation", "1", 2, 2), ("annotation_2.jpg", "annotation", "2", 0, 0)}
