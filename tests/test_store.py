"""Tables, queue, ground truth, chat and sinks on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from boxtally.functions import geometry as g
from boxtally.functions import messages as msg
from boxtally.functions import outcome as o
from boxtally.functions import text
from boxtally.operators import chat, evaluate, quality, results, review, tables
from boxtally.schemas import EVENT_TYPES
from boxtally.sources.ground_truth import ground_truth, image_inventory
from boxtally.sources.streams import event_stream
from boxtally.sources.tables import append_table, read_queue, read_table, runs_since, write_table
from boxtally.streaming import flows
from boxtally.streaming.runner import drain_each

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- geometry ----------------------------------------------------------------

def test_geometry_values(spark):
    df = spark.createDataFrame([((0, 0, 100, 200), (10, 10, 100, 100))], f"a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    r = one(df.select(
        g.center_x(a).alias("cx"), g.center_y(a).alias("cy"),
        g.pad(F.struct(*[F.lit(v).alias(n) for v, n in zip((100, 100, 200, 200), ("x1", "y1", "x2", "y2"))]),
              F.lit(10), F.lit(20)).alias("p"),
        g.normalized_to_pixels(F.lit(250), F.lit(500), F.lit(750), F.lit(1000), F.lit(1000), F.lit(1000)).alias("n"),
        g.normalized_distance(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0), F.lit(1000), F.lit(4000)).alias("d"),
        g.contains_point(b, F.lit(100), F.lit(10)).alias("edge"), g.contains_point(b, F.lit(101), F.lit(10)).alias("out"),
        g.iou(a, a).alias("same"), g.containment(b, a).alias("inside")))
    assert (r.cx, r.cy) == (50.0, 100.0)
    assert tuple(r.p) == (90, 80, 210, 220) and tuple(r.n) == (500, 250, 1000, 750)
    assert r.d == pytest.approx((0.1 ** 2 + 0.025 ** 2) ** 0.5)
    assert r.edge and not r.out and r.same == 1.0 and r.inside == 1.0


def test_image_without_size_is_an_error(spark):
    df = spark.createDataFrame([(0,)], "w int")
    with pytest.raises(Exception, match="image size must be positive"):
        df.select(g.normalized_to_pixels(*[F.lit(1)] * 4, F.col("w"), F.lit(10))).collect()


def test_geometry_stays_small_and_generated(spark):
    df = spark.range(1).select(*[F.col("id").cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")])
    b = g.pad_ratio(g.clamp(g.pad(g.box("x1", "y1", "x2", "y2"), F.lit(5), F.lit(5)), F.lit(9), F.lit(9)), 0.1, F.lit(9), F.lit(9))
    plan = df.select(b.alias("b"))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 6000 and "CASE WHEN" not in plan


# --- outcome -----------------------------------------------------------------

def issues(spark, variant, **kw):
    base = dict(ok=True, outcome="needs_better_photo", audit=True, missing=1, scanner=5, vision=6, attempted=True,
                tried=1, resolved=0, decoded=0, code=None, text=None) | kw
    df = spark.createDataFrame([tuple(base.values())], "ok boolean, outcome string, audit boolean, missing int, scanner int, "
                               "vision int, attempted boolean, tried int, resolved int, decoded int, code string, text string")
    c = F.col
    i = o.derive_issues(ok=c("ok"), outcome_=c("outcome"), audit_ok=c("audit"), missing=c("missing"), scanner=c("scanner"),
                        vision=c("vision"), attempted=c("attempted"), tried=c("tried"), resolved=c("resolved"),
                        decoded=c("decoded"), error_code=c("code"), error_message=c("text"), variant=variant)
    r = one(df.select(i.alias("i")).select("i", o.primary_issue(c("i"), "first").alias("f"), o.primary_issue(c("i"), "severity").alias("s")))
    return [x.code for x in r.i], r.f, r.s


def test_issue_variants(spark):
    assert issues(spark, "service") == (["BARCODE_MISSING", "VISION_SCANNER_MISMATCH", "RECOVERY_FAILED"], "BARCODE_MISSING", "BARCODE_MISSING")
    assert issues(spark, "persisted") == (["VISION_SCANNER_MISMATCH", "BARCODE_MISSING", "RECOVERY_FAILED"], "VISION_SCANNER_MISMATCH", "BARCODE_MISSING")
    failed = dict(ok=False, missing=0, attempted=False)
    assert issues(spark, "service", **failed, outcome="complete")[0][0] == "PIPELINE_ERROR"
    assert issues(spark, "persisted", **failed, outcome="complete", code="boom")[0][0] == "boom"
    assert issues(spark, "service", **failed, audit=False, outcome="retryable_error")[0] == ["BAD_IMAGE"]
    quiet = dict(missing=0, scanner=6, attempted=False, outcome="complete")
    assert issues(spark, "service", **quiet) == ([], None, "none")


def test_status_of_outcome(spark):
    df = spark.createDataFrame([("complete", True), ("needs_better_photo", True), ("retryable_error", True), ("retryable_error", False)], "o string, ok boolean")
    assert [r[0] for r in df.select(o.status_from_outcome(F.col("o"), F.col("ok"))).collect()] == [
        "complete", "needs_user_input", "needs_retry", "failed"]


# --- strings -----------------------------------------------------------------

def test_strings(spark):
    df = spark.createDataFrame([("+972 50-123@c.us", "audio/OGG; codecs=opus", "code 128", "123456789012")], "p string, m string, f string, v string")
    r = one(df.select(text.normalize_phone(F.col("p")), text.audio_suffix(F.col("m")), text.normalize_format(F.col("f")), text.is_primary_code(F.col("v"))))
    assert tuple(r) == ("97250123", ".ogg", "Code128", True)


def test_sniffing(spark):
    heads = [b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n..", b"RIFF0000WEBP", b"0000ftypheic", b"<html>"]
    df = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    assert [r[0] for r in df.select(msg.sniff_image_type(F.col("c"))).collect()] == [
        "image/jpeg", "image/png", "image/webp", "image/heic", None]


# --- chat --------------------------------------------------------------------

def body(*messages, contacts=()):
    return json.dumps({"entry": [{"changes": [{"value": {"contacts": list(contacts), "messages": list(messages)}}]}]})


def test_callbacks_flatten(spark):
    rows = [
        body({"from": "1", "id": "a", "type": "text", "text": {"body": "hi"}},
             {"from": "2", "id": "b", "type": "sticker"},
             contacts=[{"wa_id": "1", "profile": {"name": "Ada"}}]),
        body({"from": "1", "id": "c", "type": "interactive", "interactive": {
            "list_reply": {"id": "x", "title": "X"}, "button_reply": {"id": "y", "title": "Y"}}}),
        body({"from": "1", "id": "d", "type": "document", "document": {"id": "m", "mime_type": "image/png"}}),
        body({"from": "1", "id": "e", "type": "audio"}),
        json.dumps({"entry": [{"changes": [{"value": {"statuses": [{"id": "s"}]}}]}]}),
        "no json", "[]",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {r.id: r for r in chat.flatten_callbacks(chat.parse_callbacks(df)).collect()}
    assert set(got) == {"a", "c", "d", "e"}
    assert (got["a"].text, got["a"].name) == ("hi", "Ada") and got["c"].text == "y"
    assert (got["d"].media_id, got["d"].filename, got["d"].name) == ("m", "", "")
    assert (got["e"].voice, got["e"].media_id, got["e"].text) == (False, "", None)


# --- tables ------------------------------------------------------------------

def test_insert_keeps_stored_and_first(spark):
    t = spark.createDataFrame([("a", 1)], "id string, v int")
    b = spark.createDataFrame([("a", 9, 1), ("b", 3, 2), ("b", 2, 1)], "id string, v int, n int")
    assert sorted(map(tuple, tables.insert_if_absent(t, b, ["id"], ["n"]).collect())) == [("a", 1), ("b", 2)]


def test_publish_replaces_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), path)
    tables.publish(spark.read.parquet(path).union(spark.range(3, 5)), path)
    assert spark.read.parquet(path).count() == 5
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.staged").exists()


def test_runs_store_prunes_folders(spark, tmp_path):
    runs = spark.sql("""select cast(id as string) as id, 'web' as source, 'complete' as status,
        timestamp'2024-01-15 00:00:00' + make_interval(0, 0, 0, cast(id as int)) as created_at from range(90)""")
    write_table(runs, str(tmp_path), "runs")
    append_table(runs.limit(0), str(tmp_path), "runs")
    late = runs_since(spark, str(tmp_path), "2024-03-01 00:00:00")
    assert late.count() == 44 and read_table(spark, str(tmp_path), "runs").count() == 90
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan and "GreaterThanOrEqual(created_at" in plan


def test_partial_update(spark):
    s = spark.createDataFrame([("a", "active", 1, "m", 5, 5, None, None), ("b", "active", 1, "m", 5, 5, None, None)],
                              "id string, status string, found_count int, message string, updated_at int, last_activity_at int, completed_at int, closed_at int")
    p = spark.createDataFrame([("a", "complete", None, None), ("b", None, None, None)], "id string, status string, found_count int, message string")
    rows = {r.id: tuple(r)[1:] for r in tables.apply_partial_update(s, p, F.lit(9)).collect()}
    assert rows == {"a": ("complete", 1, "m", 9, 9, 9, None), "b": ("active", 1, "m", 5, 5, None, None)}


def test_nested_session_result(spark):
    s = spark.createDataFrame([("a", "active"), ("b", "active")], "id string, status string")
    i = spark.createDataFrame([("a", 2, "y", 1, 0), ("a", 1, "x", 1, 0), ("b", 1, "z", 1, 0)], "session_id string, line_id long, barcode_value string, label_index int, source_image int")
    m = spark.createDataFrame([("a", 1, 3, 0, False), ("a", 2, 4, 0, True)], "session_id string, line_id long, label_index int, source_image int, resolved boolean")
    r = one(tables.session_result(s, i, m, s.filter("id = 'a'")))
    assert [x.barcode_value for x in r["items"]] == ["x", "y"] and [x.label_index for x in r.missing] == [3]


def test_results_nest_and_explode(spark):
    items = spark.createDataFrame([(1, "found", 2, 0, "v", "f", "label_bbox"), (1, "missing", 1, None, None, None, None),
                                   (1, "unassigned", None, 5, "w", "f", None)],
                                  "image_id int, kind string, label_index int, det_index int, barcode_value string, barcode_format string, match_basis string")
    nested = results.nest_items(items)
    rows = sorted(tuple(r) for r in results.explode_items(nested).select("label_index", "status").collect())
    assert rows == [(1, "missing"), (2, "found")]
    lines = results.reply_lines(items)
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["Found 2 barcodes:", "2. v (f)", "-. w (f)"]
    assert one(results.reply_texts(lines)).reply == "Found 2 barcodes:\n2. v (f)\n-. w (f)\n\nID: 1"
    assert nested.select("block").first()[0] == 0
    many = spark.range(900).selectExpr("1 as image_id", "'found' as kind", "cast(id as int) as label_index", "cast(id as int) as det_index",
                                       "'v' as barcode_value", "'f' as barcode_format", "'x' as match_basis")
    blocks = results.nest_items(many, 100).orderBy("block").collect()
    assert [[(i.place, i.label_index) for i in b.found] for b in blocks] == [
        [(i, i) for i in range(k, k + 100)] for k in range(0, 900, 100)]
    told = results.reply_lines(many, block=16).orderBy("line_no").collect()
    assert told[0].line == "Found 900 barcodes:" and [r.line for r in told[1:]] == [f"{i}. v (f)" for i in range(900)]
    assert [r.line_no for r in told] == list(range(901))


# --- review loop -------------------------------------------------------------

EVENT = ("event_id long, type string, run_id string, session_id string, t_us long, source string, image_ref string, status string, "
         "scanner_count int, vision_count int, recovery_attempted boolean, recovery_labels_resolved int")


def test_review_loop_to_ground_truth(spark, tmp_path):
    events = spark.createDataFrame([
        (1, "INGEST_COMPLETED", "r1", "s", 1, None, "/u/r1.png", "complete", 5, 6, False, 0),
        (2, "INGEST_COMPLETED", "r1", "s", 2, "web", "/u/r1.png", "failed", 0, 0, False, 0),
        (3, "INGEST_COMPLETED", "r2", "s", 3, "web", None, "complete", 6, 6, True, 0),
        (4, "INGEST_COMPLETED", "r3", "s", 4, "web", None, "complete", 6, 6, False, 0),
        (5, "IMAGE_RECEIVED", "r4", "s", 5, "web", None, "failed", 0, 0, False, 0)], EVENT)
    queue = review.candidates_from_events(events)
    assert {(r.run_id, r.source, r.status) for r in queue.collect()} == {("r1", "unknown", "complete"), ("r2", "web", "complete")}
    none = F.lit(None)
    full = queue.select("*", none.cast("long").alias("reviewed_us"), none.cast("string").alias("reviewed_by"),
                        none.cast("string").alias("expected_outcome"), F.lit(False).alias("added_to_dataset"))
    reviews = spark.createDataFrame([("cand-r1", 9, "b", "complete"), ("cand-r1", 8, "a", "failed"), ("x", 1, "a", "failed")],
                                    "id string, reviewed_us long, reviewed_by string, expected_outcome string")
    done, verdicts = review.apply_review(full, reviews)
    assert {(r.id, r.reviewed_by) for r in done.collect()} == {("cand-r1", "a"), ("cand-r2", None)}
    assert sorted((r.reviewed_us, r.accepted) for r in verdicts.collect()) == [(1, False), (8, True), (9, False)]
    again, verdicts = review.apply_review(done, reviews)
    assert not verdicts.filter("accepted").count() and again.exceptAll(done).isEmpty()
    codes = spark.createDataFrame([("r1", 1, "v", None)], "run_id string, box_no int, value string, format string")
    entries = review.export_entries(done, codes, spark.createDataFrame([("/u/r1.png",)], "path string"))
    r = one(entries)
    assert (r.image, r.value, r.format) == ("annotation_r1.png", "v", "Code128")
    after = review.mark_exported(done, entries.select("id"))
    assert tuple(one(review.queue_stats(after))) == (1, 0, 1, 2)
    assert tuple(one(review.dataset_summary(entries))) == (1, 1, 1)
    assert review.list_reviewed(after).isEmpty() and review.list_pending(after).count() == 1


def test_ground_truth_document(spark, tmp_path):
    doc = {"summary": {"image_count": 2}, "images": [
        {"image": "a.jpg", "expected_barcode_symbol_count": 3, "boxes": [
            {"status": "decoded", "value": "2"}, {"status": "decoded", "value": "1"}, {"status": "decoded", "value": "2"},
            {"status": "unreadable", "value": "9"}, {"status": "decoded", "value": ""}]},
        {"image": "b.jpg", "expected_barcode_symbol_count": 0, "boxes": []}]}
    path = tmp_path / "dataset.json"
    path.write_text(json.dumps(doc, indent=1))
    rows = {r.image: r for r in ground_truth(spark, str(path)).collect()}
    a = rows["a.jpg"]
    assert (a.expected_decoded_count, a.expected_values, a.expected_unique_values, a.expected_unique_count) == (4, ["2", "1", "2"], ["1", "2"], 2)
    assert rows["b.jpg"].expected_decoded_count == 0 and a.expected_outcome == "complete"


def test_image_inventory(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"xx")
    (tmp_path / "b").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    files = {r.path.rsplit("/", 1)[1]: (r.length, r.media_type) for r in image_inventory(spark, str(tmp_path), sniff=True).collect()}
    assert files == {"a.JPG": (2, "image/jpeg"), "b": (12, "image/png")}


def test_queue_store_casts(spark, tmp_path):
    df = spark.createDataFrame([("c", "r", 1, 0, "2024-01-01T00:00:00+00:00", None)],
                               "id string, run_id string, recovery_attempted int, added_to_dataset int, created_at string, reviewed_at string")
    append_table(df, str(tmp_path), "annotation_candidates")
    r = one(read_queue(spark, str(tmp_path)))
    assert r.recovery_attempted is True and r.added_to_dataset is False and r.created_at.year == 2024 and r.reviewed_at is None


# --- evaluation --------------------------------------------------------------

def test_recall_and_precision(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "image_id int, value string")
    f = spark.createDataFrame([(1, "a"), (1, "x"), (3, "a")], "image_id int, value string")
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id int")
    rows = {r.image_id: (r.value_recall, r.value_precision) for r in evaluate.value_scores(e, f, images).collect()}
    assert rows == {1: (0.5, 0.5), 2: (0.0, 1.0), 3: (1.0, 0.0), 4: (1.0, 1.0)}


@pytest.mark.parametrize("scores, passed", [([(1.0, 1.0, 1.0)], 1.0), ([(0.8, 1.0, 1.0)], 0.0), ([], 0.0),
                                            ([(0.9, 0.95, 0.8)], 1.0)])
def test_gates(spark, scores, passed):
    df = spark.createDataFrame(scores, "value_recall double, value_precision double, outcome_correct double")
    assert one(evaluate.aggregate_thresholds(df)).score == passed


# --- quality -----------------------------------------------------------------

def test_box_rules(spark):
    df = spark.createDataFrame([((0, 0, 0, 0),), ((5, 0, 4, 1),), ((0, 3, 1, 2),)], f"b {BOX}")
    assert [r.violations for r in quality.broken_rows(df, quality.pixel_box_rules(F.col("b"))).collect()] == [["x_order"], ["y_order"]]


def test_order_context(spark):
    df = spark.createDataFrame([(" ", "b", "create_order"), ("c", None, "ship"), ("c", "b", "create_order")], "c string, b string, a string")
    rules = quality.order_context_rules(F.col("c"), F.col("b"), F.col("a"))
    assert [r.violations for r in quality.broken_rows(df, rules).collect()] == [["customer_required"], ["branch_required", "order_action"]]


# --- sinks -------------------------------------------------------------------

def write_events(path, name, rows):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"type": t, "run_id": r, "session_id": "s", "timestamp": "2024-01-01T00:00:00Z",
                         "payload": json.dumps({"status": s, "scanner_count": 1, "vision_count": 1})}) for t, r, s in rows]
    (path / name).write_text("\n".join(lines))


def typed(stream):
    return stream.select(F.xxhash64("run_id", "timestamp").alias("event_id"), "type", "run_id", "session_id",
                         F.unix_micros("timestamp").alias("t_us"), "payload.*")


def test_queue_survives_repeats_and_a_failing_sink(spark, tmp_path):
    src, out = tmp_path / "events", str(tmp_path / "queue")
    write_events(src, "1.json", [("INGEST_COMPLETED", "a", "failed"), ("INGEST_COMPLETED", "b", "complete"), (EVENT_TYPES[0], "c", "failed")])
    write_events(src, "2.json", [("INGEST_COMPLETED", "a", "failed"), ("INGEST_COMPLETED", "d", "needs_retry")])
    batches = []

    def broken(batch, batch_id):
        batches.append(batch_id)
        raise RuntimeError("sink down")

    retry = str(tmp_path / "retry")
    handle = flows.fan_out({"broken": broken, "queue": flows.queue_sink(out)}, retry)
    stream = typed(event_stream(spark, str(src), files_per_trigger=1))
    drain_each(stream, "t", handle, str(tmp_path / "cp"))
    assert len(batches) == 2
    assert sorted(r.run_id for r in flows.read_queue(spark, out).collect()) == ["a", "d"]
    # lost checkpoint: other files and another cut into batches, from batch 0 again
    write_events(src, "3.json", [("INGEST_COMPLETED", "e", "failed"), ("INGEST_COMPLETED", "a", "failed")])
    (src / "1.json").unlink()
    again = typed(event_stream(spark, str(src), files_per_trigger=10))
    drain_each(again, "t", handle, str(tmp_path / "cp2"))
    assert sorted(r.run_id for r in flows.read_queue(spark, out).collect()) == ["a", "d", "e"]
    # what the broken sink missed can be given to it again, once
    seen = []
    for _ in range(2):
        flows.replay(spark, retry, "broken", again.schema, lambda b, i: seen.extend(r.run_id for r in b.collect()))
    assert sorted(seen) == ["a", "a", "a", "a", "b", "c", "d", "d", "e"]


def test_counts_take_each_file_once(spark, tmp_path):
    """A new checkpoint with other files beside the old ones neither loses nor doubles counts."""
    src, out = tmp_path / "events", str(tmp_path / "counts")
    write_events(src, "1.json", [("A", "a", "failed"), ("A", "b", "complete"), ("B", "c", "failed")])
    write_events(src, "2.json", [("A", "d", "failed")])

    def run(name):
        drain_each(event_stream(spark, str(src), files_per_trigger=1), "t", flows.count_sink(out, "type"), str(tmp_path / name))
        return {r.type: r.n for r in flows.summed_counts(spark, out, "type string").collect()}

    assert run("cp") == {"A": 3, "B": 1}
    (src / "1.json").unlink()
    write_events(src, "3.json", [("A", "e", "failed"), ("B", "f", "failed"), ("B", "g", "failed")])
    assert run("cp2") == {"A": 4, "B": 3}
    assert run("cp2") == run("cp") == {"A": 4, "B": 3}


def test_replay_without_failures_does_nothing(spark, tmp_path):
    flows.replay(spark, str(tmp_path / "none"), "sink", "a int", lambda b, i: pytest.fail("no batch"))


def test_late_retry_is_dropped(spark, tmp_path):
    """A message that comes again in a later run of the stream, whenever that is, is not told again."""
    from boxtally.sources.streams import webhook_stream

    src = tmp_path / "bodies"
    src.mkdir()
    body = json.dumps({"entry": [{"changes": [{"value": {"messages": [
        {"id": "m1", "from": "1", "type": "text", "text": {"body": "hi"}}]}}]}]})
    seen = []
    for name in ("1.txt", "2.txt"):
        (src / name).write_text(body)
        drain_each(flows.chat_messages(webhook_stream(spark, str(src))), "t", lambda b, i: seen.extend(r.id for r in b.collect()),
                   str(tmp_path / "cp"))
    assert seen == ["m1"]
