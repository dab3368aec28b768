"""Stored tables with a change log: the same operations as the rewrites, on the rows they touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import review, tables
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import build
from boxtally.plans.store_queries import _COMPLETED_SQL, _FIRST_REVIEW
from boxtally.session import cut_lineage, scratch_path
from boxtally.sources import export
from boxtally.sources.change_log import LoggedTable


def _stored(spark, rows, name, key, **kw) -> LoggedTable:
    table = LoggedTable(spark, scratch_path(spark, name), rows.schema, key, **kw)
    table.create(rows)
    return table


@query("S1 K1 K3 K4 D7", f"""
with stored as (
  select *, cast(id as bigint) as k from runs where cast(id as bigint) % 2 = 0 union all
  select * replace ('retry' as source, 'pending' as status), cast(id as bigint) from runs
  where cast(id as bigint) % 3 = 0 and cast(id as bigint) % 2 <> 0),
done as (select id, k, source, {", ".join(f"case when k % 3 = 0 then {v} else {c} end as {c}" for c, v in _COMPLETED_SQL.items())},
  case when k % 3 = 0 and k % 4 <> 0 then 1600 else image_width end as image_width,
  case when k % 3 = 0 then timestamp '2002-01-01 00:00:00' else processed_at end as processed_at from stored)
select * exclude (k) replace (
  case when k % 5 = 0 then 'failed' else status end as status, case when k % 5 = 0 then 'TimeoutError' else error_code end as error_code,
  case when k % 5 = 0 then repeat('x', 500) else error_message end as error_message,
  case when k % 5 = 0 then timestamp '2003-01-01 00:00:00' else processed_at end as processed_at) from done""", "runs")
def logged_runs(spark, d):
    """Inserts, completions and failures by month, compacted in between."""
    runs = build(spark, d, "runs")
    k = F.col("id").cast("long")
    table = _stored(spark, runs.filter(k % 2 == 0), "logged-runs", ["id"], part=lambda: F.date_format("created_at", "yyyy-MM"))
    batch = runs.filter(k % 3 == 0).withColumns({"source": F.lit("retry"), "status": F.lit("pending"), "seq": k})
    table.insert_if_absent(batch.unionByName(batch.withColumns({"seq": k + 1, "source": F.lit("later")})), ["seq"])
    done = runs.filter(k % 3 == 0).withColumns({
        c: F.expr(v.replace("varchar", "string")).cast(runs.schema[c].dataType) for c, v in _COMPLETED_SQL.items()})
    done = done.withColumn("image_width", F.when(k % 4 == 0, 0).otherwise(1600))
    table.update(done, lambda rows: tables.apply_completion(rows, done, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")))
    table.compact()
    failures = runs.filter(k % 5 == 0).select(
        "id", F.lit("TimeoutError").alias("error_class"), F.expr("repeat('x', 600)").alias("error_text"))
    table.update(failures, lambda rows: tables.apply_failure(rows, failures, F.lit("2003-01-01 00:00:00").cast("timestamp_ntz")))
    return table.read().select("id", "source", *_COMPLETED_SQL, "image_width", "processed_at")


@query("K2 K6 K7", f"""with {_FIRST_REVIEW}
select q.id, coalesce(q.reviewed_us, f.reviewed_us, -1) as reviewed_us, coalesce(q.reviewed_by, f.reviewed_by) as reviewed_by,
  q.added_to_dataset or q.id in (select id from reviews where expected_outcome = 'failed') as added_to_dataset
from queue q left join first_review f using (id)""", "queue reviews")
def logged_queue(spark, d):
    queue, reviews = build(spark, d, "queue"), build(spark, d, "reviews")
    k = F.substring("id", 6, 30).cast("long")
    table = _stored(spark, queue.filter(k % 3 != 1), "logged-queue", ["id"])
    table.insert_if_absent(queue, ["created_us"])
    table.update(reviews, lambda rows: review.apply_review(rows, reviews)[0])
    exported = reviews.filter("expected_outcome = 'failed'")
    table.update(exported, lambda rows: review.mark_exported(rows, exported))
    return table.read().select("id", F.coalesce("reviewed_us", F.lit(-1)).alias("reviewed_us"), "reviewed_by", "added_to_dataset")


# --- reviewed codes and their export -----------------------------------------

_CODED = """
codes as (select run_id, count(*) as n,
  string_agg(concat(coalesce(value, '?'), ':', coalesce(format, '?')), ',' order by box_no, value nulls first, format nulls first) as text from expected_codes group by 1)"""


def _coded_reviews(spark, d):
    """Reviews with the codes the reviewer read; a photo's codes are one small list."""
    codes = build(spark, d, "expected_codes").groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("box_no", "value", "format"))),
        lambda b: F.struct(b["value"].alias("value"), b["format"].alias("format"))).alias("expected_barcodes"))
    return build(spark, d, "reviews").join(codes, "run_id", "left")


def _uncoded(df):
    return df.withColumn("expected_barcodes", F.lit(None).cast("array<struct<value:string,format:string>>"))


def _codes_text(df):
    text = F.transform("expected_barcodes", lambda b: F.concat(
        F.coalesce(b["value"], F.lit("?")), F.lit(":"), F.coalesce(b["format"], F.lit("?"))))
    return df.withColumn("expected_barcodes", F.array_join(text, ","))


@query("K6", f"""with {_FIRST_REVIEW}, {_CODED}
select q.id, coalesce(q.reviewed_us, f.reviewed_us, -1) as reviewed_us, case when q.reviewed_us is null then c.text end as expected_barcodes
from queue q left join first_review f using (id) left join codes c on c.run_id = f.run_id""", "queue reviews expected_codes")
def apply_review_codes(spark, d):
    after = review.apply_review(_uncoded(build(spark, d, "queue")), _coded_reviews(spark, d))[0]
    return _codes_text(after).select("id", F.coalesce("reviewed_us", F.lit(-1)).alias("reviewed_us"), "expected_barcodes")


@query("K6b", f"""
with last_review as (select * from reviews qualify row_number() over (partition by run_id order by reviewed_us desc, reviewed_by) = 1),
{_CODED}
select q.run_id, coalesce(l.reviewed_by, q.reviewed_by) as reviewed_by, c.text as expected_barcodes
from queue q left join last_review l using (run_id) left join codes c on c.run_id = l.run_id""", "queue reviews expected_codes")
def overwrite_review_codes(spark, d):
    stored = _uncoded(build(spark, d, "queue")).withColumn("status", F.lit("pending"))
    return _codes_text(review.apply_review_overwrite(stored, _coded_reviews(spark, d))).select("run_id", "reviewed_by", "expected_barcodes")


_STORE = """
reviewed as (select q.*, f.id is not null as late from queue q left join (select distinct id from reviews) f using (id)),
ready as (select id, run_id from reviewed where (reviewed_us is not null or late) and not added_to_dataset
  and image_ref in (select path from inventory)),
images as (
  select concat('photo', image_id, '.jpg') as image, 'manual' as source, cast(null as varchar) as annotation_run_id,
    cast(count(*) as int) as expected_barcode_symbol_count, cast(count(*) filter (state = 'decoded') as int) as expected_decoded_count
  from expected_symbols group by image_id
  union all
  select concat('annotation_', r.run_id, '.jpg'), 'annotation', r.run_id, cast(count(e.run_id) as int), cast(count(e.run_id) as int)
  from ready r left join (select c.* from expected_codes c join reviews v on v.run_id = c.run_id and v.reviewed_by = 'late0'
    join queue q on q.run_id = c.run_id where q.reviewed_us is null) e using (run_id) group by r.run_id)"""


def _export_store(spark, d):
    """A store with older images and a queue whose late reviews bring codes."""
    old = build(spark, d, "expected_symbols").groupBy("image_id").agg(
        F.count(F.lit(1)).cast("int").alias("expected_barcode_symbol_count"),
        F.count_if(F.col("state") == "decoded").cast("int").alias("expected_decoded_count")).select(
        F.concat(F.lit("photo"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("image"), F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("annotation_run_id"), "expected_barcode_symbol_count", "expected_decoded_count")
    store = export.GroundTruthStore(_stored(spark, old, "truth-images", ["image"]),
                                    LoggedTable(spark, scratch_path(spark, "truth-boxes"), export.BOXES, ["image", "box_no"]))
    queue = _stored(spark, _uncoded(build(spark, d, "queue")), "export-queue", ["id"])
    reviews = _coded_reviews(spark, d)
    queue.update(reviews, lambda rows: review.apply_review(rows, reviews)[0])
    return store, queue, build(spark, d, "inventory")


def _interrupted_export(spark, d):
    """An export that stops before it marks, and is run again."""
    store, queue, inventory = _export_store(spark, d)
    store.publish(cut_lineage(review.export_entries(queue.read(), review.reviewed_codes(queue.read()), inventory)))
    summary = store.export(queue, review.reviewed_codes(queue.read()), inventory)
    return store, queue, summary


@query("K7 K8 J8", f"with {_STORE} select * from images", "queue reviews expected_codes inventory expected_symbols")
def export_dataset(spark, d):
    return _interrupted_export(spark, d)[0].images.read()


@query("K8 A14", f"""with {_STORE}
select count(*) as image_count, sum(expected_barcode_symbol_count)::bigint as expected_barcode_symbol_count,
  sum(expected_decoded_count)::bigint as expected_decoded_count,
  (select count(*) from reviewed where added_to_dataset) + (select count(*) from ready) as exported,
  (select count(*) from reviewed where (reviewed_us is not null or late) and not added_to_dataset) - (select count(*) from ready) as waiting
from images""", "queue reviews expected_codes inventory expected_symbols")
def export_summary(spark, d):
    _, queue, summary = _interrupted_export(spark, d)
    stats = review.queue_stats(queue.read()).select("exported", F.col("reviewed").alias("waiting"))
    return summary.join(F.broadcast(stats))


@query("K5 K11 K12 T3", """
with patched as (
  select id, k, case when k % 3 = 0 and k % 2 = 0 then 'complete' else status end as status from (
    select *, cast(substr(id, 2) as bigint) as k from sessions) x),
ended as (select id, case when k % 4 = 0 and status in ('active', 'complete') then 'closed' else status end as status from patched)
select 'sessions' as part, id as session_id, -1 as line_id, status from ended where status <> 'expired'
union all select 'items', session_id, line_id, null from session_items
  where session_id not in (select id from ended where status = 'expired')
union all select 'missing', session_id, line_id, null from session_missing
  where session_id not in (select id from ended where status in ('expired', 'complete'))""", "sessions session_items session_missing")
def logged_sessions(spark, d):
    """Patches, closing, a cascading delete of expired sessions and cleared missing labels."""
    s, k = build(spark, d, "sessions"), F.substring("id", 2, 30).cast("long")
    parents = _stored(spark, s, "logged-sessions", ["id"])
    children = {name: _stored(spark, build(spark, d, f"session_{name}"), f"logged-{name}", ["session_id", "line_id"])
                for name in ("items", "missing")}
    patch = s.filter(k % 3 == 0).select("id", F.when(k % 2 == 0, "complete").alias("status"))
    parents.update(patch, lambda rows: tables.apply_partial_update(rows, patch, F.lit(99).cast("long")))
    named = s.filter(k % 4 == 0).select("id")
    parents.update(named, lambda rows: tables.close_sessions(rows, named, F.lit(99).cast("long")))
    gone = cut_lineage(parents.read().filter("status = 'expired'").select("id"))  # used three times
    for child in children.values():
        child.delete_where("session_id", gone)
    parents.delete(gone)
    children["missing"].delete_where("session_id", parents.read().filter("status = 'complete'").select("id"))
    lines = [children[name].read().select(F.lit(name).alias("part"), "session_id", "line_id", F.lit(None).cast("string").alias("status"))
             for name in ("items", "missing")]
    return parents.read().select(F.lit("sessions").alias("part"), F.col("id").alias("session_id"), F.lit(-1).cast("long").alias("line_id"),
                                 "status").unionByName(lines[0]).unionByName(lines[1])
