"""Photo results: items, outcome, issues, replies, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import messages as msg
from boxtally.functions import outcome as o
from boxtally.operators import matching, results
from boxtally.plans import inputs
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import build
from boxtally.plans.geometry_queries import MATCHES, RECOVERY, SHEET
from boxtally.plans.inputs import flat
from boxtally.session import cut_lineage

_BASE = "images label_boxes detection_boxes"
_ALL = "images label_boxes detection_boxes recovery_detections"


def _rows(spark, d, *names):
    """Rows of derived tables, counted on the fewest columns: as many tasks share a step."""
    return sum(build(spark, d, name).count() for name in names)


def _photo_items(spark, d, *boxes):
    """Items of the first scan, with the columns ``boxes`` beside those that replies and nested results show."""
    return results.photo_items(inputs.labels(spark, d), inputs.detections(spark, d), inputs.images(spark, d),
                               _rows(spark, d, "label_boxes", "detection_boxes", "images"), [*results.SHOWN, *boxes])


def _items(spark, d, *boxes):
    return _photo_items(spark, d, *boxes).rows()


def _photo(spark, d):
    """Summary of every photo after recovery."""
    images = inputs.images(spark, d)
    labels, dets = results.usable_inputs(inputs.labels(spark, d), inputs.detections(spark, d), images)
    return results.result_summary_of_counts(images, matching.photo_counts(
        labels, dets, images, inputs.recovery_detections(spark, d),
        rows=_rows(spark, d, "label_boxes", "detection_boxes", "recovery_detections", "images")))


def items_cte(matches: str, dets: str) -> str:
    return f"""
audited as (select image_id from images where scan_state <> 'error' and audit_state = 'ok'),
items as (
  select m.image_id, 'found' as kind, m.label_index, m.det_index, d.value as barcode_value,
    d.format as barcode_format, m.basis as match_basis, l.status as label_status,
    d.x1, d.y1, d.x2, d.y2
  from {matches} m join {dets} d on d.image_id = m.image_id and d.det_index = m.det_index
  join label_boxes l on l.image_id = m.image_id and l.label_index = m.label_index
  where m.image_id in (select image_id from audited)
  union all
  select l.image_id, 'missing', l.label_index, null, null, null, null, l.status, bx1, by1, bx2, by2
  from label_boxes l where l.image_id in (select image_id from audited) and not exists (
    select 1 from {matches} m where m.image_id = l.image_id and m.label_index = l.label_index)
  union all
  select d.image_id, 'unassigned', null, d.det_index, d.value, d.format, null, null, x1, y1, x2, y2
  from {dets} d where d.image_id in (select image_id from images where scan_state <> 'error') and not exists (
    select 1 from {matches} m where m.image_id = d.image_id and m.det_index = d.det_index
      and m.image_id in (select image_id from audited)))"""


_FIRST_ITEMS = f"{MATCHES}, {items_cte('matches', 'detection_boxes')}"


@query("E3", f"""with {_FIRST_ITEMS}
select image_id, kind, coalesce(label_index, 0) as label_index, coalesce(det_index, 0) as det_index,
  barcode_value, barcode_format, match_basis, label_status, coalesce(x1, -1) as x1, coalesce(y1, -1) as y1,
  coalesce(x2, -1) as x2, coalesce(y2, -1) as y2 from items""", _BASE, recursive=True)
def assemble_items(spark, d):
    out = flat(_items(spark, d, "barcode_box", "label_status"), "barcode_box")
    whole = {c: F.coalesce(c, F.lit(0)) for c in ("label_index", "det_index")}
    return out.withColumns(whole | {c: F.coalesce(c, F.lit(-1)) for c in ("x1", "y1", "x2", "y2")})


@query("S2 E1", f"""with {_FIRST_ITEMS}
select image_id as run_id, label_index, barcode_value, barcode_format, match_basis, kind as status
from items where kind in ('found', 'missing')""", _BASE, recursive=True)
def run_item_rows(spark, d):
    return results.run_item_rows(_items(spark, d, "barcode_box", "label_box")).drop("barcode_box", "label_box")


@query("E1", f"""with {_FIRST_ITEMS}
select image_id, label_index, barcode_value, barcode_format, match_basis, kind as status
from items where kind in ('found', 'missing')""", _BASE, recursive=True)
def explode_items(spark, d):
    return results.explode_items(results.nest_photos(_photo_items(spark, d)))


_SHEET_ITEMS = f"""{_FIRST_ITEMS},
sheet_items as (select image_id // {SHEET} as sheet, *, case kind when 'found' then 0 when 'missing' then 1 else 2 end as k from items),
placed as (select *, row_number() over (partition by sheet order by k, label_index nulls first, det_index nulls first,
  barcode_value nulls first, match_basis nulls first) - 1 as place from sheet_items)"""


@query("E1", f"""with {_SHEET_ITEMS}
select sheet as image_id, place // 512 as block, place, kind, coalesce(label_index, -1) as label_index, coalesce(det_index, -1) as det_index,
  barcode_value from placed""", _BASE, recursive=True)
def nest_items_crowded(spark, d):
    """Photos of well over 512 items as nested rows, and every item with its block and place."""
    items = _items(spark, d).withColumn("image_id", F.floor(F.col("image_id") / SHEET).cast("long"))
    nested = results.nest_items(items)

    def of(kind):
        return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))

    rows = F.inline_outer(F.concat(*map(of, ("found", "missing", "unassigned"))))
    return results.unpacked(nested.select("image_id", "block", rows), "kind").select(
        "image_id", "block", "item.place", "kind", F.coalesce("item.label_index", F.lit(-1)).alias("label_index"),
        F.coalesce("item.det_index", F.lit(-1)).alias("det_index"), "item.barcode_value")


_SUMMARY = f"""{RECOVERY}, {items_cte('final', 'all_dets')},
second_ok as (select * from second where image_id in (select image_id from audited)),
tried_ok as (select * from tried where image_id in (select image_id from audited)),
counted as (select i.image_id, i.elapsed_ms, i.scan_state <> 'error' as ok,
  i.scan_state <> 'error' and i.audit_state = 'ok' as audit_available,
  count(*) filter (kind = 'found') as found_count, count(*) filter (kind = 'missing') as missing_count,
  count(*) filter (kind = 'unassigned') as unassigned_count,
  array_to_string(list_sort(list(label_index) filter (kind = 'missing')), ',') as missing_labels
  from images i left join (select * from items where not (kind = 'unassigned' and det_index >= 4611686018427387904
    and image_id not in (select image_id from audited))) x using (image_id) group by all),
summary as (select c.*, found_count + missing_count as visible_label_count,
  t.labels_tried is not null as recovery_attempted, coalesce(t.labels_tried, 0) as labels_tried,
  coalesce(s.n, 0) as barcodes_found,
  case when t.labels_tried is null then 0 else found_count - coalesce(b.n, 0) end as labels_resolved,
  found_count + unassigned_count as scanner_count,
  case when not ok or not audit_available then 'retryable_error'
    when missing_count > 0 or found_count + missing_count = 0 then 'needs_better_photo' else 'complete' end as outcome
  from counted c left join tried_ok t using (image_id)
  left join (select image_id, count(*) as n from second_ok group by 1) s using (image_id)
  left join (select image_id, count(*) as n from matches group by 1) b using (image_id)),
stated as (select *, case outcome when 'complete' then 'complete' when 'needs_better_photo' then 'needs_user_input'
  else case when ok then 'needs_retry' else 'failed' end end as status from summary)"""


@query("P29 P30 P31", f"""with {_SUMMARY}
select image_id, outcome, status, audit_available, visible_label_count, found_count, missing_count,
  unassigned_count, audit_available and visible_label_count > 0 and missing_count = 0 as all_found,
  scanner_count, visible_label_count as vision_count, scanner_count = visible_label_count as scanner_vision_match,
  visible_label_count - scanner_count as count_delta, recovery_attempted, labels_tried, barcodes_found,
  labels_resolved, labels_resolved > 0 as recovery_succeeded,
  case when outcome = 'needs_better_photo' then case when visible_label_count = 0
    then 'No barcode labels were identified. Please take a closer, well-lit photo.'
    else 'Please photograph the marked barcode area more closely.' end end as message
from stated""", _ALL, recursive=True)
def photo_results(spark, d):
    return _photo(spark, d).select(
        "image_id", "outcome", "status", "audit_available", "visible_label_count", "found_count",
        "missing_count", "unassigned_count", "all_found", "scanner_count", "vision_count",
        "scanner_vision_match", "count_delta", "recovery_attempted", "labels_tried", "barcodes_found",
        "labels_resolved", "recovery_succeeded", "message")


_MISSING = """case when missing_count > 0{audit} then concat('BARCODE_MISSING/warning/', missing_count,
  ' label(s) without a decoded barcode/{{"missing_count":', missing_count, ',"{labels}":[', missing_labels, ']}}') end"""
_DIFFERS = """case when audit_available and scanner_count <> visible_label_count then concat(
  'VISION_SCANNER_MISMATCH/info/Scanner decoded ', scanner_count, ' barcode(s) but vision found ',
  visible_label_count, ' label(s)/{"scanner_count":', scanner_count, ',"vision_count":', visible_label_count, '}') end"""
_FAILED = """case when not ok then
  'BAD_IMAGE/error/cannot identify image file/ERROR' end"""
_VAIN = """case when recovery_attempted and labels_resolved = 0 then concat('RECOVERY_FAILED/info/Recovery tried ',
  labels_tried, ' label(s) but resolved 0/{"labels_tried":', labels_tried, ',"barcodes_found":', barcodes_found, '}') end"""


def _issue_sql(variant: str) -> str:
    service = variant == "service"
    lost = _MISSING.format(audit=" and audit_available" if service else "", labels="label_indices" if service else "missing_labels")
    error = '{"code":"invalid_image","message":"cannot identify image file"}'
    failed = _FAILED.replace("ERROR", f'{{"error":{error}}}' if service else error)
    middle = [lost, _DIFFERS] if variant == "service" else [_DIFFERS, lost]
    return f"""with {_SUMMARY},
listed as (select image_id, list_filter([{failed}, {middle[0]}, {middle[1]}, {_VAIN}], lambda x: x is not null) as l from stated)
select image_id, array_to_string(l, ';') as issues, len(l) as issue_count,
  split_part(l[1], '/', 1) as first_issue,
  coalesce(split_part(list_filter(l, lambda x: contains(x, '/error/'))[1], '/', 1),
    split_part(list_filter(l, lambda x: contains(x, '/warning/'))[1], '/', 1),
    split_part(l[1], '/', 1), 'none') as gravest_issue
from listed"""


def _issues(spark, d, variant):
    text = F.array_join(F.transform("issues", lambda i: F.concat_ws(
        "/", i["code"], i["severity"], i["message"], i["evidence"])), ";")
    return results.with_issues(_photo(spark, d), variant).select(
        "image_id", text.alias("issues"), F.size("issues").cast("long").alias("issue_count"),
        "first_issue", "gravest_issue")


@query("P32 P33", _issue_sql("service"), _ALL, recursive=True)
def derive_issues_service(spark, d):
    return _issues(spark, d, "service")


@query("P32 P33", _issue_sql("persisted"), _ALL, recursive=True)
def derive_issues_persisted(spark, d):
    return _issues(spark, d, "persisted")


@query("E4", f"""with {RECOVERY},
decoded as (select image_id, count(*) as n, count(distinct value) as u from all_dets group by 1),
seen as (select image_id, count(*) as n, count(*) filter (status = 'clear') as c from label_boxes group by 1),
m as (select image_id, count(*) as n from final group by 1),
b as (select image_id, count(*) as n from matches group by 1),
s as (select image_id, count(*) as n from second group by 1)
select i.image_id, coalesce(decoded.n, 0) as decoded_count, coalesce(decoded.u, 0) as unique_value_count,
  coalesce(seen.n, 0) as visible_labels, coalesce(seen.c, 0) as clear_labels,
  labels_tried is not null as recovery_attempted, coalesce(labels_tried, 0) as labels_tried,
  coalesce(s.n, 0) as barcodes_found,
  case when labels_tried is null then 0 else coalesce(m.n, 0) - coalesce(b.n, 0) end as labels_resolved,
  coalesce(decoded.n, 0) = coalesce(seen.n, 0) as match, coalesce(decoded.n, 0) - coalesce(seen.n, 0) as difference,
  coalesce(m.n, 0) as matched_labels, coalesce(m.n, 0) = coalesce(seen.n, 0) as all_labels_matched
from images i left join decoded using (image_id) left join seen using (image_id) left join m using (image_id)
left join b using (image_id) left join s using (image_id) left join tried using (image_id)""", _ALL, recursive=True)
def decoded_vs_visible(spark, d):
    images = inputs.images(spark, d)
    return results.pipeline_summary(images, matching.photo_counts(
        inputs.labels(spark, d), inputs.detections(spark, d), images, inputs.recovery_detections(spark, d),
        rows=_rows(spark, d, "label_boxes", "detection_boxes", "recovery_detections", "images"), status=True))


@query("E4 D2", "select distinct image_id, value from detection_boxes", "detection_boxes")
def unique_values(spark, d):
    return results.unique_values(inputs.detections(spark, d))


@query("E8", """
select image_id, label_index, status, cast(greatest(0, least(w, round_even(l * w / 1000e0, 0))) as int) as x1,
  cast(greatest(0, least(h, round_even(t * h / 1000e0, 0))) as int) as y1,
  cast(greatest(0, least(w, round_even(r * w / 1000e0, 0))) as int) as x2,
  cast(greatest(0, least(h, round_even(b * h / 1000e0, 0))) as int) as y2, has_barcode
from (select l_orderkey as image_id, cast(l_linenumber as int) as label_index,
  case when l_partkey % 4 = 0 then 'blurred' else 'clear' end as status,
  l_partkey % 500 as l, l_suppkey % 500 as t, l_partkey % 500 + 120 as r, l_suppkey % 500 + 90 as b,
  1000 + l_orderkey % 3000 as w, 1500 + l_orderkey % 2500 as h, l_partkey % 5 <> 0 as has_barcode from lineitem) n""")
def audit_to_pixels(spark, d):
    norm = F.expr("named_struct('top', l_suppkey % 500, 'left', l_partkey % 500, "
                  "'bottom', l_suppkey % 500 + 90, 'right', l_partkey % 500 + 120)")
    t = build(spark, d, "lineitem")
    one = F.struct(
        F.col("l_linenumber").alias("label_index"), norm.alias("label_bbox"),
        F.when(F.col("l_partkey") % 5 != 0, norm).alias("barcode_bbox"),
        F.when(F.col("l_partkey") % 4 == 0, "blurred").otherwise("clear").alias("status"),
        F.lit("high").alias("confidence"))
    audits = t.select(F.col("l_orderkey").alias("image_id"),
                      (1000 + F.col("l_orderkey") % 3000).alias("image_width"),
                      (1500 + F.col("l_orderkey") % 2500).alias("image_height"), F.array(one).alias("labels"))
    out = results.audit_to_pixels(audits)
    return flat(out.select("image_id", "label_index", "status", "label_box",
                           F.col("barcode_box").isNotNull().alias("has_barcode")), "label_box")


@query("A19", """
select image_id, count(*) as visible, count(*) filter (status = 'clear') as clear from label_boxes group by 1""",
       "label_boxes")
def audit_counts(spark, d):
    return results.audit_counts(inputs.labels(spark, d))


@query("A20", """
select image_id, case when scan_state = 'error' then 'error' when n > 0 then 'found' else 'not_found' end as status,
  case when scan_state = 'error' then 0 else coalesce(n, 0) end as count
from images left join (select image_id, count(*) as n from detection_boxes group by 1) c using (image_id)""", _BASE)
def scanner_status(spark, d):
    return results.scanner_status(inputs.images(spark, d), inputs.detections(spark, d))


@query("P34", """
select id, status in ('failed', 'needs_retry', 'needs_user_input') or scanner_count <> vision_count
  or (recovery_attempted and recovery_labels_resolved = 0) as interesting from runs""", "runs")
def interesting_runs(spark, d):
    return build(spark, d, "runs").select("id", o.is_interesting(
        F.col("status"), F.col("scanner_count"), F.col("vision_count"), F.col("recovery_attempted"),
        F.col("recovery_labels_resolved")).alias("interesting"))


@query("P35", """
with f as (
  select id, 'complete' as key, status = 'complete' as s, concat('status=', status) as comment from runs
  union all select id, 'scanner_vision_match', scanner_count = vision_count,
    concat('scanner=', scanner_count, ' vision=', vision_count) from runs
  union all select id, 'recovery_required', recovery_attempted,
    concat('attempted=', case when recovery_attempted then 'True' else 'False' end) from runs
  union all select id, 'recovery_success', recovery_labels_resolved > 0, concat('resolved=', recovery_labels_resolved) from runs
  union all select id, 'user_retry_required', status = 'needs_user_input', concat('status=', status) from runs
  union all select id, 'latency_ok', latency_ms <= 10000, concat('elapsed_ms=', latency_ms) from runs)
select id, key, case when s then 1 else 0 end as score, comment from f""", "runs")
def online_feedback(spark, d):
    c = F.col
    return build(spark, d, "runs").select("id", F.inline(o.online_feedback(
        c("status"), c("scanner_count"), c("vision_count"), c("recovery_attempted"),
        c("recovery_labels_resolved"), c("latency_ms"))))


@query("P36", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_partkey % 3
  when 0 then concat('Found ', l_linenumber, ' new barcodes but only ', l_suppkey % 5, ' missing. Which one(s) to add? [',
    array_to_string(list_transform(range(1, l_linenumber + 1), lambda i: concat(chr(39), 'c', i, chr(39))), ', '), ']')
  when 1 then case when l_suppkey % 4 > 0
    then concat('Found ', l_suppkey % 5, '/9. Send a photo of box(es): [', array_to_string(range(1, l_suppkey % 4 + 1), ', '), ']')
    else concat('Found ', l_suppkey % 5, '/9. Send another photo.') end end as message
from lineitem""")
def session_messages(spark, d):
    c = F.col
    n = c("l_suppkey") % 4
    lost = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
    codes = F.transform(F.sequence(F.lit(1), c("l_linenumber")), lambda i: F.concat(F.lit("c"), i.cast("string")))
    status = F.when(c("l_partkey") % 3 == 0, "needs_user_selection").when(c("l_partkey") % 3 == 1, "active").otherwise("complete")
    some = c("l_suppkey") % 5
    return build(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        msg.session_message(status, some, F.lit(9), lost, codes, some).alias("message"))


@query("P37", f"""with {_FIRST_ITEMS},
lines as (select image_id, kind, label_index, det_index,
  concat(case kind when 'found' then cast(label_index as varchar) else '-' end, '. ', barcode_value, ' (', barcode_format, ')') as line
  from items where kind <> 'missing')
select image_id, concat('Found ', count(*), ' barcodes:', chr(10),
  string_agg(line, chr(10) order by kind, label_index, det_index), chr(10), chr(10), 'ID: ', image_id) as reply
from lines group by 1""", _BASE, recursive=True)
def reply_text(spark, d):
    return results.reply_texts(
        results.reply_photos(_photo_items(spark, d)), _rows(spark, d, "detection_boxes", "images"))


_LINES = """read as (select *, case kind when 'found' then cast(label_index as varchar) else '-' end as no
  from {photos} where kind <> 'missing')
select image_id, 0 as line_no, concat('Found ', count(*), ' barcodes:') as line from read group by 1
union all
select image_id, row_number() over (partition by image_id order by kind, label_index nulls first, det_index nulls first,
  barcode_value nulls first, barcode_format nulls first), concat(no, '. ', barcode_value, ' (', barcode_format, ')') from read"""


@query("P37", f"""with {_FIRST_ITEMS}, {_LINES.format(photos='items')}""", _BASE, recursive=True)
def reply_lines(spark, d):
    return results.reply_photos(_photo_items(spark, d))


# All photos told as seven, so that a photo holds many times what fits a short message.
@query("P37 E1", f"""with {_FIRST_ITEMS}, few as (select * replace (image_id % 7 as image_id) from items),
{_LINES.format(photos='few')}""", _BASE, recursive=True)
def reply_lines_crowded(spark, d):
    return results.reply_lines(_items(spark, d).withColumn("image_id", F.col("image_id") % 7), block=4)


@query("P38", """
select id, concat('I read ', found_count, ' of ', vision_count,
  ' labels. Please take a closer photo of the marked barcode.', chr(10), 'ID: ', id, chr(10), 'Trace: ', trace_id) as caption
from runs""", "runs")
def photo_captions(spark, d):
    return build(spark, d, "runs").select("id", msg.photo_caption(
        F.col("found_count"), F.col("vision_count"), F.col("id"), F.col("trace_id")).alias("caption"))


@query("P39", f"""with {_SUMMARY}
select image_id, case when audit_available then concat(found_count, '/', visible_label_count) else '-/-' end as matched,
  case when not audit_available then 'ERR' when missing_count = 0 then 'OK' else 'DIFF' end as verdict,
  scanner_count as decoded,
  case when elapsed_ms % 10 = 5 and elapsed_ms < 0 then '' else concat(
    cast((elapsed_ms + 5) // 10 // 100 as varchar), '.', lpad(cast((elapsed_ms + 5) // 10 % 100 as varchar), 2, '0'), 's') end as time
from stated""", _ALL, recursive=True)
def summary_rows(spark, d):
    return results.summary_rows(_photo(spark, d))


@query("P39 A20", """
select image_id, case when scan_state = 'error' then 'error' when n > 0 then 'found' else 'not_found' end as status,
  case when scan_state = 'error' then 0 else coalesce(n, 0) end as barcodes,
  concat(cast((elapsed_ms + 5) // 10 // 100 as varchar), '.', lpad(cast((elapsed_ms + 5) // 10 % 100 as varchar), 2, '0'), 's') as time
from images left join (select image_id, count(*) as n from detection_boxes group by 1) c using (image_id)""", _BASE)
def scan_table(spark, d):
    return results.scan_rows(inputs.images(spark, d), inputs.detections(spark, d))


@query("P39 A19", """
select image_id, audit_state as status, coalesce(cast(v as varchar), '-') as visible, coalesce(cast(c as varchar), '-') as clear, '-' as time
from images left join (select image_id, count(*) as v, count(*) filter (status = 'clear') as c from label_boxes
  where supp % 3 = 0 group by 1) l using (image_id)""", _BASE)
def audit_table(spark, d):
    labels = inputs.labels(spark, d).join(build(spark, d, "label_boxes").filter("supp % 3 = 0").select("image_id", "label_index"),
                                          ["image_id", "label_index"], "left_semi")
    return results.audit_rows(inputs.images(spark, d), labels, timed=False)
