"""Chat, review queue, evaluation, table maintenance and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import messages as msg
from boxtally.functions import text
from boxtally.operators import chat, evaluate, quality, review, tables
from boxtally.plans import inputs
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import build
from boxtally.plans.geometry_queries import greedy_cte
from boxtally.session import cut_lineage, scratch_path

C = "cast({} as varchar)"


# --- chat --------------------------------------------------------------------

def callback_bodies(messages):
    """One callback body per message."""
    c = F.col

    def when(kind: str, *fields):
        return F.when(c("type") == kind, F.struct(*fields))

    mime, media = c("image_mime"), c("media_id")
    caption = F.concat(F.lit("cap "), c("turn").cast("string"))
    choice = F.struct(F.concat(F.lit("c"), (c("turn") % 5).cast("string")).alias("id"),
                      F.concat(F.lit("pick "), c("turn").cast("string")).alias("title"))
    body = F.struct(
        c("sender").alias("from"), c("id"), c("type"),
        when("text", c("text").alias("body")).alias("text"),
        when("audio", media.alias("id"), c("audio_mime").alias("mime_type"),
             (c("turn") % 2 == 0).alias("voice")).alias("audio"),
        when("image", media.alias("id"), mime.alias("mime_type"), caption.alias("caption")).alias("image"),
        when("document", media.alias("id"), mime.alias("mime_type"),
             F.concat(F.lit("f"), c("turn").cast("string"), F.lit(".pdf")).alias("filename"),
             caption.alias("caption")).alias("document"),
        F.when(c("type") == "interactive", F.struct(
            F.when(c("turn") % 4 == 2, choice).alias("list_reply"),
            F.when(c("turn") % 4 != 2, choice).alias("button_reply"))).alias("interactive"))
    contact = F.struct(c("sender").alias("wa_id"), F.struct(c("contact").alias("name")).alias("profile"))
    # Each callback also carries a message of a type that is not handled.
    other = body.withField("type", F.lit("reaction")).withField("id", F.concat(F.lit("x"), c("id")))
    value = F.struct(F.struct(F.array(contact).alias("contacts"), F.array(body, other).alias("messages")).alias("value"))
    entry = F.array(F.struct(F.array(value).alias("changes")))
    return messages.select("conv_id", F.to_json(F.struct(entry.alias("entry"))).alias("value"))


FLAT_CHAT = """
flat_chat as (select conv_id, sender, id, type, contact as name,
  case type when 'text' then text when 'interactive' then concat('c', turn % 5) end as text,
  case when type in ('audio', 'image', 'document') then media_id end as media_id,
  case when type in ('image', 'document') then image_mime when type = 'audio' then audio_mime end as mime_type,
  case when type = 'audio' then turn % 2 = 0 end as voice,
  case when type in ('image', 'document') then concat('cap ', turn) end as caption,
  case when type = 'document' then concat('f', turn, '.pdf') end as filename,
  case when type = 'interactive' then concat('c', turn % 5) end as interactive_id,
  case when type = 'interactive' then concat('pick ', turn) end as interactive_title
from chat_messages where type <> 'sticker')"""


def _flat_chat(spark, d):
    bodies = callback_bodies(build(spark, d, "chat_messages"))
    broken = bodies.limit(0).unionByName(bodies.select("conv_id", F.lit("not json").alias("value")))
    return chat.flatten_callbacks(chat.parse_callbacks(bodies.unionByName(broken)))


@query("S7 E2", f"with {FLAT_CHAT} select * from flat_chat", "chat_messages")
def flatten_callbacks(spark, d):
    return _flat_chat(spark, d)


@query("P43", f"""with {FLAT_CHAT}
select id, case when type = 'image' then 'photo'
  when type = 'document' and lower(mime_type) in ('image/jpeg', 'image/png', 'image/webp') then 'photo'
  when type = 'document' then 'instruction' when type = 'audio' then 'audio' else 'selection' end as route
from flat_chat""", "chat_messages")
def route_messages(spark, d):
    return _flat_chat(spark, d).select("id", msg.route_message(F.col("type"), F.col("mime_type")).alias("route"))


_WITH_REPEATS = """arrivals as (select *, conv_id * 2 as seq from flat_chat
  union all select *, conv_id * 2 + 1 from flat_chat where conv_id % 3 = 0)"""


def _arrivals(spark, d):
    m = _flat_chat(spark, d)
    again = m.filter(F.col("conv_id") % 3 == 0).withColumn("seq", F.col("conv_id") * 2 + 1)
    return m.withColumn("seq", F.col("conv_id") * 2).unionByName(again)


@query("D6", f"with {FLAT_CHAT}, {_WITH_REPEATS} select id, min(seq) as seq from arrivals group by 1", "chat_messages")
def drop_repeated_messages(spark, d):
    return chat.drop_repeats(_arrivals(spark, d).select("id", "seq"), "seq")


_SELECTION = f"""{FLAT_CHAT}, {_WITH_REPEATS},
waiting as (select participant_id as sender, id as session_id, status as session_status,
  case when candidates_text is null then [] else string_split(candidates_text, ',') end as candidates
  from chat_sessions where status in ('active', 'needs_user_selection')
  qualify row_number() over (partition by channel, participant_id order by last_activity_us desc, id) = 1),
picked as (select a.*, coalesce(session_status = 'needs_user_selection', false) as wants, session_status, session_id,
  coalesce(len(candidates), 0) as options,
  coalesce(session_status = 'needs_user_selection', false) and coalesce(list_contains(candidates, trim(coalesce(text, ''))), false) as reply_known
  from arrivals a left join waiting using (sender))"""


def _sessions(spark, d):
    s = build(spark, d, "chat_sessions")
    return s.withColumn("candidates", F.coalesce(F.split("candidates_text", ","), F.array().cast("array<string>")))


@query("J12 L5", f"""with {_SELECTION}
select id, seq, session_id, case when wants and options = 0 then null else wants end as pending, reply_known from picked""",
       "chat_messages chat_sessions")
def match_selection(spark, d):
    return chat.match_selection(_arrivals(spark, d), _sessions(spark, d)).select(
        "id", "seq", "session_id", "pending", "reply_known")


@query("P42 D6", f"""with {_SELECTION},
judged as (select *, seq > min(seq) over (partition by id) as duplicate,
  case conv_id % 5 when 0 then 'complete' when 1 then 'needs_better_photo' when 2 then 'session_rejected' else 'retryable_error' end as outcome
  from picked)
select id, seq, case when duplicate then 'duplicate' when conv_id % 17 = 0 then 'failed'
  when type = 'image' or (type = 'document' and lower(mime_type) in ('image/jpeg', 'image/png', 'image/webp')) then
    case when media_id = '' then 'missing_media_id'
      when lower(mime_type) not in ('image/jpeg', 'image/png', 'image/webp') then 'unsupported_image_mime'
      when outcome = 'session_rejected' then case session_status when 'complete' then 'completed' when 'active' then 'needs_better_photo' else 'session_closed' end
      when session_status = 'needs_user_selection' then 'needs_user_selection'
      when outcome = 'complete' then 'completed' when outcome = 'needs_better_photo' then 'needs_better_photo'
      else 'retryable_error' end
  when type = 'audio' then case when conv_id % 23 = 0 then 'transcriber_unavailable' when media_id = '' then 'missing_media_id'
    when conv_id % 7 = 0 then 'transcription_failed' when conv_id % 7 = 1 then 'empty_transcript' else 'completed' end
  when type = 'document' then 'unsupported_document_type'
  when type in ('text', 'interactive') then case when wants and options = 0 then null when not wants then 'completed'
    when reply_known then 'selection_resolved' else 'selection_invalid_reply' end end as status
from judged""", "chat_messages chat_sessions")
def processing_status(spark, d):
    c = F.col
    marked = chat.mark_repeats(_arrivals(spark, d), "seq")
    joined = chat.match_selection(marked, _sessions(spark, d))
    outcome = F.when(c("conv_id") % 5 == 0, "complete").when(c("conv_id") % 5 == 1, "needs_better_photo").when(
        c("conv_id") % 5 == 2, "session_rejected").otherwise("retryable_error")
    return joined.select("id", "seq", msg.processing_status(
        duplicate=c("duplicate"), route=msg.route_message(c("type"), c("mime_type")), media_id=c("media_id"),
        mime=c("mime_type"), failed=c("conv_id") % 17 == 0, outcome=outcome, session_status=c("session_status"),
        pending=c("pending"), reply_known=c("reply_known"), transcriber=c("conv_id") % 23 != 0,
        transcript=F.when(c("conv_id") % 7 == 1, "  ").when(c("conv_id") % 7 > 1, "hello")).alias("status"))


@query("P22 P23", """
select id, concat('97', conv_id % 50) as phone,
  case audio_mime when 'audio/ogg; codecs=opus' then '.ogg' when 'audio/mpeg' then '.mpeg' else '.bin' end as audio_suffix,
  case lower(image_mime) when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'image/webp' then '.webp' else '.bin' end as image_suffix
from chat_messages""", "chat_messages")
def phones_and_suffixes(spark, d):
    phone = F.concat(F.lit(" "), F.substring("sender", 1, 3), F.lit("-"), F.substring("sender", 4, 100))
    return build(spark, d, "chat_messages").select(
        "id", text.normalize_phone(phone).alias("phone"), text.audio_suffix(F.col("audio_mime")).alias("audio_suffix"),
        text.image_suffix(F.col("image_mime")).alias("image_suffix"))


@query("P41", f"""with {FLAT_CHAT}
select id, type, coalesce(text, '') <> '' as has_text, coalesce(media_id, '') <> '' as has_media_id, mime_type,
  coalesce(caption, '') <> '' as has_caption from flat_chat""", "chat_messages")
def redact_messages(spark, d):
    c = F.col
    return _flat_chat(spark, d).select(*[v.alias(k) for k, v in msg.redact_message(
        c("id"), c("type"), c("text"), c("media_id"), c("mime_type"), c("caption")).items()])


@query("P41", """
select doc_id, concat('f', doc_id, '.ogg') as filename, lang as content_type,
  cast(octet_length(encode(text)) as bigint) as audio_size_bytes, true as has_url, '.ogg' as target_suffix from documents""")
def redact_uploads(spark, d):
    t = build(spark, d, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".ogg"))
    audio = msg.redact_audio(name, F.col("lang"), F.col("text").cast("binary"))
    load = msg.redact_download(name, F.col("lang"), F.col("source"))
    return t.select("doc_id", audio["filename"].alias("filename"),
                    audio["content_type"].alias("content_type"),
                    audio["audio_size_bytes"].cast("long").alias("audio_size_bytes"),
                    load["has_url"].alias("has_url"), load["target_suffix"].alias("target_suffix"))


@query("P41", """
select conv_id, turn, audio_mime as mime_type, media_id <> '' as has_media_id, 'Whisper' as transcriber_type,
  concat('f', conv_id, '.OGG') as file_name, text <> '' as has_download_url, '.ogg' as source_suffix, image_mime as content_type from chat_messages""",
       "chat_messages")
def redact_transcriptions(spark, d):
    c, kind = F.col, F.lit("Whisper")
    name = F.concat(F.lit("f"), c("conv_id").cast("string"), F.lit(".OGG"))
    shown = msg.redact_voice(c("audio_mime"), c("media_id"), kind) | msg.redact_direct_download(name, c("audio_mime"), c("text"), kind)
    shown |= msg.redact_conversion(F.concat(F.lit("/tmp/"), name)) | {"content_type": msg.redact_scan(name, c("image_mime"))["content_type"]}
    return build(spark, d, "chat_messages").select("conv_id", "turn", *[v.alias(k) for k, v in shown.items()])


@query("P44", """
select doc_id, case doc_id % 5 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/webp' when 3 then 'image/heic' end as sniffed,
  case when doc_id % 3 = 2 then 'unsupported_image_type' when octet_length(encode(text)) + 12 > 2000 then 'image_too_large' else 'accepted' end as admission
from documents""")
def admit_uploads(spark, d):
    head = F.unhex(F.when(F.col("doc_id") % 5 == 0, "FFD8FFE00010000000000000").when(
        F.col("doc_id") % 5 == 1, "89504E470D0A1A0A00000000").when(
        F.col("doc_id") % 5 == 2, "524946460000000057454250").when(
        F.col("doc_id") % 5 == 3, "000000006674797068656963").otherwise("3C68746D6C3E000000000000"))
    content = F.concat(head, F.col("text").cast("binary"))
    kind = F.when(F.col("doc_id") % 3 == 0, "image/JPEG").when(F.col("doc_id") % 3 == 1, "image/webp").otherwise("text/html")
    return build(spark, d, "documents").select("doc_id", msg.sniff_image_type(content).alias("sniffed"),
                                               msg.admission(kind, content, 2000).alias("admission"))


# --- review queue ------------------------------------------------------------

_CANDIDATES = """
select concat('cand-', run_id) as id, run_id, session_id, source, image_ref, status, scanner_count, vision_count,
  recovery_attempted, recovery_labels_resolved, t_us as created_us
from domain_events where type = 'INGEST_COMPLETED' and (status in ('failed', 'needs_retry', 'needs_user_input')
  or scanner_count <> vision_count or (recovery_attempted and recovery_labels_resolved = 0))
qualify row_number() over (partition by run_id order by t_us, event_id) = 1"""


@query("S6 T5 P34", _CANDIDATES, "domain_events")
def review_candidates(spark, d):
    return review.candidates_from_events(build(spark, d, "domain_events"))


@query("K2 D5", f"""with fresh as ({_CANDIDATES})
select id, run_id, status, created_us from queue union all
select id, run_id, status, created_us from fresh where run_id not in (select run_id from queue)""", "domain_events queue")
def insert_candidates(spark, d):
    queue = build(spark, d, "queue").select("id", "run_id", "status", "created_us")
    batch = review.candidates_from_events(build(spark, d, "domain_events")).select(*queue.columns)
    return review.insert_candidates(queue, batch)[0]


@query("L1", "select id, run_id, created_us from queue where reviewed_us is null order by created_us desc, id", "queue")
def list_pending(spark, d):
    return review.list_pending(build(spark, d, "queue")).select("id", "run_id", "created_us")


@query("L2", "select id, run_id, reviewed_us from queue where reviewed_us is not null and not added_to_dataset order by reviewed_us desc, id", "queue")
def list_reviewed(spark, d):
    return review.list_reviewed(build(spark, d, "queue")).select("id", "run_id", "reviewed_us")


@query("J2 L1", """
select q.run_id, r.source, r.status as run_status, r.filename, r.scanner_count, r.vision_count, r.primary_issue
from queue q join runs r on r.id = q.run_id where q.reviewed_us is null order by q.created_us desc, q.run_id""", "queue runs")
def pending_annotations(spark, d):
    q = build(spark, d, "queue").select("run_id", "created_us", F.when(
        F.col("reviewed_us").isNull(), "pending").otherwise("reviewed").alias("status"))
    return review.pending_with_runs(q, build(spark, d, "runs")).drop("created_us", "status")


_FIRST_REVIEW = """first_review as (select * from reviews
  qualify row_number() over (partition by id order by reviewed_us, reviewed_by) = 1)"""


@query("K6", f"""with {_FIRST_REVIEW}
select q.id, coalesce(q.reviewed_us, f.reviewed_us, -1) as reviewed_us, coalesce(q.reviewed_by, f.reviewed_by) as reviewed_by,
  coalesce(q.expected_outcome, f.expected_outcome) as expected_outcome from queue q left join first_review f using (id)""", "queue reviews")
def apply_review(spark, d):
    after = review.apply_review(build(spark, d, "queue"), build(spark, d, "reviews"))[0]
    return after.select("id", F.coalesce("reviewed_us", F.lit(-1)).alias("reviewed_us"), "reviewed_by", "expected_outcome")


@query("K6", f"""with {_FIRST_REVIEW}
select r.id, r.reviewed_us, q.id is not null and f.id is not null as accepted
from reviews r left join (select id from queue where reviewed_us is null) q using (id)
left join first_review f on f.id = r.id and f.reviewed_us = r.reviewed_us and f.reviewed_by = r.reviewed_by""", "queue reviews")
def review_verdicts(spark, d):
    return review.apply_review(build(spark, d, "queue"), build(spark, d, "reviews"))[1].select("id", "reviewed_us", "accepted")


@query("K6b", """
with last_review as (select * from reviews qualify row_number() over (partition by run_id order by reviewed_us desc, reviewed_by) = 1)
select q.run_id, coalesce(l.reviewed_us, q.reviewed_us, -1) as reviewed_us, coalesce(l.reviewed_by, q.reviewed_by) as reviewed_by,
  case when l.run_id is not null or q.reviewed_us is not null then 'reviewed' else 'pending' end as status
from queue q left join last_review l using (run_id)""", "queue reviews")
def apply_review_overwrite(spark, d):
    a = build(spark, d, "queue").select("run_id", "reviewed_us", "reviewed_by", "expected_outcome", F.when(
        F.col("reviewed_us").isNull(), "pending").otherwise("reviewed").alias("status"))
    after = review.apply_review_overwrite(a, build(spark, d, "reviews"))
    return after.select("run_id", F.coalesce("reviewed_us", F.lit(-1)).alias("reviewed_us"), "reviewed_by", "status")


@query("K7", """
select q.id, q.added_to_dataset or (r.id is not null) as added_to_dataset
from queue q left join (select distinct id from reviews) r using (id)""", "queue reviews")
def mark_exported(spark, d):
    return review.mark_exported(build(spark, d, "queue"), build(spark, d, "reviews")).select("id", "added_to_dataset")


@query("A13", """
select count(*) filter (reviewed_us is null) as pending,
  count(*) filter (reviewed_us is not null and not added_to_dataset) as reviewed,
  count(*) filter (added_to_dataset) as exported, count(*) as total from queue""", "queue")
def queue_stats(spark, d):
    return review.queue_stats(build(spark, d, "queue"))


_EXPORT = """
exported as (select q.id, q.run_id, concat('annotation_', q.run_id, '.jpg') as image, e.box_no,
  case when e.run_id is not null then coalesce(e.value, '') end as value,
  case when e.run_id is not null then coalesce(e.format, 'Code128') end as format,
  case when e.run_id is not null then 'decoded' end as box_status
from queue q left join expected_codes e using (run_id)
where q.reviewed_us is not null and not q.added_to_dataset and q.image_ref in (select path from inventory))"""


def _export(spark, d):
    return review.export_entries(build(spark, d, "queue"), build(spark, d, "expected_codes"), build(spark, d, "inventory"))


@query("K8 J8", f"with {_EXPORT} select id, run_id, image, coalesce(box_no, 0) as box_no, value, format, box_status from exported",
       "queue expected_codes inventory")
def export_entries(spark, d):
    return _export(spark, d).select("id", "run_id", "image", F.coalesce("box_no", F.lit(0)).alias("box_no"), "value", "format", "box_status")


@query("A14", f"""with {_EXPORT}
select count(distinct image) as image_count, count(box_status) as expected_barcode_symbol_count,
  count(*) filter (box_status = 'decoded') as expected_decoded_count from exported""", "queue expected_codes inventory")
def dataset_summary(spark, d):
    return review.dataset_summary(_export(spark, d))


@query("J8", "select id, image_ref from queue where image_ref in (select path from inventory)", "queue inventory")
def with_existing_image(spark, d):
    return review.with_existing_image(build(spark, d, "queue"), build(spark, d, "inventory")).select("id", "image_ref")


@query("L8", "select id, run_id, status from queue where id = 'cand-8'", "queue")
def candidate_by_id(spark, d):
    return tables.by_id(build(spark, d, "queue"), "cand-8").select("id", "run_id", "status")


@query("S8 D2", """
select run_id, box_no, expected_barcode_symbol_count, expected_decoded_count, expected_unique_values
from (select run_id, box_no, 4 as expected_barcode_symbol_count,
  2 + case when box_no % 3 <> 0 then 1 else 0 end as expected_decoded_count,
  array_to_string(list_sort(list_distinct(list_filter(
    [value, 'b', case when box_no % 3 <> 0 then concat('a', box_no) end], lambda x: x is not null))), ',') as expected_unique_values
  from expected_codes) b""", "expected_codes")
def ground_truth_examples(spark, d):
    """Documents of one image each, read as expected values and counts."""
    from boxtally.sources.ground_truth import examples

    def box(status, value):
        return F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
                        value.alias("value"), F.lit("Code128").alias("format"))

    third = F.when(F.col("box_no") % 3 != 0, "decoded").otherwise("unreadable")
    boxes = F.array(box("decoded", F.col("value")), box("decoded", F.lit("b")),
                    box(third, F.concat(F.lit("a"), F.col("box_no").cast("string"))), box("unreadable", F.lit("z")))
    image = F.struct(F.concat_ws("/", "run_id", F.col("box_no").cast("string")).alias("image"),
                     F.size(boxes).alias("expected_barcode_symbol_count"), boxes.alias("boxes"))
    out = examples(build(spark, d, "expected_codes").select(F.array(image).alias("images")))
    return out.select(F.split_part("image", F.lit("/"), F.lit(1)).alias("run_id"),
                      F.split_part("image", F.lit("/"), F.lit(2)).cast("int").alias("box_no"),
                      "expected_barcode_symbol_count", "expected_decoded_count",
                      F.array_join("expected_unique_values", ",").alias("expected_unique_values"))


# --- evaluation --------------------------------------------------------------

_VALUES = "select image_id, cast(7290000000000 + part as varchar) as value from label_boxes where part % 6 <> 0"


def _expected_values(spark, d):
    t = build(spark, d, "label_boxes").filter("part % 6 <> 0")
    return t.select("image_id", F.expr("cast(7290000000000 + part as string)").alias("value"))


def _found_values(spark, d):
    return inputs.raw_detections(spark, d).select("image_id", "value")


_SCORES = f"""
want as (select distinct image_id, value from ({_VALUES}) w),
score as (select i.image_id, coalesce(e.n, 0) as expected, coalesce(h.n, 0) as hits, coalesce(f.n, 0) as found, coalesce(f.m, 0) as matching
  from images i left join (select image_id, count(*) as n from want group by 1) e using (image_id)
  left join (select image_id, count(*) as n from want where (image_id, value) in (select (image_id, value) from raw_detections) group by 1) h using (image_id)
  left join (select r.image_id, count(*) as n, count(w.value) as m from raw_detections r left join want w on w.image_id = r.image_id and w.value = r.value group by 1) f using (image_id)),
scored as (select *, case when expected = 0 then 1e0 else hits / (expected * 1e0) end as value_recall,
  case when found = 0 then 1e0 else matching / (found * 1e0) end as value_precision from score)"""


@query("A9 A10 D1 J10", f"with {_SCORES} select * from scored", "images label_boxes raw_detections")
def value_scores(spark, d):
    return evaluate.value_scores(_expected_values(spark, d), _found_values(spark, d), inputs.images(spark, d))


@query("A9 D1", f"""select distinct image_id, value from ({_VALUES}) w
where not exists (select 1 from raw_detections r where r.image_id = w.image_id and r.value = w.value)""", "label_boxes raw_detections")
def missing_values(spark, d):
    return evaluate.missing_values(_expected_values(spark, d), _found_values(spark, d))


_EXPECTED_RUN = "select *, 'complete' as expected_outcome, vision_count as expected_decoded_count from runs"


def _expected_runs(spark, d):
    return build(spark, d, "runs").withColumns(
        {"expected_outcome": F.lit("complete"), "expected_decoded_count": F.col("vision_count")})


@query("A11 J10", f"""
select id, case when status = expected_outcome then 1e0 else 0e0 end as outcome_correct,
  case when found_count = expected_decoded_count then 1e0 else 0e0 end as count_exact,
  case when not recovery_attempted or recovery_labels_resolved > 0 then 1e0 else 0e0 end as recovery_gain,
  case when latency_ms <= 10000 then 1e0 else 0e0 end as latency_ok from ({_EXPECTED_RUN}) r""", "runs")
def run_scores(spark, d):
    return evaluate.run_scores(_expected_runs(spark, d)).select(
        "id", "outcome_correct", "count_exact", "recovery_gain", "latency_ok")


@query("A12", f"""with {_SCORES},
m as (select cast(sum(cast(round(value_recall * 1e9) as bigint)) as bigint) / (count(*) * 1e0) / 1e9 as mean_recall,
  cast(sum(cast(round(value_precision * 1e9) as bigint)) as bigint) / (count(*) * 1e0) / 1e9 as mean_precision,
  count(*) filter (r.status = 'complete') / (count(*) * 1e0) as outcome_accuracy
  from scored s join runs r on r.id = cast(s.image_id as varchar))
select *, case when mean_recall >= 0.90 and mean_precision >= 0.95 and outcome_accuracy >= 0.80 then 1e0 else 0e0 end as score from m""",
       "images label_boxes raw_detections runs")
def aggregate_thresholds(spark, d):
    runs = evaluate.run_scores(_expected_runs(spark, d)).select(F.col("id").cast("long").alias("image_id"), "outcome_correct")
    values = evaluate.value_scores(_expected_values(spark, d), _found_values(spark, d), inputs.images(spark, d))
    return evaluate.aggregate_thresholds(values.join(runs, "image_id"))


_BENCH = f"""
bench_cand as (select e.image_id, sqrt((ex - dx) * (ex - dx) + (ey - dy) * (ey - dy)) as distance, label_index, det_index, 'expected' as basis, value
  from (select *, (x1 + x2) / 2e0 as ex, (y1 + y2) / 2e0 as ey from (select image_id, label_index, x1, y1, x2, y2 from expected_symbols) x) e
  join (select image_id, det_index, value, (x1 + x2) / 2e0 as dx, (y1 + y2) / 2e0 as dy from detection_boxes) t
    on t.image_id = e.image_id and dx between x1 - 25 and x2 + 25 and dy between y1 - 25 and y2 + 25),
{greedy_cte('bench', 'bench_cand')},
judged as (select b.image_id, count(*) as matched, count(*) filter (state = 'decoded' and e.value = b.value) as exact,
  count(*) filter (state = 'decoded' and e.value <> b.value) as mismatches, count(*) filter (state <> 'decoded') as bonus
  from bench b join expected_symbols e using (image_id, label_index) group by 1),
per_image as (select i.image_id, coalesce(w.symbols, 0) as symbols, coalesce(w.decoded, 0) as decoded, coalesce(f.n, 0) as found,
  coalesce(j.exact, 0) as exact, coalesce(j.mismatches, 0) as mismatches, coalesce(j.bonus, 0) as bonus,
  coalesce(w.u, 0) as unique_expected, coalesce(h.n, 0) as unique_found,
  coalesce(f.n, 0) - coalesce(j.matched, 0) + coalesce(j.mismatches, 0) as false_positives
  from images i left join (select image_id, count(*) as symbols, count(*) filter (state = 'decoded') as decoded,
    count(distinct value) filter (state = 'decoded') as u from expected_symbols group by 1) w using (image_id)
  left join (select image_id, count(*) as n from detection_boxes group by 1) f using (image_id)
  left join judged j using (image_id)
  left join (select image_id, count(distinct value) as n from expected_symbols s where state = 'decoded' and exists (
    select 1 from detection_boxes d where d.image_id = s.image_id and d.value = s.value) group by 1) h using (image_id))"""


def _bench(spark, d):
    t = build(spark, d, "expected_symbols")
    from boxtally.functions.geometry import box
    expected = t.select("image_id", "label_index", box("x1", "y1", "x2", "y2").alias("box"), "state", "value")
    return evaluate.symbol_benchmark(expected, inputs.detections(spark, d), inputs.images(spark, d))


@query("A15", f"with {_BENCH} select * from per_image", "images detection_boxes expected_symbols", recursive=True)
def symbol_benchmark(spark, d):
    return _bench(spark, d)


@query("A15", f"""with {_BENCH},
t as (select {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in ('symbols', 'decoded', 'found', 'exact', 'mismatches', 'bonus', 'unique_expected', 'unique_found', 'false_positives'))} from per_image)
select *, exact = decoded and false_positives = 0 and mismatches = 0 and unique_found = unique_expected as passed from t""",
       "images detection_boxes expected_symbols", recursive=True)
def benchmark_gate(spark, d):
    return evaluate.benchmark_gate(_bench(spark, d))


@query("A15 A5", """
select o_custkey as image_id, coalesce(max(latency_ms) filter (run_no = 1), -1) as first_ms,
  coalesce(quantile_cont(latency_ms, 0.5) filter (run_no > 1), 0e0) as median_ms,
  coalesce(cast(quantile_disc(latency_ms, 0.95) filter (run_no > 1 and latency_ms > 0) as double), 0e0) as p95_ms
from (select o_custkey, cast(o_orderkey % 10 + 1 as int) as run_no, cast(cast(floor(o_totalprice) as bigint) % 20000 as int) as latency_ms from orders) t
group by 1""")
def benchmark_latency(spark, d):
    t = build(spark, d, "orders").selectExpr(
        "o_custkey as image_id", "cast(o_orderkey % 10 + 1 as int) as run_no",
        "cast(cast(floor(o_totalprice) as bigint) % 20000 as int) as latency_ms")
    return evaluate.benchmark_latency(t).select("image_id", F.coalesce("first_ms", F.lit(-1)).alias("first_ms"),
                                                F.coalesce("median_ms", F.lit(0.0)).alias("median_ms"), "p95_ms")


_SPATIAL = f"""
spatial_cand as (select t.image_id, sqrt((tx - gx) * (tx - gx) + (ty - gy) * (ty - gy)) as distance, t.label_index, det_index,
    'expected' as basis, cast(null as varchar) as value
  from (select *, (x1 + x2) / 2e0 as tx, (y1 + y2) / 2e0 as ty from (select image_id, label_index, x1, y1, x2, y2 from expected_symbols) x) t
  join (select image_id, label_index as det_index, (lx1 + lx2) / 2e0 as gx, (ly1 + ly2) / 2e0 as gy from label_boxes) l
    on l.image_id = t.image_id and gx between x1 - 25 and x2 + 25 and gy between y1 - 25 and y2 + 25),
{greedy_cte('spatial', 'spatial_cand')}"""


@query("A16", f"""with {_SPATIAL}
select image_id, truth_index, label_index, sqrt(((tx - gx) / 3000) * ((tx - gx) / 3000) + ((ty - gy) / 4000) * ((ty - gy) / 4000)) as center_distance,
  s / (a + b - s) as iou, gx between x1 and x2 and gy between y1 and y2 as center_inside
from (select m.image_id, m.label_index as truth_index, l.label_index, e.x1, e.x2, e.y1, e.y2,
  (x1 + x2) / 2e0 as tx, (y1 + y2) / 2e0 as ty, (lx1 + lx2) / 2e0 as gx, (ly1 + ly2) / 2e0 as gy,
  greatest(0, least(x2, lx2) - greatest(x1, lx1)) * greatest(0, least(y2, ly2) - greatest(y1, ly1)) * 1e0 as s,
  (x2 - x1) * (y2 - y1) as a, (lx2 - lx1) * (ly2 - ly1) as b
  from spatial m join expected_symbols e on e.image_id = m.image_id and e.label_index = m.label_index
  join label_boxes l on l.image_id = m.image_id and l.label_index = m.det_index) p""", "expected_symbols label_boxes", recursive=True)
def spatial_benchmark(spark, d):
    from boxtally.functions.geometry import box
    truth = build(spark, d, "expected_symbols").select(
        "image_id", F.col("label_index").alias("truth_index"), box("x1", "y1", "x2", "y2").alias("truth_box"))
    labels = inputs.labels(spark, d)
    return evaluate.spatial_benchmark(truth, labels, evaluate.spatial_matches(truth, labels), inputs.images(spark, d))


@query("A16", """
with n as (select i.image_id, coalesce(e.n, 0) as expected, coalesce(s.n, 0) as seen, coalesce(o.n, 0) as o, coalesce(w.n, 0) as w from images i
  left join (select image_id, count(*) as n from expected_symbols where state = 'decoded' group by 1) e using (image_id)
  left join (select image_id, count(*) as n from label_boxes group by 1) s using (image_id)
  left join (select image_id, count(*) as n from label_boxes where supp % 7 = 0 group by 1) o using (image_id)
  left join (select image_id, count(*) as n from expected_symbols where state <> 'decoded' group by 1) w using (image_id))
select image_id, expected, seen, expected = seen as count_correct, o = w as unmatched_correct, greatest(seen - expected, 0) as extra_labels from n""",
       "images expected_symbols label_boxes")
def label_count_accuracy(spark, d):
    t, l = build(spark, d, "expected_symbols"), build(spark, d, "label_boxes")
    return evaluate.label_count_accuracy(t.filter("state = 'decoded'"), l, inputs.images(spark, d),
                                         l.filter("supp % 7 = 0"), t.filter("state <> 'decoded'"))


# --- table maintenance -------------------------------------------------------

@query("S1 K1 D7", """
select id, source, status from runs where cast(id as bigint) % 2 = 0
union all
select id, 'retry', 'pending' from runs where cast(id as bigint) % 3 = 0 and cast(id as bigint) % 2 <> 0""", "runs")
def insert_if_absent(spark, d):
    runs = build(spark, d, "runs").select("id", "source", "status")
    k = F.col("id").cast("long")
    batch = runs.filter(k % 3 == 0).withColumns({"source": F.lit("retry"), "status": F.lit("pending"), "seq": k})
    batch = batch.unionByName(batch.withColumns({"seq": F.col("seq") + 1, "source": F.lit("later")}))
    return tables.insert_if_absent(runs.filter(k % 2 == 0), batch, ["id"], ["seq"])


# What a completion overwrites, and the value that the results of the query bring.
_COMPLETED_SQL = {
    "status": "'complete'", "scanner_count": "vision_count", "vision_count": "vision_count", "scanner_vision_match": "true",
    "count_delta": "0", "found_count": "vision_count", "missing_count": "0", "unassigned_count": "0",
    "recovery_attempted": "true", "recovery_labels_tried": "2", "recovery_barcodes_found": "3",
    "recovery_labels_resolved": "1", "recovery_succeeded": "true", "latency_ms": "1234",
    "primary_issue": "cast(null as varchar)", "issue_count": "0", "error_code": "cast(null as varchar)",
    "error_message": "cast(null as varchar)", "pipeline_version": "'ingest-v9'", "scanner_version": "'scanner-9'",
    "vision_prompt_version": "'prompt-9'", "vision_model": "'vision-9'", "recovery_version": "'recovery-v9'"}


@query("K3", f"""
select id, {", ".join(f"case when hit then {v} else {c} end as {c}" for c, v in _COMPLETED_SQL.items())},
  case when hit and cast(id as bigint) % 4 <> 0 then 1600 else image_width end as image_width,
  case when hit then timestamp '2002-01-01 00:00:00' else processed_at end as processed_at
from (select *, cast(id as bigint) % 3 = 0 as hit from runs) r""", "runs")
def apply_completion(spark, d):
    runs = build(spark, d, "runs")
    k = F.col("id").cast("long")
    done = runs.filter(k % 3 == 0).withColumns({
        c: F.expr(v.replace("varchar", "string")).cast(runs.schema[c].dataType) for c, v in _COMPLETED_SQL.items()})
    done = done.withColumn("image_width", F.when(k % 4 == 0, 0).otherwise(1600))
    after = tables.apply_completion(runs, done, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))
    return after.select("id", *_COMPLETED_SQL, "image_width", "processed_at")


@query("K4", """
select id, case when hit then 'failed' else status end as status, case when hit then 'TimeoutError' else error_code end as error_code,
  case when hit then repeat('x', 500) else error_message end as error_message, case when hit then repeat('x', 600) end as error_detail from (
  select *, cast(id as bigint) % 5 = 0 as hit from runs) r""", "runs")
def apply_failure(spark, d):
    runs = build(spark, d, "runs")
    failures = runs.filter(F.col("id").cast("long") % 5 == 0).select(
        "id", F.lit("TimeoutError").alias("error_class"), F.expr("repeat('x', 600)").alias("error_text"))
    runs = runs.withColumn("error_detail", F.lit(None).cast("string"))
    return tables.apply_failure(runs, failures, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")).select(
        "id", "status", "error_code", "error_message", "error_detail")


@query("S5 K5", """
with patch as (select id, case when k % 2 = 0 then 'complete' end as status, case when k % 4 = 0 then null else 8 end as found_count,
  case when k % 6 = 0 then 'hello' end as message from (select *, cast(substr(id, 2) as bigint) as k from sessions) x where k % 3 = 0)
select s.id, coalesce(p.status, s.status) as status, coalesce(p.found_count, s.found_count) as found_count,
  coalesce(p.message, s.message) as message,
  case when p.status is not null or p.found_count is not null or p.message is not null then 99 else s.updated_at end as updated_at,
  case when p.status = 'complete' then 99 else -1 end as completed_at from sessions s left join patch p using (id)""", "sessions")
def apply_partial_update(spark, d):
    s = build(spark, d, "sessions")
    k = F.substring("id", 2, 30).cast("long")
    patch = s.filter(k % 3 == 0).select(
        "id", F.when(k % 2 == 0, "complete").alias("status"), F.when(k % 4 != 0, 8).alias("found_count"),
        F.when(k % 6 == 0, "hello").alias("message"))
    after = tables.apply_partial_update(s, patch, F.lit(99).cast("long"))
    return after.select("id", "status", "found_count", "message", "updated_at", F.coalesce("completed_at", F.lit(-1)).alias("completed_at"))


@query("T3", """
select id, case when hit and status in ('active', 'complete') then 'closed' else status end as status,
  case when hit and status in ('active', 'complete') then 99 else -1 end as closed_at
from (select *, cast(substr(id, 2) as bigint) % 4 = 0 as hit from sessions) s""", "sessions")
def close_sessions(spark, d):
    s = build(spark, d, "sessions")
    ids = s.filter(F.substring("id", 2, 30).cast("long") % 4 == 0).select("id")
    return tables.close_sessions(s, ids, F.lit(99).cast("long")).select(
        "id", "status", F.coalesce("closed_at", F.lit(-1)).alias("closed_at"))


@query("S4 K9", """
select s.id as session_id, customer_id, branch_id, action, i.line_id, i.barcode_value
from sessions s join session_items i on i.session_id = s.id
where s.status = 'complete' and cast(substr(s.id, 2) as bigint) % 3 <> 0""", "sessions session_items")
def create_orders(spark, d):
    """Order lines still to be written: sessions with a stored order are left out."""
    s = build(spark, d, "sessions")
    stored = s.filter(F.substring("id", 2, 30).cast("long") % 3 == 0).select(F.col("id").alias("session_id"))
    lines = tables.orders_of_complete_sessions(s, build(spark, d, "session_items"))
    return lines.join(stored, "session_id", "left_anti").select(
        "session_id", "customer_id", "branch_id", "action", "line_id", "barcode_value")


@query("K9", """
with lines as (select session_id, line_id, barcode_value, label_index, row_number() over (partition by session_id order by line_id) - 1 as place from session_items)
select s.id as session_id, customer_id, branch_id, action, coalesce(place // 2, 0) as block, 'created' as status,
  coalesce(string_agg(concat(place, ':', barcode_value), ',' order by place) filter (l.session_id is not null), '') as items
from sessions s left join lines l on l.session_id = s.id
where s.status = 'complete' and cast(substr(s.id, 2) as bigint) % 3 <> 0 group by all""", "sessions session_items")
def order_rows(spark, d):
    """Order rows with their items, in blocks of two; sessions with a stored order are left out."""
    s = build(spark, d, "sessions")
    stored = s.filter(F.substring("id", 2, 30).cast("long") % 3 == 0).select(F.col("id").alias("session_id"))
    orders = tables.new_orders(s, build(spark, d, "session_items"), stored, block=2)
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["place"].cast("string"), i["barcode_value"])), ",")
    return orders.withColumn("items", text)


@query("K11", "select session_id, line_id from session_missing where session_id not in (select id from sessions where status = 'complete')",
       "sessions session_missing")
def clear_missing(spark, d):
    gone = build(spark, d, "sessions").filter("status = 'complete'").select("id")
    return tables.without_keys(build(spark, d, "session_missing"), gone, "session_id").select("session_id", "line_id")


@query("K12", """
select 'sessions' as part, count(*) as rows from sessions where status <> 'expired'
union all select 'items', count(*) from session_items where session_id not in (select id from sessions where status = 'expired')
union all select 'missing', count(*) from session_missing where session_id not in (select id from sessions where status = 'expired')""",
       "sessions session_items session_missing")
def cascade_delete(spark, d):
    s = build(spark, d, "sessions")
    left = tables.cascade_delete(s, {
        "items": (build(spark, d, "session_items"), "session_id"),
        "missing": (build(spark, d, "session_missing"), "session_id")}, s.filter("status = 'expired'").select("id"))
    parts = [left[k].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows")
             for k, n in (("parents", "sessions"), ("items", "items"), ("missing", "missing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("D3", """
select id, provider_message_id, provider_message_id is null or row_number() over (
  partition by provider_message_id order by created_at, id) = 1 as accepted from runs""", "runs")
def unique_provider_messages(spark, d):
    runs = build(spark, d, "runs").select("id", "provider_message_id", "created_at")
    good, bad = tables.split_unique(runs, "provider_message_id", ["created_at", "id"])
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).drop("created_at")


@query("D4", """
select session_id, line_id, coalesce(label_index, -1) as label_index from session_items
qualify label_index is null or row_number() over (partition by session_id, source_image, label_index order by line_id, tie) = 1""", "session_items")
def first_item_per_label(spark, d):
    return tables.first_item_per_label(build(spark, d, "session_items"), ["line_id", "tie"]).select(
        "session_id", "line_id", F.coalesce("label_index", F.lit(-1)).alias("label_index"))


@query("J6", """
select session_id, barcode_value, min(line_id) as line_id from session_items i where source_image > 0 and not exists (
  select 1 from session_items k where k.source_image = 0 and k.session_id = i.session_id and k.barcode_value = i.barcode_value)
group by 1, 2""", "session_items")
def new_codes(spark, d):
    items = build(spark, d, "session_items")
    return tables.new_codes(items.filter("source_image > 0"), items.filter("source_image = 0"), ["line_id"]).select(
        "session_id", "barcode_value", "line_id")


@query("J7", """
with lines as (select session_id, line_id, 'item' as kind, label_index, barcode_value from session_items
  union all select session_id, line_id, 'missing', label_index, null from session_missing where not resolved)
select s.id as session_id, s.status, coalesce(line_id, -1) as line_id, kind, coalesce(label_index, -1) as label_index, barcode_value
from sessions s left join lines l on l.session_id = s.id""", "sessions session_items session_missing")
def session_lines(spark, d):
    lines = tables.session_lines(*[build(spark, d, t) for t in ("sessions", "session_items", "session_missing")])
    return lines.select("session_id", "status", F.coalesce("line_id", F.lit(-1)).alias("line_id"), "kind",
                        F.coalesce("label_index", F.lit(-1)).alias("label_index"), "barcode_value")


@query("J7 S5", """
with lines as (select session_id, line_id, 0 as k, coalesce(barcode_value, '') as text from session_items
  union all select session_id, line_id, 1, concat('#', label_index) from session_missing where not resolved),
placed as (select *, row_number() over (partition by session_id order by k, line_id) - 1 as place from lines)
select s.id as session_id, s.status, coalesce(place // 3, 0) as block,
  coalesce(string_agg(case when k = 0 then concat(place, ':', text) end, ',' order by place), '') as items,
  coalesce(string_agg(case when k = 1 then concat(place, ':', text) end, ',' order by place), '') as missing
from sessions s left join placed p on p.session_id = s.id group by all""", "sessions session_items session_missing")
def session_results(spark, d):
    """Nested results of all sessions, in blocks of three lines."""
    nested = tables.session_result(*[build(spark, d, t) for t in ("sessions", "session_items", "session_missing")], block=3)

    def told(column, value):
        return F.coalesce(F.array_join(F.transform(column, lambda e: F.concat_ws(":", e["place"].cast("string"), value(e))), ","), F.lit(""))

    return nested.select(
        "session_id", "status", "block", told("items", lambda e: F.coalesce(e["barcode_value"], F.lit(""))).alias("items"),
        told("missing", lambda e: F.concat(F.lit("#"), e["label_index"].cast("string"))).alias("missing"))


@query("L4", "select id, name from customers where active", "customers")
def active_customers(spark, d):
    return tables.active_customers(build(spark, d, "customers"))


@query("J3 S4", """
select b.customer_id, b.id, b.name from branches b join customers c on c.id = b.customer_id where b.active and c.active""", "customers branches")
def active_branches(spark, d):
    return tables.active_branches(build(spark, d, "branches"), build(spark, d, "customers"))


@query("L5", """
select channel, participant_id, id, status from sessions where status in ('active', 'needs_user_selection')
qualify row_number() over (partition by channel, participant_id order by last_activity_at desc, id) = 1""", "sessions")
def latest_open_session(spark, d):
    s = build(spark, d, "sessions").withColumnRenamed("last_activity_at", "last_activity_us")
    return chat.latest_open_sessions(s).select("channel", "participant_id", "id", "status")


@query("L8", "select id, status from sessions where id = 's42'", "sessions")
def session_by_id(spark, d):
    return tables.by_id(build(spark, d, "sessions"), "s42").select("id", "status")


@query("S3", """
select id, run_id, case when recovery_attempted then 1 else 0 end = 1 as recovery_attempted, added_to_dataset from queue""", "queue")
def stored_queue(spark, d):
    """The queue as its store keeps it, read back through the casts."""
    from boxtally.sources.tables import append_table, read_queue

    root = scratch_path(spark, "queue")
    q = build(spark, d, "queue")
    append_table(q.withColumns({c: F.col(c).cast("int") for c in ("recovery_attempted", "added_to_dataset")}),
                 root, "annotation_candidates")
    return read_queue(spark, root).select("id", "run_id", "recovery_attempted", "added_to_dataset")


@query("S1 P45", """
select id, source, status from runs where created_at >= timestamp '2001-07-25 00:00:00'""", "runs")
def stored_runs_window(spark, d):
    """Runs written to the store, read back through a time window."""
    from boxtally.sources.tables import runs_since, write_table

    root = scratch_path(spark, "store")
    write_table(build(spark, d, "runs"), root, "runs")
    return runs_since(spark, root, "2001-07-25 00:00:00").select("id", "source", "status")


# --- quality -----------------------------------------------------------------

@query("Q1", """
select image_id, det_index, case when bx2 < x1 and by2 < y1 then 'x_order,y_order' when bx2 < x1 then 'x_order' else 'y_order' end as violations
from (select image_id, det_index, x1, y1, case when det_index % 4 = 1 then x1 - 5 else x2 end as bx2,
  case when det_index % 6 = 1 then y1 - 5 else y2 end as by2 from detection_boxes) d where bx2 < x1 or by2 < y1""", "detection_boxes")
def pixel_box_violations(spark, d):
    from boxtally.functions.geometry import box
    t = build(spark, d, "detection_boxes")
    b = box(F.col("x1"), F.col("y1"), F.when(F.col("det_index") % 4 == 1, F.col("x1") - 5).otherwise(F.col("x2")),
            F.when(F.col("det_index") % 6 == 1, F.col("y1") - 5).otherwise(F.col("y2")))
    bad = quality.broken_rows(t.select("image_id", "det_index", b.alias("b")), quality.pixel_box_rules(F.col("b")))
    return bad.select("image_id", "det_index", F.array_join("violations", ",").alias("violations"))


@query("Q2", """
with v as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  list_filter([case when not (t between 0 and 1000) then 'top_range' end, case when not (l between 0 and 1000) then 'left_range' end,
    case when not (b between 0 and 1000) then 'bottom_range' end, case when not (r between 0 and 1000) then 'right_range' end,
    case when b <= t then 'vertical_order' end, case when r <= l then 'horizontal_order' end], lambda x: x is not null) as broken
  from (select *, l_partkey % 1100 as l, l_suppkey % 1100 - 5 as t, l_partkey % 900 + 50 as r, l_suppkey % 90 as b from lineitem) n)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(broken, ',') as violations from v where len(broken) > 0""")
def normalized_box_violations(spark, d):
    b = F.expr("named_struct('top', l_suppkey % 1100 - 5, 'left', l_partkey % 1100, 'bottom', l_suppkey % 90, 'right', l_partkey % 900 + 50)")
    bad = quality.broken_rows(build(spark, d, "lineitem").withColumn("b", b), quality.normalized_box_rules(F.col("b")))
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("violations", ",").alias("violations"))


@query("Q3", """
with v as (select id, list_filter([case when least(boxes, visible, clear, without) < 0 then 'not_negative' end,
    case when visible > boxes then 'visible_within_boxes' end, case when clear > visible then 'clear_within_visible' end,
    case when without > boxes then 'without_within_boxes' end], lambda x: x is not null) as broken
  from (select id, vision_count as boxes, scanner_count + 1 as visible, found_count as clear, vision_count - found_count - 1 as without from runs) a)
select id, array_to_string(broken, ',') as violations from v where len(broken) > 0""", "runs")
def audit_violations(spark, d):
    c = F.col
    bad = quality.broken_rows(build(spark, d, "runs"), quality.audit_rules(
        c("vision_count"), c("scanner_count") + 1, c("found_count"), c("vision_count") - c("found_count") - 1))
    return bad.select("id", F.array_join("violations", ",").alias("violations"))


@query("Q5 Q4", """
select id, case when bad and k < 1 then 'run_status,label_index_from_one' when bad then 'run_status' else 'label_index_from_one' end as violations
from (select id, cast(id as bigint) % 13 = 0 as bad, cast(id as bigint) % 7 as k from runs) r where bad or k < 1""", "runs")
def enum_violations(spark, d):
    k = F.col("id").cast("long")
    rows = build(spark, d, "runs").select("id", F.when(k % 13 == 0, "done").otherwise(F.col("status")).alias("status"), (k % 7).alias("k"))
    bad = quality.broken_rows(rows, quality.enum_rule(F.col("status"), "run_status") | quality.label_rules(F.col("k")))
    return bad.select("id", F.array_join("violations", ",").alias("violations"))


@query("Q6", """
select branch_id, id from sessions where branch_id not in (select id from branches)""", "sessions branches")
def orphan_branches(spark, d):
    return quality.orphans(build(spark, d, "sessions").select("id", "branch_id"), "branch_id", build(spark, d, "branches"), "id")


@query("Q7", """
select doc_id, case when n > 2000 and blank then 'customer_required,comment_length' when blank then 'customer_required' else 'comment_length' end as violations
from (select doc_id, length(text) as n, doc_id % 10 = 0 as blank from documents) d where n > 2000 or blank""")
def context_violations(spark, d):
    t = build(spark, d, "documents")
    customer = F.when(F.col("doc_id") % 10 == 0, "  ").otherwise("c1")
    rules = quality.order_context_rules(customer, F.lit("b1"), F.lit("create_order")) | quality.feedback_rules(F.col("text"))
    return quality.broken_rows(t.select("doc_id", "text"), rules).select("doc_id", F.array_join("violations", ",").alias("violations"))
