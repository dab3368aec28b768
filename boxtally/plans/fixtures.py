"""Domain tables projected from the given tables.

The texts use the part of SQL that Spark and DuckDB share, so the same text
builds the table in Spark (:func:`build`) and in the oracle (:func:`cte`).
``{name}`` stands for a given table or for another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

IMAGE_WIDTH, IMAGE_HEIGHT = 3000, 4000

DERIVED: dict[str, str] = {}

DERIVED["line_counts"] = """
select l_orderkey, cast(count(*) as int) as vc,
       cast(sum(case when l_suppkey % 7 <> 0 then 1 else 0 end) as int) as sc
from {lineitem} group by l_orderkey
"""

# One processed photo per order.
DERIVED["runs"] = """
select id, trace_id, session_id, name, source, endpoint, status, filename, image_ref,
  upload_bytes, image_width, image_height, scanner_count, vision_count,
  scanner_count = vision_count as scanner_vision_match,
  vision_count - scanner_count as count_delta,
  found_count, vision_count - found_count as missing_count, unassigned_count,
  vision_count > scanner_count as recovery_attempted,
  case when vision_count > scanner_count then vision_count - scanner_count else 0 end
    as recovery_labels_tried,
  case when vision_count > scanner_count then resolved + k % 2 else 0 end
    as recovery_barcodes_found,
  case when vision_count > scanner_count then resolved else 0 end as recovery_labels_resolved,
  vision_count > scanner_count and resolved > 0 as recovery_succeeded,
  latency_ms,
  case when status = 'failed' then 'BAD_IMAGE'
       when vision_count <> scanner_count then 'VISION_SCANNER_MISMATCH'
       when vision_count > found_count then 'BARCODE_MISSING'
       when k % 23 = 0 then '' end as primary_issue,
  case when status = 'failed' or vision_count <> scanner_count then 1 else 0 end as issue_count,
  case when status = 'failed' then 'ValueError' end as error_code,
  case when status = 'failed' then 'cannot identify image' end as error_message,
  pipeline_version, scanner_version, vision_prompt_version, vision_model, recovery_version,
  provider_message_id, sender, created_at, created_at as processed_at
from (
  select cast(o.o_orderkey as string) as id,
    concat('t', cast(o.o_orderkey as string)) as trace_id,
    concat('s', cast(cast(floor(o.o_orderkey / 4) as bigint) as string)) as session_id,
    case o.o_orderkey % 9 when 0 then 'web_analyze_barcode' when 1 then 'process_whatsapp_message'
      when 2 then 'recovery' else 'ingest_one' end as name,
    case o.o_custkey % 4 when 0 then 'web' when 1 then 'whatsapp' when 2 then 'cli' else 'eval' end
      as source,
    case o.o_custkey % 4 when 0 then '/barcode' when 1 then '/webhook' end as endpoint,
    case when o.o_orderkey % 10 < 6 then 'complete' when o.o_orderkey % 10 < 8
      then 'needs_user_input' when o.o_orderkey % 10 = 8 then 'needs_retry' else 'failed' end
      as status,
    concat('photo', cast(o.o_orderkey as string), '.jpg') as filename,
    case when o.o_orderkey % 5 = 0 then null
      else concat('/uploads/', cast(o.o_orderkey as string), '.jpg') end as image_ref,
    cast(floor(o.o_totalprice) as int) as upload_bytes,
    case when o.o_orderkey % 11 = 0 then null else 3000 end as image_width,
    case when o.o_orderkey % 11 = 0 then null else 4000 end as image_height,
    coalesce(c.sc, 0) as scanner_count, coalesce(c.vc, 0) as vision_count,
    case when coalesce(c.sc, 0) > 0 and o.o_orderkey % 6 = 0 then c.sc - 1
      else coalesce(c.sc, 0) end as found_count,
    case when coalesce(c.sc, 0) > 0 and o.o_orderkey % 6 = 0 then 1 else 0 end as unassigned_count,
    cast(o.o_custkey % 2 as int) as k2, cast(o.o_orderkey % 1000003 as int) as k,
    case when o.o_custkey % 3 = 0 then 1 else 0 end as resolved,
    case when o.o_orderkey % 13 = 0 then 0
      else cast(cast(floor(o.o_totalprice) as bigint) % 20000 as int) end as latency_ms,
    case when o.o_orderkey % 17 = 0 then null
      else concat('ingest-v', cast(o.o_orderkey % 3 + 1 as string)) end as pipeline_version,
    case when o.o_custkey % 29 = 0 then null
      else concat('scanner-0.', cast(o.o_custkey % 4 + 6 as string)) end as scanner_version,
    concat('prompt-', cast(o.o_orderkey % 5 as string)) as vision_prompt_version,
    case when o.o_orderkey % 31 = 0 then null
      else concat('vision-', cast(o.o_custkey % 3 as string)) end as vision_model,
    concat('recovery-v', cast(o.o_orderkey % 2 + 1 as string)) as recovery_version,
    case when o.o_custkey % 4 = 1
      then concat('wamid-', cast(cast(floor(o.o_orderkey / 8) as bigint) as string)) end
      as provider_message_id,
    case when o.o_custkey % 4 = 1 then concat('+97', cast(o.o_custkey as string), '@c.us') end
      as sender,
    o.o_orderdate as created_at
  from {orders} o left join {line_counts} c on c.l_orderkey = o.o_orderkey
) r
"""

# Run metadata as loosely typed strings, the way traces carry it.
DERIVED["run_metadata"] = """
select o_orderkey as run_id,
  case o_orderkey % 7 when 0 then '6' when 1 then ' 3 ' when 2 then '3.5' when 3 then null
    when 4 then 'abc' when 5 then '-2' else 'true' end as found_count,
  case o_custkey % 7 when 0 then 'True' when 1 then 'false' when 2 then '1' when 3 then 'YES'
    when 4 then null when 5 then '0' else 'no' end as recovery_attempted,
  case o_orderkey % 3 when 0 then null when 1 then '' else 'BAD_IMAGE' end as primary_issue
from {orders}
"""

# The same as JSON whose values have types; braces by number, as the texts use them for tables.
DERIVED["run_json"] = """
select o_orderkey as run_id, concat(chr(123), '"found_count": ',
  case o_orderkey % 11 when 0 then '6' when 1 then '" 3 "' when 2 then '3.9' when 3 then 'null' when 4 then '"abc"' when 5 then '-2.7'
    when 6 then 'true' when 7 then '"true"' when 8 then '"3.5"' when 9 then '[1]' else '1e3' end,
  ', "recovery_attempted": ',
  case o_custkey % 13 when 0 then 'true' when 1 then 'false' when 2 then '2' when 3 then '0' when 4 then '0.5' when 5 then '"YES"'
    when 6 then '"no"' when 7 then '[]' when 8 then '[0]' when 9 then concat(chr(123), chr(125)) when 10 then 'null' when 11 then '"1"' else concat(chr(123), '"a": 1', chr(125)) end,
  case o_orderkey % 3 when 0 then '' when 1 then ', "primary_issue": null' else ', "primary_issue": "BAD_IMAGE"' end, chr(125)) as body
from {orders}
"""

# Label observations: one order line = one label of the photo o_orderkey. The index of
# a label is made from the line itself, so the table is a projection: no shuffle, and an
# order with very many lines costs nothing extra. Lines with equal numbers share a slot
# and so compete for the same readings.
DERIVED["label_boxes"] = """
select image_id, label_index, status, confidence, part, supp,
  lx1, ly1, lx1 + 210 as lx2, ly1 + 200 as ly2,
  case when part % 5 = 0 then null else lx1 + 10 end as bx1,
  case when part % 5 = 0 then null else ly1 + 20 end as by1,
  case when part % 5 = 0 then null else lx1 + 200 end as bx2,
  case when part % 5 = 0 then null else ly1 + 120 end as by2
from (
  select l_orderkey as image_id, l_partkey as part, l_suppkey as supp,
    cast((l_partkey * 100000 + l_suppkey) * 8 + l_linenumber as bigint) as label_index,
    case when l_partkey % 4 = 0 then 'blurred' else 'clear' end as status,
    case l_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence,
    cast(((l_linenumber - 1) % 3) * 220 as int) as lx1,
    cast(floor((l_linenumber - 1) / 3) * 210 as int) as ly1
  from {lineitem}) p
"""

# Decoder readings of the same photos, shifted so that neighbours compete.
DERIVED["detection_boxes"] = """
select image_id, det_index, value, format, x1, y1, x1 + 100 as x2, y1 + 50 as y2
from (
  select image_id, label_index as det_index, cast(7290000000000 + part as string) as value,
    case when supp % 5 = 0 then 'QRCode' else 'Code128' end as format,
    cast(lx1 + 55 + part % 300 - 150 as int) as x1,
    cast(ly1 + 45 + supp % 80 - 40 as int) as y1
  from {label_boxes} where supp % 7 <> 0) d
"""

# Three overlapping readings of every detection, some with a cut value.
DERIVED["raw_detections"] = """
select image_id, det_index * 4 + c as ord,
  case when c = 2 and det_index % 4 = 0 then substr(value, 1, 11) else value end as value,
  format, x1 + 4 * c as x1, y1 + 3 * c as y1, x2 - 2 * c as x2, y2 - c as y2
from {detection_boxes}
cross join (select 0 as c union all select 1 as c union all select 2 as c) copies
"""

# What a second, closer scan of the unread labels would return.
DERIVED["recovery_detections"] = """
select image_id, label_index as det_index, cast(7290000000000 + part as string) as value,
  'Code128' as format, lx1 + 60 as x1, ly1 + 40 as y1, lx1 + 160 as x2, ly1 + 90 as y2
from {label_boxes} where supp % 7 = 0 and part % 2 = 0
"""

DERIVED["images"] = """
select o_orderkey as image_id, 3000 as image_width, 4000 as image_height,
  case when o_orderkey % 41 = 0 then 'error' else 'ok' end as scan_state,
  case when o_orderkey % 37 = 0 then 'error' else 'ok' end as audit_state,
  cast(cast(floor(o_totalprice) as bigint) % 20000 as int) as elapsed_ms
from {orders}
"""

# Rectangular regions that may be labels, before ranking.
DERIVED["proposals"] = """
select image_id, proposal_id, x1, y1, x1 + w as x2, y1 + h as y2,
  rectangularity, white_ratio
from (
  select image_id, label_index as proposal_id,
    cast(lx1 + part % 90 as int) as x1, cast(ly1 + supp % 60 as int) as y1,
    cast(180 + part % 420 as int) as w, cast(120 + (part + supp) % 260 as int) as h,
    (part % 97) / 100e0 as rectangularity, (supp % 89) / 88e0 as white_ratio
  from {label_boxes}) p
"""

# Rows of decode attempts per crop: one order = one crop, one line = one read.
DERIVED["decode_attempts"] = """
select l_orderkey as crop_id, l_linenumber as attempt_no, l_partkey as read_id, l_suppkey as reader,
  case when l_suppkey % 3 = 0 then cast(7290000000000 + l_partkey as string)
       when l_suppkey % 3 = 1 then concat('A-', cast(l_partkey as string))
       else cast(l_partkey as string) end as value
from {lineitem}
"""

# Chat-style photo, selection and close events of many participants.
DERIVED["photo_events"] = """
select event_id, channel, participant_id, kind, t_us, audit_ok, visible,
  visible - least(visible, cast(event_id % 3 as int)) as found,
  first_code,
  case when kind = 'select' then concat('c', cast(first_code as string)) end as choice
from (
  select event_id,
    case when user_id % 2 = 0 then 'web' else 'whatsapp' end as channel,
    cast(user_id as string) as participant_id,
    case when event_type = 'purchase' and event_id % 4 = 0 then 'close'
         when event_type = 'signup' and event_id % 3 = 0 then 'select' else 'photo' end as kind,
    t_us, event_type <> 'error' as audit_ok, cast(1 + k % 6 as int) as visible,
    cast(k % 12 as int) as first_code
  from {event_times}) e
"""

# Events as a trace log: the type and a typed payload.
DERIVED["domain_events"] = """
select event_id, cast(cast(floor(event_id / 2) as bigint) as string) as run_id,
  concat('s', cast(user_id as string)) as session_id,
  case when event_id % 5 = 4 then 'IMAGE_RECEIVED' else 'INGEST_COMPLETED' end as type,
  t_us, source, image_ref, status, scanner_count, vision_count, recovery_attempted,
  recovery_labels_resolved
from (
  select event_id, user_id, t_us,
    case when user_id % 4 = 0 then 'web' when user_id % 4 = 1 then 'whatsapp' else 'cli' end
      as source,
    case when event_id % 6 = 0 then null
      else concat('/uploads/', cast(event_id as string),
        case when event_id % 4 = 1 then '.png' when event_id % 4 = 2 then '' else '.jpg' end) end
      as image_ref,
    case event_type when 'error' then 'failed' when 'signup' then 'needs_user_input'
      when 'click' then 'needs_retry' else 'complete' end as status,
    cast((7 * k) % 13 as int) as scanner_count, cast(k % 13 as int) as vision_count,
    k % 4 = 0 as recovery_attempted, cast(k % 2 as int) as recovery_labels_resolved
  from {event_times}) e
"""

DERIVED["feedback"] = """
select concat('t', cast(doc_id as string)) as trace_id, quality = 1 as correct,
  case when doc_id % 3 = 0 then concat('note ', cast(doc_id as string)) end as comment
from {labels}
"""

# Chat messages: every conversation turn is one callback message.
DERIVED["chat_messages"] = """
select conv_id, turn, concat(cast(conv_id as string), '-', cast(turn as string)) as id,
  concat('+97', cast(conv_id % 50 as string), '@c.us') as sender,
  concat('name ', cast(conv_id % 50 as string)) as contact,
  case when role = 'system' then 'sticker' when role = 'user' and turn % 4 = 0 then 'text'
       when role = 'user' and conv_id % 3 = 0 then 'interactive' when role = 'user' then 'audio'
       when turn % 4 = 1 then 'image' else 'document' end as type,
  case when conv_id % 6 = 0 then '' else concat('m', cast(conv_id as string)) end as media_id,
  case (conv_id + turn) % 5 when 0 then 'image/JPEG' when 1 then 'image/png'
    when 2 then 'application/pdf' when 3 then 'image/webp' else 'image/heic' end as image_mime,
  case turn % 3 when 0 then 'audio/ogg; codecs=opus' when 1 then 'audio/mpeg' else 'audio/x' end
    as audio_mime,
  text
from {conversations}
"""

DERIVED["customers"] = """
select concat('cust-', cast(c_custkey as string)) as id, c_name as name,
  c_custkey % 7 <> 0 as active from {customer}
"""

DERIVED["branches"] = """
select concat('branch-', cast(c.c_custkey as string), '-', cast(n.n_nationkey as string)) as id,
  concat('cust-', cast(c.c_custkey as string)) as customer_id, n.n_name as name,
  (c.c_custkey + n.n_nationkey) % 5 <> 0 as active
from {customer} c join {nation} n on n.n_nationkey = c.c_nationkey
"""

# Chat sessions of the senders, several per sender, some waiting for a choice.
DERIVED["chat_sessions"] = """
select concat('s', cast(conv_id as string)) as id, 'whatsapp' as channel,
  concat('+97', cast(conv_id % 50 as string), '@c.us') as participant_id,
  case conv_id % 4 when 0 then 'needs_user_selection' when 1 then 'complete'
    when 2 then 'active' else 'needs_user_selection' end as status,
  case when conv_id % 8 = 3 then null else concat('c', cast(conv_id % 5 as string), ',c2') end
    as candidates_text,
  cast(conv_id * 1000 as bigint) as last_activity_us
from {conversations} where turn = 0
"""

# Review queue in the middle of its life.
DERIVED["queue"] = """
select concat('cand-', id) as id, id as run_id, session_id, source, image_ref, status,
  scanner_count, vision_count, recovery_attempted, recovery_labels_resolved,
  cast(k * 1000 as bigint) as created_us,
  case when k % 3 = 0 then cast(k * 1000 + 500 as bigint) end as reviewed_us,
  case when k % 3 = 0 then concat('user', cast(k % 4 as string)) end as reviewed_by,
  case when k % 3 = 0 then 'complete' end as expected_outcome,
  k % 9 = 0 as added_to_dataset
from (select r.*, cast(id as bigint) as k from {runs} r where status <> 'complete') q
"""

DERIVED["reviews"] = """
select concat('cand-', cast(k as string)) as id, cast(k as string) as run_id,
  cast(k * 1000 + 700 + n as bigint) as reviewed_us, concat('late', cast(n as string)) as reviewed_by,
  case when n = 0 then 'complete' else 'failed' end as expected_outcome
from (select o_orderkey as k, 0 as n from {orders} where o_orderkey % 2 = 0
  union all select o_orderkey as k, 1 as n from {orders} where o_orderkey % 4 = 0) v
"""

# Uploaded images that are still in storage.
DERIVED["inventory"] = """
select concat('/uploads/', cast(o_orderkey as string), '.jpg') as path from {orders}
where o_orderkey % 7 <> 0
"""

# Codes a reviewer expects on the photo of a run.
DERIVED["expected_codes"] = """
select cast(l_orderkey as string) as run_id, l_linenumber as box_no,
  case when l_partkey % 11 = 0 then null else cast(7290000000000 + l_partkey as string) end as value,
  case when l_partkey % 3 = 0 then null else 'EAN13' end as format
from {lineitem} where l_suppkey % 4 <> 0
"""

# Stored sessions with their items and missing labels.
DERIVED["sessions"] = """
select concat('s', cast(o_orderkey as string)) as id,
  case o_orderkey % 5 when 0 then 'active' when 1 then 'complete' when 2 then 'needs_user_selection'
    when 3 then 'expired' else 'closed' end as status,
  cast(o_orderkey % 9 as int) as expected_count, cast(o_orderkey % 7 as int) as found_count,
  cast(o_orderkey % 3 as int) as missing_count, cast(o_orderkey % 4 as int) as image_count,
  case when o_custkey % 2 = 0 then 'web' else 'whatsapp' end as channel,
  cast(o_custkey as string) as participant_id,
  concat('cust-', cast(o_custkey as string)) as customer_id,
  concat('branch-', cast(o_custkey as string), '-', cast(o_custkey % 25 as string)) as branch_id,
  case when o_orderkey % 3 = 0 then 'verify_order_before_shipment' else 'create_order' end as action,
  case when o_orderkey % 4 = 0 then null else concat('msg', cast(o_orderkey as string)) end as message,
  cast(o_orderkey * 10 as bigint) as updated_at, cast(o_orderkey * 10 + 1 as bigint) as last_activity_at,
  cast(null as bigint) as completed_at, cast(null as bigint) as closed_at
from {orders}
"""

DERIVED["session_items"] = """
select concat('s', cast(l_orderkey as string)) as session_id,
  cast(l_partkey * 100000 + l_suppkey as bigint) as line_id,
  cast(l_partkey % 40 as string) as barcode_value,
  case when l_partkey % 6 = 0 then null else l_linenumber end as label_index,
  cast(l_suppkey % 3 as int) as source_image, l_extendedprice as tie
from {lineitem} where l_suppkey % 7 <> 0
"""

DERIVED["session_missing"] = """
select concat('s', cast(l_orderkey as string)) as session_id,
  cast(l_partkey * 100000 + l_suppkey as bigint) as line_id, l_linenumber as label_index,
  cast(l_suppkey % 3 as int) as source_image, l_partkey % 2 = 0 as resolved
from {lineitem} where l_suppkey % 7 = 0
"""

# Ground truth of the symbol benchmark: the labels, some known to be unreadable.
DERIVED["expected_symbols"] = """
select image_id, label_index, lx1 + 60 as x1, ly1 + 40 as y1, lx1 + 150 as x2, ly1 + 90 as y2,
  case when part % 6 = 0 then 'unreadable' else 'decoded' end as state,
  cast(7290000000000 + case when part % 10 = 0 then part + 1 else part end as string) as value
from {label_boxes}
"""


_REF = re.compile(r"\{(\w+)\}")

#: dialect differences that the shared texts cannot express
EVENT_TIMES_SPARK = """
select event_id, user_id, event_type,
  cast(get_json_object(props, '$.k') as bigint) as k,
  timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 40
    as t_us
from {events}
"""
EVENT_TIMES_DUCKDB = """
select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k,
  epoch_us(ts) // 40 as t_us
from {events}
"""


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The given or derived table ``name`` as a DataFrame."""
    if name in GIVEN:
        return given(spark, sf_dir, name)
    text = EVENT_TIMES_SPARK if name == "event_times" else DERIVED[name]
    refs = {r: build(spark, sf_dir, r) for r in dict.fromkeys(_REF.findall(text))}
    return spark.sql(text, **refs)


def _needs(name: str, seen: dict[str, None]) -> None:
    text = EVENT_TIMES_DUCKDB if name == "event_times" else DERIVED[name]
    for ref in _REF.findall(text):
        if ref not in GIVEN and ref not in seen:
            _needs(ref, seen)
    seen[name] = None


def cte(*names: str) -> str:
    """DuckDB ``WITH`` list (without the keyword) that defines ``names``."""
    seen: dict[str, None] = {}
    for name in names:
        if name not in seen:
            _needs(name, seen)
    parts = []
    for n in seen:
        text = EVENT_TIMES_DUCKDB if n == "event_times" else DERIVED[n]
        parts.append(f"{n} as ({_REF.sub(lambda m: m.group(1), text).strip()})")
    return ",\n".join(parts)
