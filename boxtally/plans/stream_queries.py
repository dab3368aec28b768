"""Sessions and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import sessions
from boxtally.plans import session_oracle
from boxtally.plans.catalog import query
from boxtally.plans.fixtures import DERIVED, EVENT_TIMES_SPARK, build
from boxtally.plans.store_queries import _CANDIDATES, FLAT_CHAT, callback_bodies
from boxtally.session import scratch_path
from boxtally.sources.streams import table_stream, webhook_stream
from boxtally.streaming import flows
from boxtally.streaming.runner import drain_each, drain_to_table
from boxtally.streaming.sessions import session_stream as stream_steps


def shape_events(flat):
    """Photo events with their label arrays."""
    return flat.select(
        "event_id", "channel", "participant_id", "kind", "t_us", "audit_ok", "visible",
        sessions.found_labels(F.col("first_code"), F.col("found")).alias("found"),
        sessions.missing_labels(F.col("found"), F.col("visible")).alias("missing"), "choice")


def _flat_steps(steps):
    return steps.select(
        "event_id", "channel", "participant_id", "session_id", "status", "expected_count", "found_count",
        "missing_count", "image_count", F.array_join("added", ",").alias("added"), "message", "rejected", "expired_id")


@query("T1 T2 T3 T4", session_oracle.STEP_ROWS, "photo_events", recursive=True)
def session_steps(spark, d):
    return _flat_steps(sessions.accumulate(shape_events(build(spark, d, "photo_events"))))


@query("S5 T1 J7", session_oracle.TABLE_ROWS, "photo_events", recursive=True)
def session_table(spark, d):
    return sessions.session_table(sessions.accumulate(shape_events(build(spark, d, "photo_events"))))


def streamed(spark, d, name: str):
    """A derived event table over the events table read as a stream, with the file of each event."""
    def kept(text: str) -> str:
        return text.replace("select event_id,", "select source_file, event_id,")

    times = spark.sql(kept(EVENT_TIMES_SPARK), events=table_stream(spark, d, "events"))
    return spark.sql(kept(DERIVED[name]), event_times=times)


@query("T1 T2 T3 T4", session_oracle.STEP_ROWS, "photo_events", recursive=True)
def session_stream(spark, d):
    steps = stream_steps(shape_events(streamed(spark, d, "photo_events")))
    return _flat_steps(sessions.with_messages(drain_to_table(steps, "sessions")))


@query("S6 T5 T8 K10", _CANDIDATES, "domain_events")
def capture_stream(spark, d):
    root = scratch_path(spark, "capture")
    drain_each(streamed(spark, d, "domain_events"), "capture", flows.fan_out({
        "queue": flows.queue_sink(f"{root}/queue"), "counts": flows.count_sink(f"{root}/counts", "type")}, f"{root}/retry"))
    return flows.read_queue(spark, f"{root}/queue")


@query("S7 T6 D6", f"""with {FLAT_CHAT}
select sender, id, type, name, text, media_id, mime_type, case when type = 'image' then 'photo'
  when type = 'document' and lower(mime_type) in ('image/jpeg', 'image/png', 'image/webp') then 'photo'
  when type = 'document' then 'instruction' when type = 'audio' then 'audio' else 'selection' end as route
from flat_chat""", "chat_messages")
def chat_stream(spark, d):
    root = scratch_path(spark, "callbacks")
    bodies = callback_bodies(build(spark, d, "chat_messages")).select("value")
    # Every body is delivered twice, as a provider that retries does, and again long after, in batches of their own.
    bodies.unionByName(bodies).write.text(root)
    bodies.coalesce(1).write.mode("append").text(root)
    out = drain_to_table(flows.chat_messages(webhook_stream(spark, root, files_per_trigger=8)), "chat")
    return out.select("sender", "id", "type", "name", "text", "media_id", "mime_type", "route")


@query("T7", """
with e as (select status, t_us, (t_us // 3600000000) * 3600000000 as hour_us from domain_events)
select hour_us, status, count(*) as n from e group by 1, 2""", "domain_events")
def hourly_stream(spark, d):
    """Open hours included. The checkpoint is lost once: the second query reads the same files again."""
    events = streamed(spark, d, "domain_events").withColumn("hour", flows.hour_of(F.timestamp_micros("t_us")))
    root = scratch_path(spark, "hourly")
    for run in range(2):
        drain_each(events, f"hourly-{run}", flows.count_sink(root, "hour", "status"))
    return flows.summed_counts(spark, root, "hour timestamp, status string").select(
        F.unix_micros("hour").alias("hour_us"), "status", "n")
