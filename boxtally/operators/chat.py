"""Chat callbacks: flattening, repeats, routing, replies that pick a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.operators.dedup import first_per_key

_MEDIA = "id:string,mime_type:string"
_REPLY = "struct<id:string,title:string>"

#: one callback body; unknown fields are ignored, absent ones are null
CALLBACK = (
    "struct<entry:array<struct<changes:array<struct<value:struct<"
    "contacts:array<struct<wa_id:string,profile:struct<name:string>>>,"
    "messages:array<struct<`from`:string,id:string,type:string,text:struct<body:string>,"
    f"audio:struct<{_MEDIA},voice:boolean>,image:struct<{_MEDIA},caption:string>,"
    f"document:struct<{_MEDIA},filename:string,caption:string>,"
    f"interactive:struct<list_reply:{_REPLY},button_reply:{_REPLY}>>>>>>>>>"
)

HANDLED = ("text", "audio", "image", "document", "interactive")


def parse_callbacks(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bodies that are no JSON object drop out."""
    parsed = raw.withColumn("payload", F.from_json(column, CALLBACK))
    return parsed.filter(F.col("payload").isNotNull()).drop(column)


def flatten_callbacks(parsed: DataFrame) -> DataFrame:
    """One row per inbound message of a handled type, with the fields of its type.

    Only narrow steps: three explodes and a look-up in the contacts of the same
    change, so the rows stay where they were read.
    """
    keep = [c for c in parsed.columns if c != "payload"]
    changes = parsed.select(*keep, F.explode("payload.entry").alias("e")).select(
        *keep, F.explode("e.changes").alias("c"))
    m = F.col("m")
    rows = changes.select(*keep, F.col("c.value.contacts").alias("contacts"),
                          F.explode("c.value.messages").alias("m"))
    sender, kind = F.coalesce(m["from"], F.lit("")), F.coalesce(m["type"], F.lit(""))
    # The last contact of a sender wins.
    contact = F.try_element_at(F.filter("contacts", lambda c: c["wa_id"] == m["from"]), F.lit(-1))

    def field(**by_type: Column) -> Column:
        out = None
        for t, v in by_type.items():
            test, value = kind == t, F.coalesce(v, F.lit(""))
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    lists, buttons = m["interactive"]["list_reply"], m["interactive"]["button_reply"]
    picked, title = F.coalesce(buttons["id"], lists["id"]), F.coalesce(buttons["title"], lists["title"])
    choice = kind == "interactive"
    return rows.filter(kind.isin(*HANDLED)).select(
        *keep, sender.alias("sender"), F.coalesce(m["id"], F.lit("")).alias("id"), kind.alias("type"),
        F.coalesce(contact["profile"]["name"], F.lit("")).alias("name"),
        F.when(choice, picked).otherwise(field(text=m["text"]["body"])).alias("text"),
        field(audio=m["audio"]["id"], image=m["image"]["id"], document=m["document"]["id"]).alias("media_id"),
        field(audio=m["audio"]["mime_type"], image=m["image"]["mime_type"],
              document=m["document"]["mime_type"]).alias("mime_type"),
        F.when(kind == "audio", F.coalesce(m["audio"]["voice"], F.lit(False))).alias("voice"),
        field(image=m["image"]["caption"], document=m["document"]["caption"]).alias("caption"),
        field(document=m["document"]["filename"]).alias("filename"),
        F.when(choice, picked).alias("interactive_id"), F.when(choice, title).alias("interactive_title"))


def drop_repeats(messages: DataFrame, arrival: str) -> DataFrame:
    """First arrival of every message id."""
    return first_per_key(messages, ["id"], [arrival])


def mark_repeats(messages: DataFrame, arrival: str) -> DataFrame:
    """Flag every later arrival of a message id; the minimum combines before the shuffle."""
    first = messages.groupBy("id").agg(F.min(arrival).alias("_first"))
    return messages.join(first, "id").withColumn("duplicate", F.col(arrival) > F.col("_first")).drop("_first")


def latest_open_sessions(sessions: DataFrame) -> DataFrame:
    """Latest session of each participant that still takes photos or a choice."""
    open_ = sessions.filter(F.col("status").isin("active", "needs_user_selection"))
    return first_per_key(open_, ["channel", "participant_id"], [F.col("last_activity_us").desc(), "id"])


def match_selection(messages: DataFrame, sessions: DataFrame, channel: str = "whatsapp") -> DataFrame:
    """Replies beside the candidates of the sender's waiting session.

    ``pending``: false without a waiting session, null when it waits without
    candidates. ``reply_known``: the trimmed reply is one of the candidates.
    """
    waiting = latest_open_sessions(sessions.filter(F.col("channel") == channel)).select(
        F.col("participant_id").alias("sender"), F.col("id").alias("session_id"),
        F.col("status").alias("session_status"), "candidates")
    joined = messages.join(waiting, "sender", "left")
    wants = F.coalesce(F.col("session_status") == "needs_user_selection", F.lit(False))
    empty = F.coalesce(F.size("candidates"), F.lit(0)) <= 0
    reply = F.trim(F.coalesce("text", F.lit("")))
    return joined.withColumns({
        "pending": F.when(~(wants & empty), wants),
        "reply_known": wants & F.coalesce(F.array_contains("candidates", reply), F.lit(False)),
    })
