"""Accumulation of photos into sessions.

The rules of one step are :func:`step`, a pure function used by the batch plan
here and by the stream. A session depends on the order of its events, so each
participant is folded in order; everything that can be cut is cut before that:

* a participant's events are split where a photo comes more than the time limit
  after the event before, since such a photo always opens a new session;
* splits are found on half-hour buckets, so a participant with very many events
  is first reduced to at most one row per half hour;
* a split part is read as a sorted stream of Arrow batches, never as one group.

A photo that finds the newest session still active after the time limit expires it: the step names
that session in ``expired_id``. Across a cut it is the session the part before left active.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions.messages import session_message
from boxtally.session import cut_lineage

TTL_US = 30 * 60 * 1_000_000

EVENTS = """event_id long, channel string, participant_id string, kind string, t_us long,
    audit_ok boolean, visible int, found array<struct<label_index:int,barcode_value:string>>,
    missing array<int>, choice string"""

STEPS = """event_id long, channel string, participant_id string, session_id string, status string,
    expected_count int, found_count int, missing_count int, image_count int, added array<string>,
    missing_labels array<int>, new_codes array<string>, missing_before int, rejected string,
    looked_back boolean, waits boolean, expired_id string, left_active string, t_us long, part long"""


def new_state() -> dict:
    """``open``: sessions that take photos or wait for a choice, latest activity last."""
    return {"open": [], "current": None}


def _insert(s: dict, value: str, image: int, label: int | None) -> bool:
    """Add an item unless this label of this photo has one."""
    if label is not None and any(i[1] == image and i[2] == label for i in reversed(s["items"])):
        return False
    s["items"].append([value, image, label])
    s["found"] += 1
    return True


def _settle(s: dict, t: int) -> None:
    done = s["expected"] > 0 and s["found"] >= s["expected"]
    s["status"] = "complete" if done else "active"
    s["last"] = t


def _photo(state: dict, e: dict, out: dict) -> None:
    s = state["open"][-1] if state["open"] else None
    if s is not None and e["t_us"] - s["last"] > TTL_US:
        if s["status"] == "active":
            s["status"] = "expired"
            out["expired_id"] = s["id"]
            state["open"].pop()
        s = None
    if not e["audit_ok"]:
        # Nothing is stored for a photo that could not be audited.
        out.update(rejected="audit_failed")
        return _report(out, s, status="failed")
    fresh = s is None
    if fresh:
        s = {"id": f"{e['channel']}:{e['participant_id']}:{e['event_id']}", "status": "active",
             "expected": 0, "found": 0, "items": [], "missing": [], "images": 0, "candidates": [], "last": e["t_us"]}
        state["open"].append(s)
    image = s["images"]
    s["expected"] = max(s["expected"], e["visible"])
    known = {i[0] for i in s["items"]}
    new: dict[str, int | None] = {}
    for label, value in e["found"]:
        if value not in known:
            new.setdefault(value, label)
    before = len(s["missing"])
    added: list[str] = []
    ambiguous = False
    if fresh:
        added = [v for label, v in e["found"] if _insert(s, v, image, label)]
    elif len(new) <= before:
        for value, label in new.items():
            if _insert(s, value, image, label):
                added.append(value)
                s["missing"].pop(0)
    else:
        ambiguous = True
    if fresh or e["visible"] > 0:
        s["missing"] += e["missing"]
    s["images"] += 1
    s["candidates"] = [[v, image, label] for v, label in new.items()] if ambiguous else []
    _settle(s, e["t_us"])
    if ambiguous:
        s["status"] = "needs_user_selection"
    state["open"].sort(key=lambda x: x["last"])
    out.update(added=added, missing_before=before, new_codes=[c[0] for c in s["candidates"]])
    _finish(state, s, out)


def _select(state: dict, e: dict, out: dict) -> None:
    s = state["open"][-1] if state["open"] else None
    if s is None or s["status"] != "needs_user_selection":
        out.update(rejected="not_awaiting_selection", looked_back=s is None)
        return _report(out, s)
    picked = next((c for c in s["candidates"] if c[0] == e["choice"]), None)
    if picked is None:
        out.update(rejected="unknown_candidate")
        return _report(out, s)
    if _insert(s, *picked):
        out["added"] = [picked[0]]
    if s["missing"]:
        s["missing"].pop(0)
    s["candidates"] = []
    _settle(s, e["t_us"])
    _finish(state, s, out)


def _close(state: dict, e: dict, out: dict) -> None:
    s = state["current"]
    if s is None or s["status"] not in ("active", "complete"):
        out["rejected"] = "not_open"
        return _report(out, s)
    s["status"], s["last"] = "closed", e["t_us"]
    _finish(state, s, out)


def _finish(state: dict, s: dict, out: dict) -> None:
    state["open"] = [x for x in state["open"] if x["status"] in ("active", "needs_user_selection")]
    state["current"] = s
    _report(out, s)


def _report(out: dict, s: dict | None, status: str | None = None) -> None:
    if s is None:
        out.update(status=status, expected_count=0, found_count=0, missing_count=0, image_count=0)
        return
    out.update(session_id=s["id"], status=status or s["status"], expected_count=s["expected"],
               found_count=s["found"], missing_count=len(s["missing"]), image_count=s["images"],
               missing_labels=list(s["missing"]))


_RULES = {"photo": _photo, "select": _select, "close": _close}


def step(state: dict, event: dict) -> dict:
    """Apply one event to the state of its participant; returns the step row."""
    out = {"event_id": event["event_id"], "channel": event["channel"],
           "participant_id": event["participant_id"], "session_id": None, "status": None,
           "added": [], "missing_labels": [], "new_codes": [], "missing_before": 0,
           "rejected": None, "looked_back": False, "expired_id": None,
           "t_us": event["t_us"], "part": event.get("part", 0)}
    _RULES[event["kind"]](state, event, out)
    out["waits"] = any(s["status"] == "needs_user_selection" for s in state["open"])
    newest = state["open"][-1] if state["open"] else None
    out["left_active"] = newest["id"] if newest and newest["status"] == "active" else None
    return out


def events_of(pdf: pd.DataFrame) -> Iterator[dict]:
    """Rows of a batch as plain values."""
    for r in pdf.to_dict("records"):
        r["found"] = [] if r["found"] is None else [(f["label_index"], f["barcode_value"]) for f in r["found"]]
        r["missing"] = [] if r["missing"] is None else [int(m) for m in r["missing"]]
        r["audit_ok"] = bool(r["audit_ok"])
        r["visible"] = int(r["visible"])
        yield r


def rows_to_frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in STEPS.split(",") if c.strip()]
    return pd.DataFrame(rows, columns=names)


#: a session in stored state: numbers and lists of plain values
SESSION = """status string, expected int, found int, images int, last long, missing array<int>,
    item_values array<string>, item_images array<int>, item_labels array<int>,
    candidate_values array<string>, candidate_images array<int>, candidate_labels array<int>"""


def pack_session(s: dict, items: bool = True) -> tuple:
    """A session as one row of :data:`SESSION`; one that is not open any more needs no items."""
    columns = [[i[k] for i in kept] for kept in (s["items"] if items else [], s["candidates"] if items else []) for k in range(3)]
    return (s["status"], s["expected"], s["found"], s["images"], s["last"], s["missing"], *columns)


def unpack_session(id_: str, row: tuple) -> dict:
    status, expected, found, images, last, missing, *columns = row
    items, candidates = ([list(i) for i in zip(*(list(c or []) for c in columns[k:k + 3]))] for k in (0, 3))
    return {"id": id_, "status": status, "expected": expected, "found": found, "items": items, "missing": list(missing or []),
            "images": images, "candidates": candidates, "last": last}


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold a sorted stream of events; only the state of the part at hand is held."""
    part, state = None, new_state()
    for pdf in batches:
        rows = []
        for e in events_of(pdf):
            key = (e["channel"], e["participant_id"], e["part"])
            if key != part:
                part, state = key, new_state()
            rows.append(step(state, e))
        if rows:
            yield rows_to_frame(rows)


KEY = ["channel", "participant_id"]


def split_parts(events: DataFrame, ttl_us: int = TTL_US) -> DataFrame:
    """Number the parts of each participant between which nothing is shared.

    A gap longer than the limit always lies between two half-hour buckets, so
    the window below sees one row per participant and bucket.
    """
    first = F.min(F.struct("t_us", "event_id", ((F.col("kind") == "photo") & F.col("audit_ok")).alias("opens")))
    bucket = F.floor(F.col("t_us") / F.lit(ttl_us)).alias("bucket")
    spans = events.groupBy(*KEY, bucket).agg(first.alias("first"), F.max("t_us").alias("last"))
    before = Window.partitionBy(*KEY).orderBy("bucket")
    starts = F.col("first.opens") & (F.col("first.t_us") - F.lag("last").over(before) > ttl_us)
    marked = spans.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("long"))
    parts = marked.select(*KEY, "bucket", F.sum("starts").over(
        before.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))
    return events.withColumn("bucket", F.floor(F.col("t_us") / F.lit(ttl_us))).join(
        parts, [*KEY, "bucket"]).drop("bucket")


def _fold(events: DataFrame) -> DataFrame:
    key = [*KEY, "part"]
    ordered = events.repartition(*key).sortWithinPartitions(*key, "t_us", "event_id")
    return ordered.mapInPandas(_fold_sorted, STEPS)


def accumulate(events: DataFrame) -> DataFrame:
    """One row per event: the session it met and how that session stands after it.

    A choice may reach back to a session left waiting in an earlier part. Those
    participants are recognised by their steps and folded again as a whole.
    """
    steps = cut_lineage(_fold(split_parts(events)))
    back = steps.filter("looked_back").select(*KEY).distinct()
    again = cut_lineage(steps.filter("waits").select(*KEY).distinct().join(back, KEY, "left_semi"))
    if not again.isEmpty():
        whole = _fold(events.join(again, KEY, "left_semi").withColumn("part", F.lit(0).cast("long")))
        steps = steps.join(again, KEY, "left_anti").unionByName(whole)
    return with_messages(expired_between_parts(steps))


def expired_between_parts(steps: DataFrame) -> DataFrame:
    """Name in the first step of a part the session that the part before left active.

    A part opens with a photo after the time limit, so that session has expired by then. Only one row per
    part is joined.
    """
    at = F.struct("t_us", "event_id")
    ends = steps.groupBy(*KEY, "part").agg(F.max_by("left_active", at).alias("left"), F.min(at).alias("start"))
    starts = ends.select(*KEY, "part", F.col("start.event_id").alias("event_id"))
    left = ends.filter("left is not null").select(*KEY, (F.col("part") + 1).alias("part"), "left")
    found = starts.join(left, [*KEY, "part"]).select(*KEY, "event_id", "left")
    return steps.join(found, [*KEY, "event_id"], "left").withColumn(
        "expired_id", F.coalesce("expired_id", "left")).drop("left").select(*steps.columns)


def with_messages(steps: DataFrame) -> DataFrame:
    """Add the prompt shown after each step."""
    text = session_message(F.col("status"), F.col("found_count"), F.col("expected_count"),
                           F.col("missing_labels"), F.col("new_codes"), F.col("missing_before"))
    return steps.withColumn("message", F.when(F.col("rejected").isNull(), text).when(
        F.col("rejected") == "audit_failed", "Audit failed"))


def session_table(steps: DataFrame) -> DataFrame:
    """Last state of every session: the newest accepted step of each, or expired after it.

    Expiry changes the status only; the last activity stays.
    """
    own = steps.filter(F.col("rejected").isNull()).withColumn("gone", F.lit(False))
    expired = steps.filter(F.col("expired_id").isNotNull()).select(
        *[F.col("expired_id").alias(c) if c == "session_id" else F.lit(True).alias(c) if c == "gone"
          else F.col(c) if c in KEY else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns])
    accepted = own.unionByName(expired)
    state = F.struct("t_us", "event_id", "status", "expected_count", "found_count", "missing_count", "image_count")
    newest = F.max(F.when(~F.col("gone"), state)).alias("n")
    return accepted.groupBy("session_id", *KEY).agg(newest, F.bool_or("gone").alias("gone")).select(
        "session_id", *KEY, F.when(F.col("gone"), "expired").otherwise(F.col("n.status")).alias("status"), "n.expected_count", "n.found_count", "n.missing_count",
        "n.image_count", F.col("n.t_us").alias("last_activity_us"))


def found_labels(first_code: Column, found: Column) -> Column:
    """Labelled codes of a derived photo event: consecutive codes on labels 1..found."""
    numbers = F.when(found > 0, F.sequence(F.lit(1), found)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.struct(
        i.alias("label_index"), F.concat(F.lit("c"), ((first_code + i - 1) % 12).cast("string")).alias("barcode_value")))


def missing_labels(found: Column, visible: Column) -> Column:
    return F.when(visible > found, F.sequence(found + 1, visible)).otherwise(F.array().cast("array<int>"))
