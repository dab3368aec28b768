"""Session rules, their independence of the cut into parts, batch and stream alike."""

from __future__ import annotations

import random

import pytest

from boxtally.operators import sessions
from boxtally.operators.sessions import EVENTS, STEPS, TTL_US
from boxtally.streaming.runner import drain_to_table
from boxtally.streaming.sessions import session_stream

MINUTE = 60_000_000


class Chat:
    """Events of one participant, a minute apart unless told otherwise."""

    def __init__(self, who="p", channel="web"):
        self.rows, self.t, self.who, self.channel = [], 0, who, channel

    def _add(self, kind, after, **kw):
        self.t += after
        row = dict(event_id=len(self.rows) + 1, channel=self.channel, participant_id=self.who, kind=kind,
                   t_us=self.t, audit_ok=True, visible=0, found=[], missing=[], choice=None) | kw
        self.rows.append(row)
        return self

    def photo(self, visible, found, missing=(), after=MINUTE, **kw):
        pairs = [(i + 1, v) for i, v in enumerate(found)]
        return self._add("photo", after, visible=visible, found=pairs, missing=list(missing), **kw)

    def failed(self, after=MINUTE):
        return self._add("photo", after, audit_ok=False)

    def select(self, value, after=MINUTE):
        return self._add("select", after, choice=value)

    def close(self, after=MINUTE):
        return self._add("close", after)

    def steps(self):
        state = sessions.new_state()
        out = []
        for row in self.rows:
            out.append(sessions.step(state, row))
            state = restored(state)
        return out


def restored(state):
    """The state after it was written and read again."""
    open_ = [sessions.unpack_session(s["id"], sessions.pack_session(s)) for s in state["open"]]
    current = state["current"]
    if current is not None:
        current = next((s for s in open_ if s["id"] == current["id"]), None) or sessions.unpack_session(
            current["id"], sessions.pack_session(current, items=False))
    return {"open": open_, "current": current}


def short(s):
    return s["status"], s["expected_count"], s["found_count"], s["missing_count"], s["image_count"]


def test_complete_on_first_photo():
    s, = Chat().photo(2, ["1", "2"]).steps()
    assert short(s) == ("complete", 2, 2, 0, 1)


def test_second_photo_resolves_missing():
    a, b = Chat().photo(3, ["1", "2"], [3]).photo(1, ["3"]).steps()
    assert short(a) == ("active", 3, 2, 1, 1) and a["missing_labels"] == [3]
    assert short(b) == ("complete", 3, 3, 0, 2) and b["session_id"] == a["session_id"]


def test_known_codes_do_not_count():
    _, b = Chat().photo(4, ["1", "2", "3"], [4]).photo(3, ["2", "3", "4"]).steps()
    assert short(b) == ("complete", 4, 4, 0, 2) and b["added"] == ["4"]


def test_same_new_code_twice_is_one():
    _, b = Chat().photo(4, ["1", "2", "3"], [4]).photo(2, ["9", "9"]).steps()
    assert short(b) == ("complete", 4, 4, 0, 2)


def test_more_new_than_missing_asks():
    codes = [str(i) for i in range(9)]
    _, b = Chat().photo(12, codes, [10, 11, 12]).photo(6, ["A", "B", "C", "D", "0", "1"]).steps()
    assert short(b) == ("needs_user_selection", 12, 9, 3, 2)
    assert b["new_codes"] == ["A", "B", "C", "D"] and b["missing_before"] == 3


def test_two_missing_over_three_photos():
    _, b, c = Chat().photo(5, ["1", "2", "3"], [4, 5]).photo(1, ["4"]).photo(1, ["5"]).steps()
    assert short(b) == ("active", 5, 4, 1, 2) and short(c) == ("complete", 5, 5, 0, 3)


def test_expected_count_grows():
    _, b = Chat().photo(4, ["1", "2", "3"], [4]).photo(6, ["1", "2", "3", "4"], [5, 6]).steps()
    assert short(b) == ("active", 6, 4, 2, 2)


def test_failed_audit_changes_nothing():
    a, b, c = Chat().failed().photo(2, ["1"], [2]).failed().steps()
    assert a["status"] == c["status"] == "failed" and a["session_id"] is None
    assert short(c)[1:] == (2, 1, 1, 1) and c["session_id"] == b["session_id"]


def test_complete_session_is_not_found_again():
    a, b = Chat().photo(1, ["1"]).photo(2, ["1", "2"]).steps()
    assert a["session_id"] != b["session_id"] and short(b) == ("complete", 2, 2, 0, 1)


def test_close_then_new_session():
    a, b, c = Chat().photo(2, ["1"], [2]).close().photo(2, ["1"], [2]).steps()
    assert b["status"] == "closed" and c["session_id"] != a["session_id"]


@pytest.mark.parametrize("gap, same", [(TTL_US, True), (TTL_US + 1, False)])
def test_expiry_is_strict(gap, same):
    a, b = Chat().photo(2, ["1"], [2]).photo(2, ["1"], [2], after=gap).steps()
    assert (a["session_id"] == b["session_id"]) is same


def test_failed_photo_does_not_keep_alive():
    a, _, c = Chat().photo(2, ["1"], [2]).failed(after=20 * MINUTE).photo(2, ["1"], [2], after=20 * MINUTE).steps()
    assert a["session_id"] != c["session_id"]


def test_selection_adds_one_and_drops_the_rest():
    base = Chat().photo(4, ["1", "2"], [3, 4]).photo(3, ["7", "8", "9"])
    _, _, c, d = base.select("8").select("7").steps()
    assert short(c) == ("active", 4, 3, 1, 2) and c["added"] == ["8"]
    assert d["rejected"] == "not_awaiting_selection"


def test_unknown_choice_is_refused():
    *_, c = Chat().photo(3, ["1", "2"], [3]).photo(2, ["7", "8"]).select("5").steps()
    assert c["rejected"] == "unknown_candidate" and c["status"] == "needs_user_selection"


def test_stale_waiting_session_stays_and_can_still_be_answered():
    base = Chat().photo(3, ["1", "2"], [3]).photo(2, ["7", "8"])
    _, b, c, d = base.photo(1, ["1"], after=TTL_US + 1).select("7").steps()
    assert c["session_id"] != b["session_id"] and c["status"] == "complete"
    assert d["session_id"] == b["session_id"] and short(d) == ("complete", 3, 3, 0, 2)


def test_waiting_session_takes_more_photos():
    _, b, c = Chat().photo(3, ["1", "2"], [3]).photo(2, ["7", "8"]).photo(1, ["7"]).steps()
    assert b["status"] == "needs_user_selection"
    assert c["session_id"] == b["session_id"] and short(c) == ("complete", 3, 3, 0, 3)


def random_chats(seed, people=40, events=60, selects=0.15):
    rng = random.Random(seed)
    rows = []
    for p in range(people):
        chat = Chat(f"p{p}", rng.choice(["web", "whatsapp"]))
        for _ in range(events):
            after = rng.choice([MINUTE, 5 * MINUTE, 29 * MINUTE, TTL_US, TTL_US + 1, 50 * MINUTE, 200 * MINUTE])
            r = rng.random()
            if r < selects:
                chat.select(f"c{rng.randrange(8)}", after)
            elif r < selects + 0.08:
                chat.close(after)
            elif r < selects + 0.2:
                chat.failed(after)
            else:
                visible = rng.randrange(1, 6)
                found = [f"c{rng.randrange(8)}" for _ in range(rng.randrange(0, visible + 1))]
                chat.photo(visible, found, range(len(found) + 1, visible + 1), after)
        for r in chat.rows:
            r["event_id"] += p * 1000
        rows.append(chat)
    return rows


NAMES = [c.split()[0] for c in
         "event_id,channel,participant_id,kind,t_us,audit_ok,visible,found,missing,choice".split(",")]


def frame(spark, chats):
    rows = [tuple(r[n] for n in NAMES) for c in chats for r in c.rows]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, EVENTS)


def plain(rows):
    names = [c.split()[0] for c in STEPS.replace("\n", " ").split(",")]
    keep = [n for n in names if n not in ("looked_back", "waits", "part")]
    return sorted((tuple(str(r[n]) for n in keep) for r in rows))


@pytest.mark.parametrize("selects", [0.0, 0.15])
def test_parts_give_the_same_steps_as_whole_participants(spark, selects):
    chats = random_chats(11, selects=selects)
    events = frame(spark, chats)
    want = plain([s for c in chats for s in c.steps()])
    got = sessions.accumulate(events).drop("message").collect()
    assert plain([r.asDict() for r in got]) == want
    parts = sessions.split_parts(events)
    assert parts.count() == events.count()
    assert parts.select("participant_id", "part").distinct().count() > len(chats)


def test_stream_gives_the_same_steps(spark, tmp_path):
    chats = random_chats(12, people=12, events=30)
    src = str(tmp_path / "in")
    half = [[], []]
    for c in chats:
        half[0] += c.rows[:15]
        half[1] += c.rows[15:]
    for part in half:
        spark.createDataFrame([tuple(r[n] for n in NAMES) for r in part], EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    got = drain_to_table(session_stream(stream), "test").collect()
    assert plain([r.asDict() for r in got]) == plain([s for c in chats for s in c.steps()])


def test_messages(spark):
    chats = [Chat().photo(3, ["1"], [2, 3]).photo(4, ["5", "6", "7"]).select("5").photo(1, ["8"]).failed()]
    rows = sorted(sessions.accumulate(frame(spark, chats)).collect(), key=lambda r: r.event_id)
    assert [r.message for r in rows] == [
        "Found 1/3. Send a photo of box(es): [2, 3]",
        "Found 3 new barcodes but only 2 missing. Which one(s) to add? ['5', '6', '7']",
        "Found 2/4. Send a photo of box(es): [3]",
        "Found 3/4. Send another photo.", "Audit failed"]


def test_session_table_is_the_newest_step(spark):
    chats = [Chat().photo(3, ["1"], [2, 3]).photo(1, ["2"]).close()]
    events = frame(spark, chats)
    row, = sessions.session_table(sessions.accumulate(events)).collect()
    assert (row.status, row.found_count, row.missing_count, row.last_activity_us) == ("closed", 2, 1, 3 * MINUTE)


def test_session_left_active_expires(spark):
    chats = [Chat("cut").photo(3, ["1"], [2, 3]).photo(2, ["4"], [2], after=30 * MINUTE + 1),
             # the first photo after the limit fails, so nothing is cut there
             Chat("failed").photo(3, ["1"], [2, 3]).failed(after=31 * MINUTE).photo(2, ["4"], [2]),
             Chat("done").photo(1, ["1"]).photo(2, ["4"], [2], after=31 * MINUTE)]
    steps = sessions.accumulate(frame(spark, chats))
    assert sorted((r.participant_id, r.event_id, r.expired_id) for r in steps.filter("expired_id is not null").collect()) == [
        ("cut", 2, "web:cut:1"), ("failed", 2, "web:failed:1")]
    table = {r.session_id: (r.status, r.found_count, r.last_activity_us) for r in sessions.session_table(steps).collect()}
    assert table["web:cut:1"] == ("expired", 1, MINUTE) and table["web:cut:2"][0] == "active"
    assert table["web:failed:1"] == ("expired", 1, MINUTE) and table["web:failed:3"][0] == "active"
    assert table["web:done:1"][0] == "complete"
