"""Sessions as a stream: the batch step on keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from boxtally.operators.sessions import KEY, SESSION, STEPS, events_of, pack_session, rows_to_frame, step, unpack_session


class SessionProcessor(StatefulProcessor):
    """State of one participant: a map of the open sessions, and the session finished last.

    A session leaves the map when it completes, closes or expires; of the one finished last only its numbers stay,
    for a later close. So the state is as large as what is open. A batch writes the sessions it changed.
    Expiry is looked at when a photo comes, as in the batch plan: a timer would end sessions that the rules
    leave active. Events that arrive in one batch are applied in time order; across batches the order of arrival
    counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getMapState("open", "id string", f"place int, {SESSION}")
        self._current = handle.getValueState("current", f"id string, {SESSION}")

    def _load(self) -> tuple[dict, dict]:
        rows = sorted((value[0], key[0], tuple(value[1:])) for key, value in self._open.iterator())
        state = {"open": [unpack_session(id_, row) for _, id_, row in rows], "current": None}
        if (last := self._current.get()) is not None:
            # The session finished last may still be open; then it is that one.
            state["current"] = next((s for s in state["open"] if s["id"] == last[0]), None) or unpack_session(last[0], tuple(last[1:]))
        return state, {id_: (place, *row) for place, id_, row in rows}

    def _save(self, state: dict, before: dict) -> None:
        now = {s["id"]: (place, *pack_session(s)) for place, s in enumerate(state["open"])}
        for id_ in before.keys() - now.keys():
            self._open.removeKey((id_,))
        for id_, row in now.items():
            if before.get(id_) != row:
                self._open.updateValue((id_,), row)
        if state["current"] is not None:
            self._current.update((state["current"]["id"], *pack_session(state["current"], items=False)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, before = self._load()
        batch = pd.concat(list(rows)).sort_values(["t_us", "event_id"])
        out = [step(state, e) for e in events_of(batch)]
        self._save(state, before)
        yield rows_to_frame(out)

    def close(self) -> None:
        pass


def session_stream(events: DataFrame) -> DataFrame:
    """Steps of a stream of photo, selection and close events."""
    return events.groupBy(*KEY).transformWithStateInPandas(
        SessionProcessor(), outputStructType=STEPS, outputMode="append", timeMode="none")
