"""Sessions that end by themselves: an event-time timer for each, one row when it fires, no state after it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: seconds that a session lives after its last use.
SESSION_SECONDS = 86_400
SCHEMA = "session string, last_used timestamp, n_used long"


class Expiry(StatefulProcessor):
    """One session: when it was used last, how often, and the one timer that ends it."""

    def __init__(self, seconds: int):
        self.milliseconds = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("used", "last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get()
        last, n = held if held else (None, 0)
        before = last
        for frame in rows:
            if len(frame):
                newest = int(frame["ts"].max().timestamp() * 1000)
                last, n = newest if last is None else max(last, newest), n + len(frame)
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.milliseconds)
            self.handle.registerTimer(last + self.milliseconds)
        if last is not None:
            self.state.update((last, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get()
        self.state.clear()
        if held:
            yield pd.DataFrame({"session": [key[0]], "last_used": [pd.Timestamp(held[0], unit="ms")], "n_used": [held[1]]})

    def close(self) -> None:
        pass


def expired_stream(uses: DataFrame, *, seconds: int = SESSION_SECONDS, late: str = "1 minute") -> DataFrame:
    """session, last_used and n_used of each session that was not used for ``seconds`` of event time, once, when the watermark passes.

    uses: a stream of session (string) and ts (timestamp); rows later than ``late`` are dropped, as are rows without a
    session. A session that comes back later is a new one. Needs the RocksDB state store.
    """
    timed = uses.filter("session IS NOT NULL AND ts IS NOT NULL").select("session", "ts").withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(Expiry(seconds), SCHEMA, "Append", "EventTime")
