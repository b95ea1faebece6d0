"""Sequential limits over time: an admission log per client, a spend cap per day, session expiry, append-only feedback.

A limiter's decision depends on its own earlier decisions, so it is a fold over a client's
requests in time order, not a range window. The batch form sorts each client's requests with
the shuffle and streams through them in Arrow batches, keeping only the admitted times inside
the window; the streaming form keeps the same times as state, until a timer finds the client idle.

The daily cap depends on one number, the tokens spent, so it needs no fold in one task: a day's operations are dealt in
ordered parts, each part is summarised as a step function from the tokens spent before it to those it spends, the
functions are composed along the day, and every part is then decided by itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.operators.numbering import dealt_in_order
from quarrylight.sources.shared import write_shared

#: Requests admitted within the window, and its seconds.
MOST, SECONDS = 20, 3600
#: Rows that a task hands on at once.
OUT_ROWS = 2000


class Admission:
    """Admits at most ``most`` requests within ``seconds``; refused requests leave no trace."""

    def __init__(self, most: int, seconds: float, times: list[float] | None = None):
        self.most, self.seconds, self.times = most, seconds, deque(times or ())

    def admit(self, at: float) -> bool:
        while self.times and at - self.times[0] > self.seconds:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at)
        return True


def _folded(rows: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Each row with ``step(state, row)`` as its last column, the rows of a key in order, state fresh for each key."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != last:
                    last, state = row[key], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "admitted"])

    sorted_rows = rows.repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.mapInArrow(run, schema)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", admitted boolean"


def limited(requests: DataFrame, *, most: int = MOST, seconds: float = SECONDS) -> DataFrame:
    """``requests`` (client, seconds as ``at``, request_id) with ``admitted``. Ties in time go by request_id."""
    return _folded(requests, "client", ["at", "request_id"], _schema(requests), lambda: Admission(most, seconds), lambda state, row: state.admit(row["at"]))


def spending(operations: Iterator[tuple[int, int]], *, daily: int, single: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of (estimate, actual) operations: from each of the first numbers on, the second is what they spend.

    An operation splits a step where its admission ends; equal neighbours are joined. Estimates are not negative, so
    nothing is spent above ``daily``: there are at most ``daily`` + 2 steps.
    """
    begins, spent = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for estimate, actual in operations:
        if estimate > single or actual == 0:
            continue
        last = daily - estimate - spent
        ends = np.append(begins[1:], np.iinfo(np.int64).max) - 1
        split = np.flatnonzero((last >= begins) & (last < ends))
        begins, spent, last = np.insert(begins, split + 1, last[split] + 1), np.insert(spent, split + 1, spent[split]), np.insert(last, split + 1, last[split])
        spent = spent + np.where(begins <= last, actual, 0)
        kept = np.append(True, spent[1:] != spent[:-1])
        begins, spent = begins[kept], spent[kept]
    return begins, spent


def _streamed(rows: DataFrame, keys: list[str], order: list[str], values: list[str], schema: str, run: Callable) -> DataFrame:
    """``run(iterator of (keys, values))`` over each task's rows, dealt by the first keys and sorted; yields tuples for ``schema``."""
    names = [*keys, *values]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield row[: len(keys)], row[len(keys) :]

        held = []
        for row in run(flat()):
            held.append(row)
            if len(held) == OUT_ROWS:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=columns), preserve_index=False)
                held = []
        if held:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(held, columns=columns), preserve_index=False)

    columns = [c.split()[0] for c in schema.split(", ")]
    return rows.select(*names, *order).repartition(*keys).sortWithinPartitions(*keys, *order).select(*names).mapInArrow(each, schema)


def capped(operations: DataFrame, *, daily: int, single: int) -> DataFrame:
    """``operations`` (day, seq, estimated_tokens, actual_tokens) with ``admitted``.

    An operation is refused if its estimate is over ``single`` or would bring the day over ``daily``;
    only admitted ones spend, at their actual tokens. A day of any number of operations is decided by many tasks; only
    one step function for each of its parts is followed in order.
    """
    placed = dealt_in_order(write_shared(operations, "operations"), "day", "seq").withColumn("__day", F.coalesce(F.col("day").cast("string"), F.lit("")))

    def summarised(rows):
        for part, own in groupby(rows, key=lambda r: r[0]):
            begins, spent = spending((values for _, values in own), daily=daily, single=single)
            yield (*part, begins.tolist(), spent.tolist())

    def started(rows):
        for day, parts in groupby(rows, key=lambda r: r[0]):
            total = 0
            for _, (part, begins, spent) in parts:
                yield (*day, part, total)
                total += int(spent[bisect_right(begins, total) - 1])

    steps = _streamed(placed, ["__day", "__part"], ["__row"], ["estimated_tokens", "actual_tokens"], "__day string, __part long, begins array<bigint>, spent array<bigint>", summarised)
    starts = _streamed(steps, ["__day"], ["__part"], ["__part", "begins", "spent"], "__day string, __part long, start long", started)

    def step(state: list[int], row: dict) -> bool:
        if state[0] is None:
            state[0] = row["start"]
        ok = row["estimated_tokens"] <= single and state[0] + row["estimated_tokens"] <= daily
        state[0] += row["actual_tokens"] if ok else 0
        return ok

    known = placed.join(write_shared(starts, "starts"), ["__day", "__part"]).withColumn("__key", F.concat_ws("/", "__day", F.col("__part").cast("string")))
    return _folded(known, "__key", ["__row"], _schema(known), lambda: [None], step).select(*operations.columns, "admitted")


class AdmissionProcessor(StatefulProcessor):
    """The limiter as a stateful processor: one client's admitted times.

    With ``forget``, a timer clears the state when the last of them has left the window: what it would decide then
    is what it decides without any.
    """

    def __init__(self, most: int, seconds: float, forget: bool = False):
        self.most, self.seconds, self.forget = most, seconds, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get()
        admission = Admission(self.most, self.seconds, list(held[0]) if held else None)
        batch = pd.concat(list(rows)).sort_values(["at", "request_id"])
        yield pd.DataFrame({"client": key[0], "request_id": batch["request_id"], "at": batch["at"], "admitted": [admission.admit(t) for t in batch["at"]]})
        self.state.update((list(admission.times),))
        if self.forget:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((max(admission.times) + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, *, most: int = MOST, seconds: float = SECONDS, late: str | None = None) -> DataFrame:
    """The limiter over a stream of client, request_id (long) and at (seconds); needs the RocksDB state store.

    With ``late``, event time is ``at``: requests later than that are dropped, and clients idle for ``seconds`` leave
    the state. Without it nothing is dropped and idle clients keep their last times.
    """
    timed = requests if late is None else requests.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return timed.groupBy("client").transformWithStateInPandas(AdmissionProcessor(most, seconds, late is not None), "client string, request_id long, at double, admitted boolean", "Append", "None" if late is None else "EventTime")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and type, batch or stream; late rows are dropped once the watermark has passed. events: ts, event_type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")


def append_feedback(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream of feedback rows to JSON lines; each batch is written once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def retry_delay(message: str, attempt: int, base: float = 2.0, chance: float = 0.5) -> float:
    """Seconds to wait before another attempt: the server's hint if it gives one, else doubling with jitter.

    ``chance`` is a number in [0, 1), drawn by the caller.
    """
    hint = re.search(r"retry(?:Delay|-after| in)\D{0,5}(\d+(?:\.\d+)?)", message, re.IGNORECASE)
    return float(hint[1]) if hint else base * 2**attempt * (0.5 + chance)
