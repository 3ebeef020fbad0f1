"""Keyed state machines as streams (T1 with S13, T2, T3): ``transformWithState`` over
the RocksDB state store.

Each machine keeps one small row a key and a timer in event time that removes it once
the watermark has passed what it can still answer, so neither a trigger's cost nor the
state grows with what has been read before.  The watermark only drives the timers: the
event-time column is dropped before the state, so Spark filters no row, and a row that
comes too late to be answered is put out as such instead of vanishing.

* ``ReuseMachine`` (T3): the anchor of a cache key.
* ``LimitMachine`` (T2): how much of each of a client's open windows is used.
* ``ChangeMachine`` (T1 with S13): the last source and level of an article; what a change
  takes back is put out as -1 rows, what it adds as +1 rows.

Rows of a key that come in one trigger are taken in order; a trigger takes a bounded
number of files, and so a bounded number of a hot key's rows.  ``LimitMachine`` has few
keys with many rows: it holds a key's rows of a trigger as two arrays of longs and puts
out frames of bounded size (``transformWithStateInPandas``; the plain form gathers a
key's whole answer as Python objects before it sends any).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veracity.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400
ROWS_AT_ONCE = 1 << 14      # rows of a frame that a machine puts out

#: The limits of the scoring route, (seconds, requests).
REQUEST_LIMITS = [(60, 10), (3600, 50), (DAY, 200)]


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    ship_package(spark)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def micros(ts: str):
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def from_micros(t: str):
    return F.timestamp_add("MICROSECOND", F.col(t), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def with_event_time(rows: DataFrame, ts: str, watermark: str) -> DataFrame:
    """``rows`` with ``t`` (microseconds), under a watermark on ``ts``; no column that
    Spark would filter by."""
    timed = rows.withColumn("_ets", F.col(ts).cast("timestamp")).withWatermark("_ets", watermark)
    return timed.withColumn("t", micros(ts)).drop("_ets")


class Machine(StatefulProcessor):
    """One value state and one timer a key."""

    #: DDL of the state's row and of the output
    state_type: str
    output: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*[field.split()[0] for field in self.output.split(", ")])
        self.state = handle.getValueState("state", self.state_type)

    def set_timer(self, old_ms: int | None, new_ms: int) -> None:
        if old_ms != new_ms:
            if old_ms is not None:
                self.handle.deleteTimer(old_ms)
            self.handle.registerTimer(new_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- T3

class ReuseMachine(Machine):
    """The last row that computed (the anchor) and the last row seen.

    A row after the last one is answered by the anchor; one before it is late.  The anchor
    goes when the watermark has passed its expiry: any row that is not behind the watermark
    computes anew then, and one that is behind it is late."""

    state_type = "anchor long, t long, event_id long"
    output = "event_id long, key string, t long, hit boolean, cached long, late boolean"

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def _expiry(self, anchor: int | None) -> int | None:
        return None if anchor is None else -(-(anchor + self.ttl) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        was = self.state.get()
        first, last = (was[0], (was[1], was[2])) if was else (None, None)
        anchor, behind = first, timerValues.getCurrentWatermarkInMs() * 1000
        for t, event_id in sorted((r["t"], r["event_id"]) for r in rows):
            if (t, event_id) < last if last else t < behind:
                yield self.row(event_id, key[0], t, None, None, True)
                continue
            hit = anchor is not None and t < anchor + self.ttl
            anchor, last = anchor if hit else t, (t, event_id)
            yield self.row(event_id, key[0], t, hit, anchor, False)
        if last:
            self.state.update((anchor, *last))
            self.set_timer(self._expiry(first), self._expiry(anchor))


def reuse_stream(submissions: DataFrame, ttl_seconds: int = 3600, watermark: str = "1 day") -> DataFrame:
    """T3 over a stream of (event_id, key, ts): event_id, key, ts, hit, cached_at, late.
    Late rows have no answer, and the later answers of their keys do not know of them."""
    rows = with_event_time(submissions.select("event_id", "key", "ts"), "ts", watermark)
    machine = ReuseMachine(ttl_seconds)
    return (rows.select("event_id", "key", "t").groupBy("key")
            .transformWithState(machine, machine.output, "Append", "EventTime")
            .select("event_id", "key", from_micros("t").alias("ts"), "hit", from_micros("cached").alias("cached_at"), "late"))


# ---------------------------------------------------------------- T2

def check_nested(limits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The limits (seconds, requests) by window; each window must divide the next."""
    limits = sorted(limits)
    if not limits or any(b % a for (a, _), (b, _) in zip(limits, limits[1:])) or limits[0][0] < 1:
        raise ValueError(f"windows that do not divide each other: {limits}")
    return limits


class LimitMachine(Machine):
    """The start of each of a client's windows and the requests admitted in it.

    A request is admitted if every window has room, and is counted in all of them only
    then.  Requests are decided as they arrive; one whose smallest window a newer one has
    replaced, or whose largest window the watermark has closed, is late and undecided.  The
    counters go when the watermark closes the largest window."""

    output = "event_id long, known boolean, client string, t long, admitted boolean, refused_by long, late boolean"

    def __init__(self, limits: list[tuple[int, int]]) -> None:
        self.limits = [(seconds * 1_000_000, n) for seconds, n in check_nested(limits)]
        self.state_type = ", ".join(f"start{i} long, used{i} long" for i in range(len(self.limits)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was, widest = self.state.get(), self.limits[-1][0]
        start, used = (list(was[::2]), list(was[1::2])) if was else (None, None)
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        timer = (start[-1] + widest) // 1000 if start else None
        t, event_id, known = in_order(rows)
        for at in range(0, len(t), ROWS_AT_ONCE):
            piece, answers = slice(at, at + ROWS_AT_ONCE), []
            times = t[piece]
            for moment in times.tolist():
                now = [moment - moment % w for w, _ in self.limits]
                if now[0] < start[0] if start else now[-1] + widest <= closed:
                    answers.append((None, None, True))
                    continue
                used = [u if start and s == start[i] else 0 for i, (s, u) in enumerate(zip(now, used or now))]
                start = now
                full = next((w // 1_000_000 for (w, n), u in zip(self.limits, used) if u >= n), None)
                if full is None:
                    used = [u + 1 for u in used]
                answers.append((full is None, full, False))
            admitted, refused_by, late = (pd.Series(c, dtype=object) for c in zip(*answers))
            yield pd.DataFrame({"event_id": event_id[piece], "known": known[piece],
                                "client": pd.Series([key[0]] * len(times), dtype=object), "t": times,
                                "admitted": admitted, "refused_by": refused_by, "late": late})
        if start:
            self.state.update(tuple(x for pair in zip(start, used) for x in pair))
            self.set_timer(timer, (start[-1] + widest) // 1000)


def in_order(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, event_id, known) of the frames' rows, by t and event_id, unknown ids first:
    17 bytes a row."""
    types = {"t": "int64", "event_id": "int64", "known": "bool"}
    parts = [[pdf[c].astype(dtype).to_numpy() for c, dtype in types.items()] for pdf in rows]
    t, event_id, known = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((event_id, known, t))
    return t[order], event_id[order], known[order]


def limit_stream(requests: DataFrame, limits: list[tuple[int, int]], watermark: str = "1 day") -> DataFrame:
    """T2 over a stream of (event_id, client, ts): event_id, client, ts, admitted, refused_by
    (seconds of the smallest full window), late.  Late requests are neither admitted nor refused."""
    rows = with_event_time(requests.select("event_id", F.col("client").cast("string"), "ts"), "ts", watermark)
    machine = LimitMachine(limits)
    # a frame's column with a null would hold floats
    ids = [F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.col("event_id").isNotNull().alias("known")]
    return (rows.select(*ids, "client", "t").groupBy("client")
            .transformWithStateInPandas(machine, machine.output, "Append", "EventTime")
            .select(F.when(F.col("known"), F.col("event_id")).alias("event_id"), "client", from_micros("t").alias("ts"),
                    "admitted", "refused_by", "late"))


# ---------------------------------------------------------------- T1 with S13

class ChangeMachine(Machine):
    """An article's source and level, each with the sequence number that set it, and
    whether the article was inserted.  A change of lower number than what is held changes
    nothing, so the counters do not depend on the order of arrival; patches that come before
    their insert wait for it."""

    state_type = "source string, source_seq long, level string, level_seq long, inserted boolean"
    output = "source string, credibility_level string, change long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        was = self.state.get()
        source, source_seq, level, level_seq, inserted = was or (None, None, None, None, False)
        before = (source, level) if inserted else None
        for r in rows:
            inserted = inserted or r["inserts"]
            if (r["inserts"] or r["source"] is not None) and (source_seq is None or r["seq"] > source_seq):
                source, source_seq = r["source"], r["seq"]
            if (r["inserts"] or r["credibility_level"] is not None) and (level_seq is None or r["seq"] > level_seq):
                level, level_seq = r["credibility_level"], r["seq"]
        now = (source, source_seq, level, level_seq, inserted)
        if now != was:
            self.state.update(now)
        after = (source, level) if inserted else None
        if before != after:
            if before is not None:
                yield self.row(*before, -1)
            yield self.row(*after, 1)


def change_stream(changes: DataFrame) -> DataFrame:
    """T1 with S13 over a stream of inserts and patches (id, seq, inserts, source,
    credibility_level; a patch's NULL leaves alone; ``seq`` is the order of an article's
    changes, its insert first): source, credibility_level, change (+1 or -1)."""
    machine = ChangeMachine()
    return (changes.select("id", "seq", "inserts", "source", "credibility_level").groupBy("id")
            .transformWithState(machine, machine.output, "Append", "None"))


def counted_changes(changes: DataFrame) -> DataFrame:
    """Signed rows -> counter deltas per source; what is neither High nor Medium is low."""
    lv, n = F.col("credibility_level"), F.col("change")
    low = ~F.coalesce(lv.isin("High", "Medium"), F.lit(False))
    return changes.groupBy("source").agg(
        F.sum(F.when(lv == "High", n).otherwise(0)).alias("high"),
        F.sum(F.when(lv == "Medium", n).otherwise(0)).alias("medium"),
        F.sum(F.when(low, n).otherwise(0)).alias("low"), F.sum(n).alias("total_analyzed"))
