"""T3 result reuse: one exact plan for all keys, hot or not.

Rule (per cache key, submissions in (ts, id) order): the first submission
computes and caches; a later one is a hit while ``ts < cached + ttl``; the
first one at or after ``cached + ttl`` recomputes and re-caches (a hit does
not renew the expiry).  The misses ("anchors") are the orbit of the key's first
submission under

    nxt(r) = the first submission with ts >= r.ts + ttl.

Plan: the submissions are range-partitioned on (key, ts, id), so a hot key is cut
into balanced, contiguous pieces, and numbered once (checkpoint).  Inside a piece
everything is array work: nxt by binary search, orbits by pointer doubling.  A key
inside one piece is done with that.  At most two keys of a piece cross its ends;
for them each row's *exit*, the last anchor of its orbit in the piece, is looked
up in the key's next piece that has a late enough row, which gives a jump table
from entry rows to entry rows.  Doubling over that table takes log2(pieces) rounds
and leaves one entry a piece (a table bounded by the number of pieces).  A last
pass over the pieces answers every submission from its piece's entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.session import ensure_checkpoint_dir, ship_package

_EPOCH = "1970-01-01 00:00:00"


def _micros(ts: str):
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(ts))


def next_rows(start: np.ndarray, t: np.ndarray, ttl: int) -> np.ndarray:
    """For rows sorted by (key, t): the first row of the same key with time >= t + ttl,
    or len(t).  ``start``: the first row of each key."""
    n = len(t)
    out = np.full(n, n, np.int64)
    if not n:
        return out
    ends = np.append(start[1:], n)
    low = int(t.min())
    width = int(t.max()) - low + ttl + 1
    each = max(1, (1 << 62) // width)       # keys whose shifted times fit 64 bits together
    for i in range(0, len(start), each):
        a, b = start[i], ends[min(i + each, len(start)) - 1]
        rank = np.repeat(np.arange(len(start[i:i + each])), (ends - start)[i:i + each])
        line = rank * width + (t[a:b] - low)
        found = a + np.searchsorted(line, line + ttl)
        last = np.repeat(ends[i:i + each], (ends - start)[i:i + each])
        out[a:b] = np.where(found < last, found, n)
    return out


def orbit(first: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Mark the rows reached from ``first`` by repeated ``nxt`` (pointer doubling)."""
    n = len(nxt)
    mark, jump, count = np.zeros(n + 1, bool), np.append(nxt, n), -1
    mark[first] = True
    while (now := int(mark[:n].sum())) != count:
        count = now
        mark[jump[np.flatnonzero(mark)]] = True
        jump = jump[jump]
    return mark[:n]


def exits(nxt: np.ndarray) -> np.ndarray:
    """The last row of every row's orbit."""
    here = np.arange(len(nxt))
    jump = np.where(nxt < len(nxt), nxt, here)
    while not np.array_equal(after := jump[jump], jump):
        jump = after
    return jump


def _piece(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """A whole piece: its table, the first row of each key, and the times."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    table = pa.Table.from_batches(rows).combine_chunks()
    key = table.column("key").combine_chunks().dictionary_encode()
    code = (key.chunk(0) if isinstance(key, pa.ChunkedArray) else key).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return table, start, table.column("t").to_numpy()


def _crossing(ranged: DataFrame) -> dict[str, list[tuple[int, int, int, int]]]:
    """key -> (piece, first time, last time, first id) of its pieces, for the keys that
    lie in several; at most two rows a piece, since only its first and last key can."""
    segments = ranged.groupBy("key", "piece").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min_by("event_id", F.struct("t", "event_id")).alias("first_id"))
    many = segments.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pieces = (ranged.agg(F.max("piece")).first()[0] or 0) + 1
    out: dict[str, list[tuple[int, int, int, int]]] = {}
    for r in segments.join(many, "key").take(2 * pieces):
        out.setdefault(r["key"], []).append((r["piece"], r["first_t"], r["last_t"], r["first_id"]))
    return {k: sorted(v) for k, v in out.items()}


def _entries(ranged: DataFrame, crossing: dict, ttl: int) -> dict[tuple[str, int], tuple[int | None, int | None]]:
    """(key, piece) -> (the row at which the orbit enters the piece, the anchor in force
    before it) of the crossing keys."""
    spark = ranged.sparkSession
    shared = spark.sparkContext.broadcast(crossing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _piece(batches)) is None:
            return
        table, start, t = whole
        keys, piece = table.column("key"), table.column("piece")[0].as_py()
        for a, b in zip(start, np.append(start[1:], len(t)), strict=True):
            if (parts := shared.value.get(key := keys[int(a)].as_py())) is None:
                continue
            own = t[a:b]
            leave = own[exits(next_rows(np.zeros(1, np.int64), own, ttl))]
            later = [p for p in parts if p[0] > piece]
            at = np.searchsorted(np.array([p[2] for p in later], np.int64), leave + ttl)
            to = np.append(np.array([p[0] for p in later], np.int64), -1)[at]
            yield pa.RecordBatch.from_arrays(
                [table.column("event_id").slice(a, b - a).combine_chunks(), pa.array([key] * (b - a), pa.string()),
                 pa.array(np.full(b - a, piece)), pa.array(own), pa.array(leave), pa.array(to)],
                names=["event_id", "key", "piece", "t", "leave", "to"])

    rows = ranged.select("event_id", "key", "t", "piece").mapInArrow(
        run, "event_id long, key string, piece long, t long, leave long, to long").checkpoint()
    probes = rows.where("to >= 0").select("key", F.col("to").alias("piece"), (F.col("leave") + ttl).alias("t")).distinct()
    both = rows.select("key", "piece", "t", "event_id").unionByName(
        probes.withColumn("event_id", F.lit(None).cast("long")))
    # backwards in time the last row met is the first one not before the probe
    back = (Window.partitionBy("key", "piece").orderBy(F.desc("t"), F.desc_nulls_last("event_id"))
            .rowsBetween(Window.unboundedPreceding, 0))
    met = (both.withColumn("entry", F.last("event_id", ignorenulls=True).over(back)).where("event_id is null")
           .select("key", F.col("piece").alias("to"), (F.col("t") - ttl).alias("leave"), "entry"))
    jump = rows.join(met, ["key", "to", "leave"]).select("event_id", "entry")
    first = spark.createDataFrame([(v[0][3],) for v in crossing.values()], "event_id long")
    nodes = jump.select(F.col("entry").alias("event_id")).unionByName(first).distinct()
    jump = jump.join(nodes, "event_id", "left_semi").checkpoint()
    reached, count = first.checkpoint(), 0
    while (now := reached.count()) != count:
        count = now
        step = reached.join(jump, "event_id").select(F.col("entry").alias("event_id"))
        reached = reached.unionByName(step).distinct().checkpoint()
        jump = (jump.alias("x").join(jump.alias("y"), F.col("x.entry") == F.col("y.event_id"))
                .select("x.event_id", "y.entry")).checkpoint()
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.join(reached, "event_id", "left_semi").take(sum(map(len, crossing.values()))):
        found.setdefault(r["key"], {})[r["piece"]] = (r["event_id"], r["leave"])
    out = {}
    for key, parts in crossing.items():
        force = None
        for piece, *_ in parts:
            entry, leave = found[key].get(piece, (None, None))
            out[key, piece] = (entry, force)
            force = leave if entry is not None else force
    return out


def reusable_results(submissions: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """T3 batch: is each submission (event_id, key, ts) answered from a result
    computed less than ``ttl_seconds`` before, and from when is that result?
    ``event_id`` must be unique and ``key`` not NULL."""
    spark = submissions.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    ttl = ttl_seconds * 1_000_000
    ranged = (submissions.select("event_id", F.col("key"), _micros("ts").alias("t"), "ts")
              .repartitionByRange("key", "t", "event_id").sortWithinPartitions("key", "t", "event_id")
              .withColumn("piece", F.spark_partition_id().cast("long")).checkpoint())
    crossing = _crossing(ranged)
    entries = spark.sparkContext.broadcast(_entries(ranged, crossing, ttl) if crossing else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _piece(batches)) is None:
            return
        table, start, t = whole
        n, first = len(t), start.copy()
        before = np.full(len(start), np.iinfo(np.int64).min)
        piece, ids, keys = table.column("piece")[0].as_py(), table.column("event_id").to_numpy(), table.column("key")
        ends = np.append(start[1:], n)
        for i in (0, len(start) - 1):        # only the outer keys can cross
            entry, force = entries.value.get((keys[int(start[i])].as_py(), piece), (ids[start[i]], None))
            at = np.flatnonzero(ids[start[i]:ends[i]] == entry) if entry is not None else []
            first[i] = start[i] + at[0] if len(at) else n
            before[i] = before[i] if force is None else force
        nxt = next_rows(start, t, ttl)
        anchor = orbit(first[first < n], nxt)
        latest = np.maximum.accumulate(np.where(anchor, np.arange(n), -1))
        own = np.repeat(start, ends - start)
        cached = np.where(latest >= own, t[latest], np.repeat(before, ends - start))
        yield pa.RecordBatch.from_arrays(
            [table.column(c).combine_chunks() for c in ("event_id", "key")]
            + [pa.array(t, pa.timestamp("us")), pa.array(~anchor), pa.array(cached, pa.timestamp("us"))],
            names=["event_id", "key", "ts", "hit", "cached_at"])

    return ranged.drop("ts").mapInArrow(
        run, "event_id long, key string, ts timestamp_ntz, hit boolean, cached_at timestamp_ntz")
