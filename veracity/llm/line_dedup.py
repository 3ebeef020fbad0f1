"""Fuzzy line deduplication by MinHash over character shingles.

A line is a stretch between newlines; it is compared as lower-cased (A-Z) UTF-8
bytes without outer white space, and known by the 64-bit hash of that.  Its
shingles are its 8-byte windows, each exactly one 64-bit number.  Signatures are
one-permutation MinHash: one hash a shingle picks the slot and competes in it, and
a slot that no shingle picked borrows from another slot that the slot's number and
the try decide (the same in every line).  The threshold decides the bands (sixteen of
four slots at 0.8, which find a pair there with probability 0.999); collisions, exact Jaccard verification and
components are the shared steps of ``similar.py``.  Of each component the first
line, by document id and place, is kept.

A task works on all lines of a batch of documents at once.  A line that repeats in a
batch, or that the task remembers to have sent (a table of fixed size, which may forget
but never err), isn't sent again; what tasks send twice counts once among the collisions.
Only lines that collide with another line send their text, found by a Bloom filter of
fixed size and an exact join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import GOLDEN, U64, as_int64, binary_values, materialise, mix64, session_of
from veracity.llm.similar import MARKS, band_keys, bands_for, collisions, linked, long_lists, node_weights, sketch_of

WIDTH = 8                  # bytes of a shingle
SLOT_BITS = 6
SLOTS = 1 << SLOT_BITS
PERCENT = 80
TASK_BYTES = 1 << 17       # text a task looks at in one go
SENT = 1 << 18             # lines that a task remembers to have sent, at most
FILTER_WORDS = 1 << 18     # 64-bit words of the Bloom filter of colliding lines: 2 MB, whatever the input
_FULL = np.iinfo(np.uint64).max


def lines_of(text: bytes | None) -> list[bytes]:
    """All lines of a text, normalised; blank ones are empty.  A null text has none."""
    return [] if text is None else [x.strip() for x in text.lower().split(b"\n")]


def line_ids(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), U64, len(lines))


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingles, line of each) of non-empty lines.  A line of fewer than WIDTH
    bytes is one shingle: its bytes after zeros."""
    lens = np.array([len(x) for x in lines], np.int64)
    short = np.flatnonzero(lens < WIDTH)
    codes = np.array([int.from_bytes(lines[i], "little") for i in short], U64)
    data = b"".join(lines)
    if len(data) < WIDTH:
        return codes, short
    inside = np.ones(len(data) + WIDTH, bool)       # windows that end in their line
    ends = np.cumsum(lens)
    for k in range(1, WIDTH):
        inside[np.maximum(ends - k, ends - lens)] = False
    every = np.ndarray((len(data) - WIDTH + 1,), "<u8", data, strides=(1,))
    owner = np.repeat(np.arange(len(lines)), np.maximum(lens - (WIDTH - 1), 0))
    return np.concatenate([every[inside[:len(every)]], codes]), np.concatenate([owner, short])


def signatures(codes: np.ndarray, owner: np.ndarray, lines: int) -> np.ndarray:
    """One-permutation MinHash signatures (lines x SLOTS)."""
    x = codes * GOLDEN
    x ^= x >> U64(32)
    x *= U64(0xBF58476D1CE4E5B9)
    slot = (x >> U64(64 - SLOT_BITS)).astype(np.int64)
    slot += owner << SLOT_BITS
    sig = np.full((lines, SLOTS), _FULL, U64)
    np.minimum.at(sig.reshape(-1), slot, x)
    own = sig != _FULL
    row, col = np.nonzero(~own)
    turn = 0
    while len(row):
        turn += 1
        pick = (mix64((col + turn * SLOTS).astype(U64) * GOLDEN) % U64(SLOTS)).astype(np.int64)
        found = own[row, pick]
        sig[row[found], col[found]] = sig[row[found], pick[found]]
        row, col = row[~found], col[~found]
    return sig


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < TASK_BYTES):
            size += len(texts[stop] or b"")
            stop += 1
        yield start, stop
        start = stop


def _distinct(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The distinct non-blank lines of some texts, and their ids."""
    found = list(dict.fromkeys(x for t in texts for x in lines_of(t) if x))
    return found, line_ids(found)


class _Sent:
    """The lines a task has sent, in a table where a newer line takes an older one's place."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(SENT, U64), np.zeros(SENT, bool)

    def new(self, ids: np.ndarray) -> np.ndarray:
        """Places of the distinct ``ids`` that aren't known to be sent; they are from now on."""
        at = (mix64(ids) % U64(SENT)).astype(np.int64)
        fresh = np.flatnonzero(~(self.used[at] & (self.ids[at] == ids)))
        self.ids[at[fresh]], self.used[at[fresh]] = ids[fresh], True
        return fresh


def _bands(docs: DataFrame, percent: int) -> DataFrame:
    """node, keys: the band keys of every line."""
    bands, rows = bands_for(percent / 100, SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for batch in batches:
            texts = binary_values(batch.column("text"))
            for a, b in _groups(texts):
                lines, ids = _distinct(texts[a:b])
                at = sent.new(ids)
                if len(at):
                    sig = signatures(*shingles([lines[i] for i in at]), len(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_int64(ids[at])), long_lists(band_keys(sig, bands, rows))], names=["node", "keys"])

    return docs.select("text").mapInArrow(run, "node long, keys array<long>")


def _bits(ids: np.ndarray) -> np.ndarray:
    """The two bits of each line in the filter."""
    return mix64(np.concatenate([ids ^ GOLDEN, ids + GOLDEN])) % U64(FILTER_WORDS * 64)


def _filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the nodes: it spares most other lines the shuffle,
    and the join after it is exact, so a full filter only costs time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column(0).to_numpy().view(U64)))
            yield pa.RecordBatch.from_arrays([pa.array(as_int64(bits >> U64(6))), pa.array(as_int64(U64(1) << (bits & U64(63))))],
                                             names=["word", "bit"])

    table = (nodes.select("node").mapInArrow(run, "word long, bit long").groupBy("word")
             .agg(F.bit_or("bit").alias("bits")).toArrow())     # at most FILTER_WORDS rows
    words = np.zeros(FILTER_WORDS, U64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(U64)
    return words


def _line_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, line of the lines in ``nodes``."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sent = shared.value, _Sent()
        for batch in batches:
            texts = binary_values(batch.column("text"))
            for a, b in _groups(texts):
                lines, ids = _distinct(texts[a:b])
                if not lines:
                    continue
                bits = _bits(ids)
                hit = ((words[bits >> U64(6)] >> (bits & U64(63))) & U64(1)).astype(bool)
                at = np.flatnonzero(hit[:len(ids)] & hit[len(ids):])
                at = at[sent.new(ids[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_int64(ids[at])), pa.array([lines[i] for i in at], pa.binary())], names=["node", "line"])

    found = docs.select("text").mapInArrow(run, "node long, line binary")
    return found.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.max("line").alias("line"))


def _facts(lines: DataFrame) -> DataFrame:
    """node, line -> node, n (shingles), sketch, marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _groups(texts):
                codes, owner = shingles(texts[a:b])
                sig = signatures(codes, owner, b - a)
                marks = np.zeros((b - a, MARKS), np.uint8)
                marks[owner, (mix64(codes) % U64(MARKS)).astype(np.int64)] = 1
                n = [len(_set_of(x)) for x in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), long_lists(sketch_of(sig)),
                     long_lists(np.packbits(marks, axis=1).view(U64))], names=["node", "n", "sketch", "marks"])

    return lines.mapInArrow(run, "node long, n long, sketch array<long>, marks array<long>")


def _set_of(line: bytes) -> np.ndarray:
    """The sorted distinct shingles of a line."""
    if len(line) < WIDTH:
        return np.array([int.from_bytes(line, "little")], U64)
    codes = np.sort(np.ndarray((len(line) - WIDTH + 1,), "<u8", line, strides=(1,)))
    first = np.empty(len(codes), bool)
    first[0] = True
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    return codes[first]


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose lines' shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, x = [], None, None
            for i, (la, lb) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if la != last:
                    last, x = la, _set_of(la)
                y = _set_of(lb)
                every = np.concatenate((x, y))
                every.sort()
                both = int(np.count_nonzero(every[1:] == every[:-1]))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    both = (pairs.select("a", "b").join(lines.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b")
            .join(lines.select(F.col("node").alias("a"), F.col("line").alias("la")), "a"))
    return both.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def _occurrences(docs: DataFrame) -> DataFrame:
    """id, line_no, node of every line that isn't blank."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_values(batch.column("text"))
            for a, b in _groups(texts):
                each = [lines_of(t) for t in texts[a:b]]
                flat = [x for lines in each for x in lines]
                no = np.concatenate([np.arange(len(x)) for x in each]) if each else np.empty(0, np.int64)
                doc = np.repeat(np.arange(a, b), [len(x) for x in each])
                full = np.flatnonzero(np.array([bool(x) for x in flat], bool))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc[full])), pa.array(no[full].astype(np.int64)),
                     pa.array(as_int64(line_ids([flat[i] for i in full])))], names=["id", "line_no", "node"])

    return docs.select("id", "text").mapInArrow(run, f"id {id_type}, line_no long, node long")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    session_of(docs)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                percent: int = PERCENT) -> DataFrame:
    """One row per line that isn't blank: id, line_no (from 0), line_id, group_id, kept.

    Lines are linked when 100 * intersection >= percent * union of their shingle sets;
    equal lines are one line.  ``group_id`` is the smallest line id reachable, ``kept``
    marks the group's first occurrence by (id, line_no).  Null ids come first; rows that
    repeat an id are told apart by nothing else, so their first lines are both kept.  Null,
    empty and blank texts have no rows here.  An empty table gives no rows.
    """
    src = _prepared(docs, id_col, text_col)
    rows = materialise(_bands(src, percent), "bands").select("node", F.explode("keys").alias("bucket"))
    buckets = materialise(collisions(rows), "buckets")
    weights = materialise(node_weights(buckets), "weights")
    texts = materialise(_line_texts(src, weights), "texts")
    facts = materialise(_facts(texts), "facts")
    labels = linked(buckets, weights, lambda pairs: _verified(pairs, texts, percent), facts, percent, SLOTS)

    occ = materialise(_occurrences(src), "lines").join(labels, "node", "left")
    occ = materialise(occ.select("id", "line_no", "node", F.coalesce("component", "node").alias("group_id")), "groups")
    firsts = materialise(occ.groupBy("group_id").agg(F.min(F.struct("id", "line_no")).alias("first")), "firsts")
    return (occ.join(firsts, "group_id")
            .select(F.col("id").alias(id_col), "line_no", F.col("node").alias("line_id"), "group_id",
                    (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.line_no") == F.col("line_no"))).alias("kept")))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                percent: int = PERCENT) -> DataFrame:
    """One row per id of ``docs``: id, n_lines (not blank), n_kept, dropped_lines (their numbers, sorted)."""
    lines = fuzzy_lines(docs, id_col, text_col, percent=percent)
    per = lines.groupBy(id_col).agg(
        F.count("*").alias("n_lines"), F.count_if("kept").alias("n_kept"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("dropped_lines"))
    per = per.withColumnRenamed(id_col, "__id")
    ids = docs.select(F.col(f"`{id_col}`").alias("__id")).distinct()
    joined = ids.join(per.withColumnRenamed("__id", "__of"), F.col("__id").eqNullSafe(F.col("__of")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("__id").alias(id_col), F.coalesce("n_lines", zero).alias("n_lines"),
                         F.coalesce("n_kept", zero).alias("n_kept"),
                         F.coalesce("dropped_lines", F.array().cast("array<bigint>")).alias("dropped_lines"))


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                     percent: int = PERCENT) -> DataFrame:
    """The documents with all their columns, their texts without the lines that are not
    kept (blank lines stay).  Rows that repeat an id are told apart by their text; of rows
    that repeat both, all keep the same lines."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    key = F.struct(id_.alias("id"), F.xxhash64(text).alias("h"))
    report = line_report(docs.select(key.alias("key"), text.alias("text")), "key", "text", percent=percent)
    report = report.where("n_kept < n_lines").select(F.col("key").alias("__id"), F.col("dropped_lines").alias("__gone"))
    # the same lines of rows that repeat id and text are one
    report = report.withColumn("__gone", F.array_distinct("__gone"))
    rows = docs.select(key.alias("__key"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(report, F.col("__key").eqNullSafe(F.col("__id")), "left").select("row", "text", "__gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if t is not None and gone:
                    drop = set(gone)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                out.append(t)
            yield batch.set_column(1, "text", pa.array(out, pa.string()))

    left = joined.mapInArrow(cut, joined.schema)
    return left.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
