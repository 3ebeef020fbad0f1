"""Importance resampling towards a target, over words found by an Aho-Corasick dictionary.

Features are runs of one and two consecutive words, hashed to buckets by crc32.  The
distinct words of a block of texts form an Aho-Corasick dictionary, each bounded by a
delimiter on both sides, so that a word matches where it stands whole and nowhere else.
A word carries the CRC and the length of its bytes as payload: they are computed once a
distinct word.  The automaton scans the texts and emits payloads; the CRC of two
neighbours follows from theirs alone, crc(a b) = shift(crc(a), 1 + |b|) ^ crc(" b"), where
the shift by a number of zero bytes is linear over GF(2) and done for whole arrays.  So a
text is never cut into feature strings.

A block is bounded in bytes; a longer text is cut between words and carries its last
payload on.  Bucket counts of documents and target add up map-side (at most ``buckets``
rows a task), the gains of the buckets (a table of fixed size) go to all tasks, and a
second scan scores every document.  The draw is a distributed ranking of narrow rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import binary_values, materialise, session_of
from veracity.plans.ordered import dense_index

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
BLOCK_BYTES = 4 << 20    # text that one dictionary is made for
LONGEST = 1024           # bytes of a word in a dictionary; texts with a longer one are looked up word by word

# words are digits, a-z and everything beyond ASCII, after A-Z are lower-cased
_SPACED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _zero_byte_tables() -> list[np.ndarray]:
    """For each power of two: tables (4 x 256) that shift a CRC by so many zero bytes."""
    def step(v: int) -> int:
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        return v

    def times(columns: list[int], v: int) -> int:
        out = 0
        while v:
            out ^= columns[(v & -v).bit_length() - 1]
            v &= v - 1
        return out

    tables, columns = [], [step(1 << i) for i in range(32)]
    for _ in range(32):
        tables.append(np.array([[times(columns, b << (8 * k)) for b in range(256)] for k in range(4)], np.uint32))
        columns = [times(columns, c) for c in columns]
    return tables


_SHIFTS = _zero_byte_tables()
_SPACE = zlib.crc32(b" ")


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs, each moved on by n zero bytes."""
    crc, n = crc.astype(np.uint32), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> k) & 1)
        v, t = crc[at], _SHIFTS[k]
        crc[at] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return crc


class Dictionary:
    """Delimiter-bounded distinct words with their payloads."""

    def __init__(self, words: set[bytes]) -> None:
        self.number = {w: i for i, w in enumerate(words)}
        self.crc = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
        self.spaced_crc = np.fromiter((zlib.crc32(w, _SPACE) for w in words), np.uint32, len(words))
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w, i in self.number.items():
            if len(w) <= LONGEST:
                self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> list[int]:
        """The numbers of a text's words, in order; all of them are in the dictionary."""
        return [] if not len(self.automaton) else [i for _, i in self.automaton.iter(f" {text.decode('latin-1')} ")]


def _segments(texts: list[bytes | None], size: int) -> Iterator[tuple[int, bytes]]:
    """(row, folded text), long ones cut between words."""
    for row, text in enumerate(texts):
        folded = (text or b"").lower().translate(_SPACED)
        start = 0
        while len(folded) - start > size:
            cut = folded.rfind(b" ", start, start + size)
            cut = folded.find(b" ", start + size) if cut < 0 else cut
            if cut < 0:
                break
            yield row, folded[start:cut]
            start = cut + 1
        yield row, folded[start:] if start else folded


@dataclass
class Features:
    """Words and feature buckets of a block, with the rows that they belong to."""

    rows: np.ndarray
    buckets: np.ndarray
    words: np.ndarray = field(repr=False)   # rows of the block's words


def block_features(texts: list[bytes | None], buckets: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Features]:
    """The features of all texts, a block at a time; ``rows`` are places in ``texts``."""
    block: list[tuple[int, bytes]] = []
    size, before = 0, (-1, 0)
    for row, text in _segments(texts, block_bytes):
        if block and size + len(text) > block_bytes:
            found, before = _block(block, before, buckets)
            yield found
            block, size = [], 0
        block.append((row, text))
        size += len(text)
    if block:
        yield _block(block, before, buckets)[0]


def _block(block: list[tuple[int, bytes]], before: tuple[int, int], buckets: int) -> tuple[Features, tuple[int, int]]:
    """Features of one block; ``before``: (row, CRC) of the word before its first."""
    split = [text.split() for _, text in block]
    words = Dictionary(set().union(*split))
    long = [max(map(len, w), default=0) > LONGEST for w in split]
    ids = [[words.number[w] for w in ws] if odd else words.scan(text)
           for (_, text), ws, odd in zip(block, split, long, strict=True)]
    rows = np.repeat([row for row, _ in block], [len(i) for i in ids]).astype(np.int64)
    flat = np.fromiter((i for part in ids for i in part), np.int64, len(rows))
    crc = words.crc[flat]
    previous, previous_row = np.append(np.uint32(before[1]), crc), np.append(before[0], rows)
    pair = np.flatnonzero(previous_row[:-1] == rows)
    pairs = shifted(previous[pair], words.length[flat[pair]] + 1) ^ words.spaced_crc[flat[pair]]
    found = Features(np.append(rows, rows[pair]), (np.append(crc, pairs) % buckets).astype(np.int64), rows)
    return found, ((int(rows[-1]), int(crc[-1])) if len(rows) else before)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS,
                  block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Features of all texts by bucket.  A task sends a row a bucket at most."""
    session_of(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in block_features(binary_values(batch.column(0)), buckets, block_bytes):
                total += np.bincount(found.buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()     # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the buckets' smoothed shares, target to source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a Gumbel number drawn from ``<seed>:<id>``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, row: Column, id_: Column, text: Column, *, seed: int = SEED,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_features, weight, score) of every input row; ``row`` passes through."""
    spark = session_of(docs)
    shared, buckets = spark.sparkContext.broadcast(gain), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for found in block_features(binary_values(batch.column(2)), buckets, block_bytes):
                words += np.bincount(found.words, minlength=len(words))
                n += np.bincount(found.rows, minlength=len(n))
                np.add.at(total, found.rows, shared.value[found.buckets])
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(n), pa.array(weight)],
                                             names=["row", "noise", "n_words", "n_features", "weight"])

    rows = docs.select(row.alias("row"), noise(id_, seed).alias("noise"), text.cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return (rows.mapInArrow(run, f"row {kind}, noise long, n_words long, n_features long, weight long")
            .select("row", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")))


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      target_text_col: str = "text", *, buckets: int = BUCKETS, percent: int = PERCENT,
                      min_words: int = MIN_WORDS, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank.

    ``weight``: floored mean gain of the document's features (none: 0); ``score``: weight
    plus Gumbel noise of the id, so the highest scores are a draw without replacement by
    weight.  Of the N documents with ``min_words`` words the floor(percent * N / 100)
    highest are drawn and ranked from 1, ties to the smaller id (a null id counts as the
    empty string and comes last); the others' rank is null.

    A null text has no words.  Rows that repeat an id are scored and drawn each; rows alike
    in all have neighbouring ranks.  An empty table gives no rows; without a target all
    gains follow from the documents alone.  Extra columns of any name are ignored."""
    gain = gains(bucket_counts(docs, text_col, buckets, block_bytes), bucket_counts(target, target_text_col, buckets, block_bytes))
    id_ = F.col(f"`{id_col}`")
    rows = materialise(scored(docs, gain, id_, id_, F.col(f"`{text_col}`"), seed=seed, block_bytes=block_bytes), "scores")
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = able.select("*", (-F.col("score")).alias("by"), F.col("row").isNull().alias("no_id"))
    ranked = dense_index(order, ["by", "no_id", "row", "weight", "n_features"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    cols = [F.col("row").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(rest.select(*cols))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", *, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The drawn documents with all their columns (as ``importance_scores`` draws them;
    of rows alike in score and id all are drawn if one is).  Texts are not shuffled: the
    narrow scores give the last row drawn, and every document is compared with that."""
    gain = gains(bucket_counts(docs, text_col, buckets, block_bytes), bucket_counts(target, target_text_col, buckets, block_bytes))
    names = [F.col(f"`{c}`") for c in docs.columns]
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    narrow = materialise(scored(docs, gain, id_, id_, text, seed=seed, block_bytes=block_bytes)
                         .where(F.col("n_words") >= min_words).select((-F.col("score")).alias("by"), "row",
                                                                      F.col("row").isNull().alias("no_id")), "scores")
    drawn = narrow.count() * percent // 100
    place = ["by", "no_id", "row"]
    last = dense_index(narrow, place, "rank").where(F.col("rank") == drawn).select(F.struct(*place).alias("p")).take(1)
    rows = scored(docs, gain, F.struct(*names), id_, text, seed=seed, block_bytes=block_bytes).where(F.col("n_words") >= min_words)
    if not last:
        return rows.where("false").select("row.*")
    edge, own = last[0]["p"], F.col(f"row.`{id_col}`")
    before = F.lit(edge["no_id"]) & ~own.isNull()
    if edge["row"] is not None:
        before = ~own.isNull() & (own <= F.lit(edge["row"]))
    else:
        before = before | own.isNull()
    return rows.where((-F.col("score") < edge["by"]) | ((-F.col("score") == edge["by"]) & before)).select("row.*")
