"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams.

Benchmark items become windows of ``window`` consecutive normalised words (an
item with fewer words is one window).  The windows are held as integer rows over
the benchmark's own vocabulary with a sorted table of their hashes; that index is
broadcast.  A task maps the words of a batch of documents to vocabulary numbers
and looks only at runs of known words; a hash that is found is compared word by
word, so every hit is exact.  Documents are never shuffled.

The benchmark is measured before it is broadcast.  It is scanned in blocks of at
most ``block_bytes`` of text: one block is one pass; a larger benchmark takes one
pass a block, with the hits so far written to the shared folder in between.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import GOLDEN, U64, binary_values, materialise, mix64, session_of

WINDOW = 13
BLOCK_BYTES = 64 << 20
TASK_BYTES = 4 << 20   # text a task looks at in one go

# words are digits, a-z and everything beyond ASCII, after A-Z are lower-cased
_SPACED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACED).split()


def _hash_rows(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    acc = np.full(len(starts), length, U64)
    for r in range(length):
        acc = mix64(acc * GOLDEN + ids[starts + r].astype(U64))
    return acc


@dataclass
class Index:
    """Windows of one benchmark block: by length, their sorted hashes, their rows
    and the items they belong to."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[str | None, bytes | None]], window: int) -> Index:
        index = cls()
        found: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, text in items:
            ids = [index.vocab.setdefault(w, len(index.vocab)) for w in words_of(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i:i + n]), set()).add(item)
        for n, rows in found.items():
            matrix = np.array(list(rows), dtype=np.int64).reshape(len(rows), n)
            owners = np.empty(len(rows), dtype=object)
            owners[:] = [sorted(x for x in v if x is not None) for v in rows.values()]
            hashes = _hash_rows(matrix.reshape(-1), np.arange(len(rows)) * n, n)
            order = np.argsort(hashes, kind="stable")
            index.by_length[n] = hashes[order], matrix[order], owners[order]
        return index

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, owners) of all windows that occur in ``ids`` (-1:
        a word that the benchmark doesn't have, or a document's end)."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, (hashes, matrix, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            acc = _hash_rows(ids, starts, n)
            at = np.searchsorted(hashes, acc)
            same = at < len(hashes)
            same[same] = hashes[at[same]] == acc[same]
            starts, at = starts[same], at[same]
            exact = np.ones(len(starts), bool)
            for r in range(n):
                exact &= ids[starts + r] == matrix[at, r]
            yield n, starts[exact], owners[at[exact]]


def _scan(texts: list[bytes | None], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(first word of each document, words of each, hit flag of each word, items of each)."""
    lookup = index.vocab.get
    parts, counts = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ids = [lookup(w, -1) for w in words_of(t)]
        counts[k] = len(ids)
        ids.append(-1)
        parts.append(np.array(ids, dtype=np.int64))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]) if len(texts) else np.empty(0, np.int64)
    cover = np.zeros(len(ids) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for n, starts, owners in index.hits(ids):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + n, -1)
        for doc, owner in zip(np.searchsorted(first, starts, side="right") - 1, owners, strict=True):
            items[doc].update(owner)
    return first, counts, np.cumsum(cover[:-1]) > 0, items


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the stretches from the first to the last word of each run of hit words."""
    out, at, open_ = [], 0, None
    end = 0
    for flag, m in zip(hit, _WORD.finditer(text), strict=True):
        if flag and open_ is None:
            open_ = m.start()
        elif not flag and open_ is not None:
            out.append(text[at:open_])
            at, open_ = end, None
        end = m.end()
    if open_ is not None:
        out.append(text[at:open_])
        at = end
    return b"".join(out) + text[at:]


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and (stop == start or total + len(texts[stop] or b"") <= TASK_BYTES):
            total += len(texts[stop] or b"")
            stop += 1
        yield start, stop
        start = stop


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW,
                  share: int = 20, block_bytes: int = BLOCK_BYTES, clean_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted item ids as
    strings), contaminated; with ``clean_text`` also the text without its hit spans.

    A word is hit when it lies in an occurrence of a benchmark window;
    contaminated: n_hit > 0 and share * n_hit >= n_words.  A null text has no
    words (its clean text is null).  Benchmark items without words own no window;
    items that repeat an id count once, an item with a null id marks words but is
    not counted.  An empty benchmark hits nothing; an empty table gives no rows.
    """
    spark = session_of(docs)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.lit(None).cast("binary").alias("mask"), F.lit(0).cast("long").alias("n_words"),
                        F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    schema = state.schema
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = part.toArrow()
        index = spark.sparkContext.broadcast(Index.build(
            list(zip(rows.column("item").to_pylist(), binary_values(rows.column("text")), strict=True)), window))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = binary_values(batch.column(1))
                masks, had = batch.column(2).to_pylist(), batch.column(5).to_pylist()
                for i, j in _groups(texts):
                    first, counts, hit, found = _scan(texts[i:j], index.value)
                    new_masks, n_hit, new_items = [], [], []
                    for k in range(j - i):
                        flags = hit[first[k]:first[k] + counts[k]]
                        if masks[i + k] is not None:
                            flags = flags | np.unpackbits(np.frombuffer(masks[i + k], np.uint8),
                                                          count=counts[k]).astype(bool)
                        new_masks.append(np.packbits(flags).tobytes() if flags.any() else None)
                        n_hit.append(int(flags.sum()))
                        new_items.append(sorted(found[k].union(had[i + k])))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                         pa.array(new_masks, pa.binary()), pa.array(counts, pa.int64()),
                         pa.array(n_hit, pa.int64()), pa.array(new_items, pa.list_(pa.string()))],
                        names=["id", "text", "mask", "n_words", "n_hit", "items"])

        if blocks > 1 or clean_text:
            state = state.mapInArrow(run, schema)
            state = materialise(state, "contamination") if b + 1 < blocks else state
        else:  # one pass: the text need not come back
            def slim(batches, run=run):
                for batch in run(batches):
                    yield batch.select(["id", "n_words", "n_hit", "items"])
            state = state.mapInArrow(slim, "id {}, n_words long, n_hit long, items array<string>".format(
                schema["id"].dataType.simpleString()))

    out = state
    cols = [F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
            ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")]
    if clean_text:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, masks = binary_values(batch.column("text")), batch.column("mask").to_pylist()
                n = batch.column("n_words").to_pylist()
                fixed = [t if m is None else _without(t, np.unpackbits(np.frombuffer(m, np.uint8), count=c)).decode()
                         for t, m, c in zip(texts, masks, n, strict=True)]
                fixed = [t.decode() if isinstance(t, bytes) else t for t in fixed]
                at = batch.schema.get_field_index("text")
                yield batch.set_column(at, "text", pa.array(fixed, pa.string()))
        out = out.mapInArrow(cut, out.schema)
        cols.append(F.col("text").alias("clean_text"))
    return out.select(*cols)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  mode: str = "documents", **options) -> DataFrame:
    """The documents with all their columns, less what is contaminated: whole
    contaminated documents (``mode="documents"``) or the hit spans of every
    document (``mode="spans"``).  Every row is judged alone, so nothing is joined:
    rows that repeat an id keep their own verdict, and extra columns pass through."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode!r}")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                         F.col(f"`{text_col}`").alias("text"))
    judged = contamination(packed, benchmark, "row", "text", clean_text=mode == "spans", **options)
    if mode == "documents":
        return judged.where("not contaminated").select("row.*")
    return judged.select(*[(F.col("clean_text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])
