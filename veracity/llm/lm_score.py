"""Language-model scoring by deleted interpolation.

A token's probability after its predecessor is a mixture of the bigram and the
unigram maximum-likelihood estimates and a uniform share:

    p(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

with one set of weights for each bucket b of the context's frequency, log2 c(v).
The weights come from expectation-maximisation over held-out counts: every training
token is held out in turn by taking it out of the counts ("deleted"), so all of the
corpus serves for both counts and weights.

Counts are kept for the whole corpus and never meet in one place:

1. blocks of documents become token numbers over the block's own words;
2. a block's distinct words and bigrams travel, packed and sorted, to parts of the
   64-bit key space, where the training counts of all blocks are added up.  A part
   holds a fixed share of the corpus' text, however common a word is, since a key
   comes at most once from each block;
3. the totals travel back to the blocks that asked, and every token gets c(w) and c(v w);
4. the deleted estimates are counted on a fine logarithmic grid (a bounded table);
   the EM runs on that; then all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import GOLDEN, U64, binary_values, materialise, mix64, session_of

END = xxhash.xxh3_64_intdigest(b" end ")   # holds blanks, so no word is equal
BLOCK_BYTES = 8 << 20
PART_BYTES = 8 << 20       # text that a part of the key space stands for
BUCKETS = 48
GRID = 8                   # grid steps of an estimate for each factor of two
EM_ROUNDS = 60
LEAST = 1e-7               # least share of the uniform distribution


def packed(x: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype(U64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(U64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return packed(np.diff(keys, prepend=U64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=U64)


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, split at x20 and x09-x0D) and the end."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, U64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    out[-1] = END
    return out


def bigram_keys(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A key for each token and its predecessor; a text's first token follows the
    end before it, and the block's first token an end too."""
    seq = words[numbers]
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[:1] = END
    return mix64(mix64(before + GOLDEN) ^ (seq * GOLDEN))


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """block, ids, lens, train, words (the block's distinct words), numbers (of each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, train, seqs = [], [], []

        def done() -> pa.RecordBatch:
            words, numbers = np.unique(np.concatenate(seqs), return_inverse=True)
            # common words get small numbers, whose upper bytes vanish when packed
            uses = np.bincount(numbers, minlength=len(words))
            order = np.argsort(-uses, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            flat = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([base + k], pa.int64()), pa.ListArray.from_arrays([0, len(flat)], flat),
                pa.array([[len(s) for s in seqs]], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
                pa.array([packed(words[order])], pa.binary()), pa.array([packed(rank[numbers])], pa.binary())],
                names=["block", "ids", "lens", "train", "words", "numbers"])

        for batch in batches:
            column, flags = batch.column(0), batch.column(1).to_pylist()
            for i, t in enumerate(binary_values(batch.column(2))):
                ids.append(column.slice(i, 1))
                train.append(flags[i])
                seqs.append(tokens(t))
                size += len(t or b"") + 64
                if size >= BLOCK_BYTES:
                    yield done()
                    k, size = k + 1, 0
                    ids, train, seqs = [], [], []
        if seqs:
            yield done()

    return docs.mapInArrow(run, f"block long, ids array<{id_type}>, lens array<long>, train array<boolean>, "
                                "words binary, numbers binary")


def _part_cuts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts met, where each begins, where it ends) for sorted keys."""
    of = ((keys >> U64(32)) * U64(parts)) >> U64(32)
    met, first = np.unique(of, return_index=True)
    return met, first, np.append(first[1:], len(keys))


def _decoded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, numbers, training flag of each token) of a block."""
    return (unpacked(row["words"]), unpacked(row["numbers"]).astype(np.int64),
            np.repeat(np.array(row["train"], bool), row["lens"]))


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    """block, kind (1 words, 2 bigrams), part, keys, counts: the distinct keys of a
    block that fall into a part, and their training counts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, numbers, train = _decoded(row)
                order = np.argsort(words)
                uni = np.bincount(numbers[train], minlength=len(words))[order]
                bi, at = np.unique(bigram_keys(words, numbers), return_inverse=True)
                both = ((1, words[order], uni), (2, bi, np.bincount(at[train], minlength=len(bi))))
                for kind, keys, counts in both:
                    met, first, last = _part_cuts(keys, parts)
                    for i in range(0, len(met), 256):
                        cut = list(zip(met[i:i + 256], first[i:i + 256], last[i:i + 256], strict=True))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row["block"]] * len(cut), pa.int64()), pa.array([kind] * len(cut), pa.int32()),
                            pa.array([int(p) for p, _, _ in cut], pa.int64()),
                            pa.array([packed_keys(keys[a:b]) for _, a, b in cut], pa.binary()),
                            pa.array([packed(counts[a:b]) for _, a, b in cut], pa.binary())],
                            names=["block", "kind", "part", "keys", "counts"])

    return blocks.select("block", "lens", "train", "words", "numbers").mapInArrow(
        run, "block long, kind int, part long, keys binary, counts binary")


def _totals(requests: DataFrame) -> DataFrame:
    """block, kind, part, totals (training counts in the whole corpus, in the order of the
    block's keys); the first row of a part also has its types and tokens."""

    def add(table: pa.Table) -> pa.Table:
        keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(c) for c in table.column("counts").to_pylist()])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, counts.astype(np.int64))
        ends = np.cumsum([len(k) for k in keys])
        found = [packed(total[at[e - len(k):e]]) for k, e in zip(keys, ends, strict=True)]
        rest = [0] * (table.num_rows - 1)
        return pa.table({"block": table.column("block"), "kind": table.column("kind"), "part": table.column("part"),
                         "totals": pa.array(found, pa.binary()),
                         "types": pa.array([int((total > 0).sum()), *rest], pa.int64()),
                         "tokens": pa.array([int(total.sum()), *rest], pa.int64())})

    return requests.groupBy("kind", "part").applyInArrow(
        add, "block long, kind int, part long, totals binary, types long, tokens long")


def _counted(blocks: DataFrame, totals: DataFrame, n: int, v: int, id_type: str) -> DataFrame:
    """One row a block: ids, train, lens, n_known and base_score of its texts, and packed
    c1 and c2, the counts of each token and of its bigram."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["ids"]).to_pylist()[0]
        words, numbers, _ = _decoded(row)
        answers: dict[int, list[tuple[int, bytes]]] = {1: [], 2: []}
        for r in right.to_pylist():
            answers[r["kind"]].append((r["part"], r["totals"]))
        uni, bi = (np.concatenate([unpacked(t) for _, t in sorted(answers[kind])]).astype(np.int64)
                   for kind in (1, 2))
        by_number = np.empty(len(words), np.int64)
        by_number[np.argsort(words)] = uni
        c1 = by_number[numbers]
        c2 = bi[np.unique(bigram_keys(words, numbers), return_inverse=True)[1]]
        start = np.cumsum([0, *row["lens"]])[:-1]
        known = np.add.reduceat((c1 > 0).astype(np.int64), start)
        base = np.add.reduceat(np.log10((c1 + 1) / (n + (v + 1))), start)
        return pa.table({"ids": left.column("ids"), "train": left.column("train"), "lens": left.column("lens"),
                         "n_known": pa.array([known], pa.list_(pa.int64())),
                         "base_score": pa.array([base], pa.list_(pa.float64())),
                         "c1": pa.array([packed(c1)], pa.binary()), "c2": pa.array([packed(c2)], pa.binary())})

    return blocks.groupBy("block").cogroup(totals.select("block", "kind", "part", "totals").groupBy("block")).applyInArrow(
        join, f"ids array<{id_type}>, train array<boolean>, lens array<long>, n_known array<long>, "
              "base_score array<double>, c1 binary, c2 binary")


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its count), at most BUCKETS - 1."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def _flat(row: dict, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(c(w), c(v w), c(v), first token of each text) of a block's tokens."""
    one, two = unpacked(row["c1"]).astype(np.int64), unpacked(row["c2"]).astype(np.int64)
    start = np.cumsum([0, *row["lens"]])[:-1]
    context = np.empty_like(one)
    context[1:] = one[:-1]
    context[start] = docs   # a text's first token follows an end
    return one, two, context, start


def _grid(x: np.ndarray) -> np.ndarray:
    """0 for 0, else a positive grid number of an estimate in (0, 1]."""
    return np.where(x > 0, np.round(-np.log2(np.maximum(x, 1e-300)) * GRID) + 1, 0).astype(np.int64)


def _off_grid(g: np.ndarray) -> np.ndarray:
    return np.where(g > 0, 2.0 ** (-(g - 1) / GRID), 0.0)


def deleted_histogram(counted: DataFrame, n: int, docs: int) -> tuple[np.ndarray, ...]:
    """(bucket, bigram estimate, unigram estimate, tokens): all training tokens, each
    taken out of the counts it is estimated from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                one, two, context, _ = _flat(row, docs)
                train = np.repeat(np.array(row["train"], bool), row["lens"])
                one, two, rest = one[train], two[train], context[train] - 1
                bigram = np.where(rest > 0, (two - 1) / np.maximum(rest, 1), 0.0)
                unigram = (one - 1) / max(n - 1, 1)
                code = (bucket_of(rest) << 40) | (_grid(bigram) << 20) | _grid(unigram)
                codes, counts = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    table = (counted.select("train", "lens", "c1", "c2").mapInArrow(run, "code long, n long")
             .groupBy("code").agg(F.sum("n").alias("n")).toArrow())   # bounded by buckets and grid
    code, weight = table.column("code").to_numpy(), table.column("n").to_numpy().astype(np.float64)
    return code >> 40, _off_grid((code >> 20) & 0xFFFFF), _off_grid(code & 0xFFFFF), weight


def em_weights(bucket: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, weight: np.ndarray, v: int,
               rounds: int = EM_ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights (bigram, unigram, uniform).  A bucket without held-out tokens
    takes those of all tokens; one that has no bigram estimates has a bigram weight of 0."""
    parts = np.stack([bigram, unigram, np.full(len(bigram), 1 / (v + 1))], axis=1)

    def fit(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            mix = rows * lam
            mix /= mix.sum(axis=1, keepdims=True)
            lam = (mix * w[:, None]).sum(axis=0) / w.sum()
            lam = np.maximum(lam, [0, 0, LEAST])
            lam /= lam.sum()
        return lam

    pooled = fit(parts, weight) if len(weight) else np.array([0.0, 0.0, 1.0])
    out = np.tile(pooled, (BUCKETS, 1))
    for b in np.unique(bucket):
        mine = bucket == b
        out[b] = fit(parts[mine], weight[mine])
    out[0] = np.append(0.0, out[0, 1:] / out[0, 1:].sum())
    return out


@dataclass
class Model:
    """The global figures: N tokens, V types, training texts, mixture weights."""

    n: int
    v: int
    docs: int
    weights: np.ndarray

    def log10_tokens(self, one: np.ndarray, two: np.ndarray, context: np.ndarray) -> np.ndarray:
        lam = self.weights[bucket_of(context)]
        p = (lam[:, 0] * two / np.maximum(context, 1) + lam[:, 1] * one / max(self.n, 1) + lam[:, 2] / (self.v + 1))
        return np.log10(p)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
              training: Column | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``training`` holds (all by default).  ``base_score`` is
    the log10 probability under add-one unigrams, ``score`` that under the interpolated
    bigram model; an end follows every text and counts as a token, so a null, empty
    or blank text has one token.  Without training rows both are those of the uniform
    distribution over one type.  Rows that repeat an id are scored alone; an empty table gives
    no rows.
    """
    session_of(docs)
    src = docs.select(F.col(id_col).alias("id"),
                      F.coalesce((F.lit(True) if training is None else training).cast("boolean"), F.lit(False))
                      .alias("train"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    blocks = materialise(_blocks(src, id_type), "blocks")
    size = src.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    totals = materialise(_totals(_requests(blocks, max(1, -(-size // PART_BYTES)))), "totals")
    sums = totals.where("kind = 1").agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    counted = materialise(_counted(blocks, totals, n, v, id_type), "counted")
    texts = counted.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    model = Model(n, v, texts, em_weights(*deleted_histogram(counted, n, texts), v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = part.drop_columns(["ids"]).to_pylist()[0]
                one, two, context, start = _flat(row, model.docs)
                found = np.add.reduceat(model.log10_tokens(one, two, context), start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("ids").flatten(), pa.array(row["lens"], pa.int64()), pa.array(row["n_known"], pa.int64()),
                     pa.array(np.full(len(start), model.n)), pa.array(row["base_score"], pa.float64()), pa.array(found)],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (counted.select("ids", "lens", "n_known", "base_score", "c1", "c2")
            .mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
            .withColumnRenamed("id", id_col))
