"""Toxicity scoring: a linear classifier over character n-grams scaled by naive
Bayes log-count ratios.

The n-grams (3 to 5 bytes of the lower-cased text) are hashed.  Over *all*
labelled training texts each hashed n-gram's toxic and other texts are counted;
its log-count ratio scales its presence, so that a logistic regression starts from
the naive Bayes answer and only corrects it.  The regression sees the n-grams with
the strongest evidence and is fitted on a bounded sample of the training texts.
Counting and scoring run in tasks; the driver sees the counts of the hash space
(bounded) and the sample's feature numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import binary_values, labelled_texts, session_of

HASH_BITS = 18
SPACE = 1 << HASH_BITS
LENGTHS = (3, 4, 5)
FEATURES = 4096          # n-grams the regression sees
SAMPLE = 12_000          # training texts the regression is fitted on, at most
SMOOTH = 1.0
PENALTY = 1e-5
STEPS = 500
BATCH_DOCS, BATCH_BYTES = 64, 1 << 20


def folded(text: bytes | None) -> np.ndarray:
    """Lower-cased (A-Z) bytes between two blanks."""
    return np.frombuffer(b" " + (text or b"").lower() + b" ", np.uint8)


def hashed_ngrams(b: np.ndarray) -> list[np.ndarray]:
    """Hash numbers in [0, SPACE) of the n-grams at every place, for each length."""
    code = b.astype(np.uint64)
    out, width = [], 1
    for n in LENGTHS:
        while width < n:
            code = (code[:-1] << np.uint64(8)) | b[width:]
            width += 1
        mixed = (code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        if len(code) <= 1:
            break
    return out


def groups_of(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < BATCH_DOCS and (stop == start or size < BATCH_BYTES):
            size += len(texts[stop] or b"")
            stop += 1
        yield start, stop
        start = stop


def document_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Over all rows (text, y): texts with each hashed n-gram by class, and the texts
    of each class.  A task sends the n-grams it met once, whatever its number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, SPACE + 1), np.int64)
        seen = np.zeros(SPACE, bool)
        for batch in batches:
            for t, y in zip(binary_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for ids in hashed_ngrams(folded(t)):
                    seen[ids] = True
                at = np.flatnonzero(seen)
                count[y, at] += 1
                count[y, SPACE] += 1
                seen[at] = False
        at = np.flatnonzero(count.sum(axis=0))
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[1, part]), pa.array(count[0, part])],
                                             names=["f", "yes", "no"])

    sums = (labelled.select("text", "y").mapInArrow(run, "f long, yes long, no long")
            .groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    table = sums.toArrow()  # at most SPACE + 1 rows
    f = table.column("f").to_numpy()
    yes, no = np.zeros(SPACE + 1, np.int64), np.zeros(SPACE + 1, np.int64)
    yes[f], no[f] = table.column("yes").to_numpy(), table.column("no").to_numpy()
    return yes[:SPACE], no[:SPACE], int(yes[SPACE]), int(no[SPACE])


@dataclass
class Model:
    """``at``: hashed n-gram -> feature or -1; ``weight``: of each feature."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: list[bytes | None], buffer: np.ndarray) -> np.ndarray:
        rows = buffer[:len(texts)]
        rows[:] = 0
        for row, t in zip(rows, texts, strict=True):
            for ids in hashed_ngrams(folded(t)):
                known = self.at[ids]
                row[known] = 1   # -1 marks the spare last column
        z = rows[:, :-1] @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def chosen(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, log-count ratios) with the strongest evidence: the ratio's
    size over its standard error.  The smallest numbers win ties."""
    rate_yes = (yes + SMOOTH) / (n_yes + 2 * SMOOTH)
    rate_no = (no + SMOOTH) / (n_no + 2 * SMOOTH)
    ratio = np.log(rate_yes / rate_no)
    error = np.sqrt(1 / (yes + SMOOTH) + 1 / (no + SMOOTH))
    strength = np.where(yes + no > 0, np.abs(ratio) / error, -1)
    order = np.argsort(-strength, kind="stable")[:features]
    order = np.sort(order[strength[order] > 0])
    return order, ratio[order]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    # a bound of the loss's curvature from the largest singular value
    v = np.ones(d, np.float32) / math.sqrt(max(d, 1))
    top = 0.0
    for _ in range(12):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1 / (0.25 * top / n + 0.25 + penalty)
    wy, by, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ wy + by, -30, 30)))
        g = (p - y).astype(np.float32)
        w2 = wy - rate * (x.T @ g / n + penalty * wy)
        b2 = by - rate * float(g.mean())
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wy, by = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def learn(labelled: DataFrame, *, features: int = FEATURES, sample: int = SAMPLE) -> Model:
    """Learn from rows (text, y in 0/1).  With one class or no row the score is the
    constant class share, 0 without any row."""
    session_of(labelled)
    labelled = labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                               F.col("y").cast("int").alias("y")).where("y in (0, 1)")
    yes, no, n_yes, n_no = document_counts(labelled)
    n = n_yes + n_no
    at = np.full(SPACE, -1, np.int32)
    if not n_yes or not n_no:
        return Model(at, np.zeros(0, np.float32), 60.0 if n_yes else -60.0)
    ids, ratio = chosen(yes, no, n_yes, n_no, features)
    at[ids] = np.arange(len(ids), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in binary_values(batch.column(2)):
                marks = np.unique(np.concatenate([at[x] for x in hashed_ngrams(folded(t))]))
                found.append(marks[marks >= 0])
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                    ends, pa.array(np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)))],
                names=["h", "y", "ids"])

    unit = (F.xxhash64("text") / F.lit(2.0 ** 64)) + F.lit(0.5)
    drawn = (labelled.select(unit.alias("h"), "y", "text").where(F.col("h") <= min(1.0, sample / n))
             .mapInArrow(run, "h double, y int, ids array<int>").orderBy("h", "y").limit(sample).toArrow())
    y = drawn.column("y").to_numpy().astype(np.float32)
    lists = drawn.column("ids").combine_chunks()
    x = np.zeros((len(y), len(ids)), np.float32)
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    x[owner, flat] = ratio[flat]
    scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
    w, b = fit_logistic(x / scale, y, PENALTY, STEPS)
    return Model(at, (w / scale * ratio).astype(np.float32), b)


def score(docs: DataFrame, model: Model, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """id, the extra columns, score; one row per input row.  A null text is scored as an empty one."""
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias(id_col), *extra, F.col(text_col).cast("string").alias("__text"))
    keep = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buffer = np.zeros((BATCH_DOCS, len(m.weight) + 1), np.float32)
        for batch in batches:
            texts = binary_values(batch.column(len(keep)))
            scores = [m.score(texts[a:b], buffer) for a, b in groups_of(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*keep, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id_col: str = "doc_id", label_col: str = "toxic", *, training: Column | None = None,
             threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, score in 0..1, predicted (1 if score >= threshold).

    Learns from the labelled documents where ``training`` holds (all by default);
    only the text is an input of a score.  Null, empty and very long texts are
    scored whole; rows that repeat an id are scored alone; an empty table gives no
    rows."""
    model = learn(labelled_texts(docs if training is None else docs.where(training), labels, id_col, text_col,
                                 label_id_col, label_col))
    return (score(docs, model, id_col, text_col)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
