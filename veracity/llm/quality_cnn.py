"""Quality classification with a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 16 bytes run over the whole text, 4 bytes
apart.  Filter answers are max-pooled over chunks of 512 bytes that overlap by
half, so a document of any length is covered to its end.  A small hidden layer
turns each chunk's pooled answers into a badness, and the chunks are combined by a
softmax-weighted mean: the worst chunk speaks loudest.  One minus the logistic of
that is the document's probability of label 1.

The network is fitted on the driver on a bounded sample of labelled texts (drawn
by hash, ``SAMPLE`` texts of at most ``SAMPLE_BYTES`` bytes); scoring runs in tasks
in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import binary_values, session_of

DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 16, 4, 16, 16
BLOCK = 64                       # windows of a half chunk: 256 bytes
BLOCK_BYTES = BLOCK * STRIDE
SAMPLE, SAMPLE_BYTES = 4000, 1 << 16
STEPS, BATCH, RATE = 1500, 32, 4e-3
SLICE_BLOCKS = 2048              # half chunks that are convolved at a time: 512 kB of text


def padded(text: bytes | None) -> np.ndarray:
    """Bytes with zeros up to whole half chunks (one at least), and the last window's tail."""
    b = np.frombuffer(text or b"", np.uint8)
    blocks = max(1, -(-len(b) // BLOCK_BYTES))
    return np.concatenate([b, np.zeros(blocks * BLOCK_BYTES + WIDTH - STRIDE - len(b), np.uint8)])


def windows(b: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(b, WIDTH)[::STRIDE]


@dataclass
class Net:
    emb: np.ndarray      # 256 x DIM
    conv: np.ndarray     # WIDTH * DIM x FILTERS
    conv_b: np.ndarray
    hid: np.ndarray      # FILTERS x HIDDEN
    hid_b: np.ndarray
    out: np.ndarray      # HIDDEN
    out_b: np.ndarray    # 1

    @classmethod
    def start(cls, share_bad: float, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        bias = np.log(max(share_bad, 1e-3) / max(1 - share_bad, 1e-3))
        return cls(normal(256, DIM, scale=0.7), normal(WIDTH * DIM, FILTERS, scale=0.18),
                   np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32),
                   normal(HIDDEN, scale=0.1), np.full(1, bias, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.conv_b, self.hid, self.hid_b, self.out, self.out_b]

    def convolve(self, b: np.ndarray) -> np.ndarray:
        """Answers of the filters to all windows of padded bytes: windows x FILTERS."""
        e = self.emb[b].reshape(-1)
        n = (len(b) - WIDTH) // STRIDE + 1
        rows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4))
        return rows @ self.conv

    def pooled(self, b: np.ndarray) -> np.ndarray:
        """Half-chunk maxima of one padded text, slice by slice."""
        blocks = (len(b) - WIDTH + STRIDE) // BLOCK_BYTES
        out = np.empty((blocks, FILTERS), np.float32)
        for i in range(0, blocks, SLICE_BLOCKS):
            j = min(blocks, i + SLICE_BLOCKS)
            part = self.convolve(b[i * BLOCK_BYTES:j * BLOCK_BYTES + WIDTH - STRIDE])
            out[i:j] = part.reshape(j - i, BLOCK, FILTERS).max(axis=1)
        return out

    def head(self, halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Halves of several texts (``first``: where each begins) -> badness of each, and
        what the backward pass needs."""
        last = np.append(first[1:], len(halves)) - 1
        nxt = np.minimum(np.arange(len(halves)) + 1, np.repeat(last, last - first + 1))
        left = halves >= halves[nxt]
        chunk = np.where(left, halves, halves[nxt])
        act = np.maximum(chunk + self.conv_b, 0)
        h = np.tanh(act @ self.hid + self.hid_b)
        z = h @ self.out + self.out_b[0]
        n = last - first + 1
        top = np.repeat(np.maximum.reduceat(z, first), n)
        e = np.exp(z - top)
        s = e / np.repeat(np.add.reduceat(e, first), n)
        doc = np.add.reduceat(s * z, first)
        return doc, z, s, h, act, left, nxt

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        halves = [self.pooled(padded(t)) for t in texts]
        first = np.cumsum([0] + [len(x) for x in halves])[:-1]
        doc = self.head(np.concatenate(halves), first)[0].astype(np.float64)
        return 1 / (1 + np.exp(np.clip(doc, -60, 60)))

    def gradients(self, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Log loss of label 1 and its gradients, for padded texts."""
        wins = np.concatenate([windows(b) for b in texts])
        x = self.emb[wins].reshape(len(wins), -1)
        ans = (x @ self.conv).reshape(-1, BLOCK, FILTERS)
        at = ans.argmax(axis=1)
        halves = np.take_along_axis(ans, at[:, None, :], axis=1)[:, 0]
        n = np.array([len(b) // BLOCK_BYTES for b in texts])
        first = np.cumsum(np.append(0, n))[:-1]
        doc, z, s, h, act, left, nxt = self.head(halves, first)
        p_bad = 1 / (1 + np.exp(-doc))
        loss = -np.mean(np.where(y == 1, np.log(1 - p_bad + 1e-7), np.log(p_bad + 1e-7)))
        d_doc = (p_bad - (1 - y)) / len(y)
        dz = np.repeat(d_doc, n) * s * (1 + z - np.repeat(doc, n))
        d_out, d_out_b = h.T @ dz, np.array([dz.sum()])
        dh = dz[:, None] * self.out * (1 - h * h)
        d_hid, d_hid_b = act.T @ dh, dh.sum(axis=0)
        d_act = (dh @ self.hid.T) * (act > 0)
        d_half = np.where(left, d_act, 0)
        np.add.at(d_half, nxt, np.where(left, 0, d_act))
        picked = np.arange(len(halves))[:, None] * BLOCK + at
        rows = x[picked]                                          # halves x FILTERS x window
        d_conv = np.einsum("bf,bfk->kf", d_half, rows)
        d_rows = (d_half[:, :, None] * self.conv.T).reshape(-1, WIDTH, DIM)
        d_emb = np.zeros_like(self.emb)
        where = wins[picked].reshape(-1)
        flat = d_rows.reshape(-1, DIM)
        for k in range(DIM):
            d_emb[:, k] = np.bincount(where, weights=flat[:, k], minlength=256)
        return float(loss), [d_emb, d_conv, d_act.sum(axis=0), d_hid, d_hid_b, d_out, d_out_b]


def fit(texts: list[bytes], y: np.ndarray, *, steps: int = STEPS, seed: int = 7) -> Net:
    """Adam with a cosine rate over shuffled batches in the labels' natural shares, so
    that the probabilities stay calibrated."""
    y = y.astype(np.float32)
    net = Net.start(float(1 - y.mean()), seed)
    data = [padded(t) for t in texts]
    rng = np.random.default_rng(seed)
    params = net.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order, at = rng.permutation(len(data)), 0
    for step in range(1, steps + 1):
        if at + BATCH > len(order):
            order, at = rng.permutation(len(data)), 0
        pick = order[at:at + BATCH]
        at += BATCH
        _, grads = net.gradients([data[i] for i in pick], y[pick])
        rate = RATE * min(1.0, step / 50) * 0.5 * (1 + np.cos(np.pi * step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def learn(labelled: DataFrame, *, sample: int = SAMPLE, steps: int = STEPS) -> Net | float:
    """Fit on at most ``sample`` rows (text, y in 0/1) of at most SAMPLE_BYTES bytes:
    those with the smallest hashes of their text.  With one class the constant
    probability of label 1; 0.5 without any row."""
    rows = labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                           F.col("y").cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & (F.octet_length("text") <= SAMPLE_BYTES))
    n = rows.count()
    unit = (F.xxhash64("text") / F.lit(2.0 ** 64)) + F.lit(0.5)
    drawn = (rows.withColumn("h", unit).where(F.col("h") <= min(1.0, 1.2 * sample / max(n, 1) + 0.001))
             .orderBy("h", "y").limit(sample).select("text", "y").toArrow())
    y = drawn.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return fit(binary_values(drawn.column("text")), y, steps=steps)


def groups_of(texts: list[bytes | None], docs: int = 64, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and stop - start < docs and (stop == start or total < size):
            total += len(texts[stop] or b"")
            stop += 1
        yield start, stop
        start = stop


def score(docs: DataFrame, net: Net | float, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """id, the extra columns, score; one row per input row.  A null text is scored as an empty one."""
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(net)
    src = docs.select(F.col(id_col).alias(id_col), *extra, F.col(text_col).cast("string").alias("__text"))
    keep = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = binary_values(batch.column(len(keep)))
            found = (np.full(len(texts), m) if isinstance(m, float) else
                     np.concatenate([m.score(texts[a:b]) for a, b in groups_of(texts)] or [np.empty(0)]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(found)],
                                             names=[*keep, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}, score double")


def quality(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
            threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, score in 0..1 (higher: label 1 likelier), predicted
    (1 if score >= threshold).  Learns from ``labelled`` rows (text, y); only the
    text is an input of a score.  Null and empty texts are scored as a chunk of
    padding, long ones to their end; rows that repeat an id are scored alone; an
    empty table gives no rows."""
    return (score(docs, learn(labelled), id_col, text_col)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
