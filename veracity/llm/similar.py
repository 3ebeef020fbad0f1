"""From signatures to groups: the steps that near-duplicate documents and lines share.

``rows`` (bucket, node) are range-partitioned on (bucket, node), so that a bucket of
any size is cut into balanced pieces, and each piece finds its buckets by sorting (one
shuffle; a piece is a shuffle partition).  In a bucket, members are verified against one
pivot, the member that sits in the largest buckets, so a group of copies costs one
comparison a member and band, not one a pair.  Links form components.  What is still
unconnected inside a bucket is then compared pairwise, behind a sketch of the whole
signature whose cut lies 4.5 standard deviations below the threshold, and behind an
exact bound on the shingles that the two can share: of the pairs of a large group of
changed copies next to none get through that could not be linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm._shared import GOLDEN, U64, as_int64, materialise, mix64, session_of
from veracity.llm.components import components

SKETCH_BITS = 4     # bits of every slot in the sketch that guards verification
MARKS = 2048        # bits that mark a set's shingles, for an exact bound on what two sets share


def bands_for(threshold: float, slots: int, recall: float = 0.999) -> tuple[int, int]:
    """(bands, rows) of the most selective banding that finds a pair at the
    threshold with probability ``recall`` or more."""
    for rows in range(slots, 1, -1):
        bands = slots // rows
        if 1 - (1 - threshold ** rows) ** bands >= recall:
            return bands, rows
    return slots, 1


def sketch_limit(threshold: float, slots: int, bits: int = SKETCH_BITS) -> int:
    """Most differing sketch bits of a pair at the threshold (4.5 deviations)."""
    off = slots * (1 - threshold)
    mean = off * bits / 2
    var = slots * threshold * (1 - threshold) * (bits / 2) ** 2 + off * bits / 4
    return math.ceil(mean + 4.5 * math.sqrt(var))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLDEN, (len(sig), bands)).copy()
    cut = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    for r in range(rows):
        acc = mix64(acc * GOLDEN + cut[:, :, r])
    return acc


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits of every slot, packed (texts x 64-bit words)."""
    mixed = mix64(sig)
    planes = [((mixed >> U64(b)) & U64(1)).astype(np.uint8) for b in range(SKETCH_BITS)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1).view(U64)


def marks_of(sets: list[np.ndarray]) -> pa.Array:
    """A bit map of each set: bit (shingle mod MARKS)."""
    marks = np.zeros((len(sets), MARKS), np.uint8)
    for row, s in zip(marks, sets, strict=True):
        row[(s % U64(MARKS)).astype(np.int64)] = 1
    return long_lists(np.packbits(marks, axis=1).view(U64))


def long_lists(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of longs."""
    flat = as_int64(np.ascontiguousarray(a)).reshape(-1)
    return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(flat))


def set_lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(as_int64(np.concatenate(sets) if sets else np.empty(0, U64))))


def collisions(rows: DataFrame) -> DataFrame:
    """rows (bucket, node) -> the distinct ones of the buckets with two nodes or more.
    Rows that repeat a bucket and node sit in one piece, so they count once.  A piece's
    first and last bucket may be there with a single row."""
    session_of(rows)

    def shared(bucket: np.ndarray) -> np.ndarray:
        """Places of the rows of sorted buckets that hold several, or that a
        neighbouring piece may have more of."""
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(start, len(bucket)))
        show = size > 1
        show[[0, -1]] = True
        return np.flatnonzero(np.repeat(show, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if not parts:
            return
        bucket, node = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        del parts
        order = np.argsort(bucket)
        kept = order[shared(bucket[order])]
        bucket, node = bucket[kept], node[kept]
        order = np.lexsort((node, bucket))
        bucket, node = bucket[order], node[order]
        first = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))
        bucket, node = bucket[first], node[first]
        kept = shared(bucket)
        for i in range(0, len(kept), 1 << 16):
            at = kept[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(node[at])], names=["bucket", "node"])

    return (rows.select("bucket", "node").repartitionByRange("bucket", "node")
            .mapInArrow(run, "bucket long, node long"))


def node_weights(buckets: DataFrame) -> DataFrame:
    """node, weight: the rows of all buckets that a node sits in."""
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("size")), "bucket-sizes")
    return buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("weight"))


def linked(buckets: DataFrame, weights: DataFrame, verified: Callable[[DataFrame], DataFrame], facts: DataFrame,
           percent: int, slots: int, rounds: int | None = None) -> DataFrame:
    """(node, component) of all nodes that have a link: two nodes of a bucket whose
    pair ``verified`` (a, b) -> (a, b) lets pass, by 100 * |A and B| >= percent * |A or B|.

    ``facts``: node, n, sketch, marks, at least for the nodes in ``buckets``; all tables
    written ones.  ``rounds``: of the components between the two comparisons, which only
    say what needs no second one; where groups are few and tight, one is enough."""
    links = materialise(verified(_pivot_pairs(buckets, weights)), "links")
    labels = components(links, rounds)
    pairs = materialise(_open_pairs(buckets, facts, labels, percent, slots), "pairs")
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(pairs))
    return components(materialise(links, "links"))


def same_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, by sets (node, shingles)."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"),
                       (F.size("sa") + F.size("sb")).cast("long").alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets that hold two components or more."""
    named = (buckets.join(labels, "node", "left")
             .select("bucket", "node", F.coalesce("component", "node").alias("component")))
    split = (named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("bucket"))
    split = materialise(split, "open")   # dealt out anew, so that the join can be split at a large bucket
    return named.join(split, "bucket", "left_semi")


def _pivot_pairs(buckets: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b) = (pivot, other member) of every bucket; the pivot is the member with
    the largest weight, the smallest node on a tie."""
    weighed = buckets.join(weights, "node")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("p"))
    pivots = materialise(pivots.select("bucket", (-F.col("p.neg")).alias("a")), "pivots")
    return (buckets.select("bucket", F.col("node").alias("b")).join(pivots, "bucket")
            .where("a <> b").select("a", "b").distinct())


def _open_pairs(buckets: DataFrame, facts: DataFrame, labels: DataFrame, percent: int, slots: int) -> DataFrame:
    """Pairs of a bucket whose components still differ and that could reach the
    threshold by their sizes, their sketches and their marks.  Marks give an exact
    bound: what one set marks and the other doesn't is certainly not in both."""
    words, marks = slots * SKETCH_BITS // 64, MARKS // 64
    flat = facts.select("node", "n", "marks", *[F.expr(f"sketch[{i}] as w{i}") for i in range(words)])
    # the buckets of a node, at most one a band
    side = _open_buckets(buckets, labels).withColumn("buckets", F.collect_list("bucket").over(Window.partitionBy("node")))
    return _near_pairs(materialise(side.join(flat, "node"), "sides"), percent, slots, words, marks)


def _near_pairs(side: DataFrame, percent: int, slots: int, words: int, marks: int) -> DataFrame:
    """The pairs of ``side`` that a bucket has and that the bounds let pass.  A pair with
    several buckets comes from the first of them alone.

    The join's condition is compiled into one method, and the JVM interprets a method of
    more than 8000 bytes, at some hundred times the cost a pair.  So the words of the marks
    are columns that can't be null, and only the marks in both are counted: what a set
    marks alone is its count less those."""
    one = [f"m{i}" for i in range(marks)]
    side = side.select("*", *[F.expr(f"marks[{i}] as m{i}") for i in range(marks)])
    side = side.select("bucket", "node", "buckets", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
                                           ("component", "n", *[f"w{i}" for i in range(words)], *one)],
                       F.expr(" + ".join(f"bit_count(coalesce({c}, 0L))" for c in one)).alias("marked"))
    differ = " + ".join(f"bit_count(x.w{i} ^ y.w{i})" for i in range(words))
    both = " + ".join(f"bit_count(x.{c} & y.{c})" for c in one)
    x, y = side.alias("x"), side.alias("y")
    near = (F.col("x.bucket") == F.col("y.bucket")) & F.expr(
        f"x.component < y.component and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
        f" and {differ} <= {sketch_limit(percent / 100, slots)}"
        f" and {100 + percent} * (least(x.n - x.marked, y.n - y.marked) + {both}) >= {percent} * (x.n + y.n)"
        f" and array_min(array_intersect(x.buckets, y.buckets)) = x.bucket")
    return x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
