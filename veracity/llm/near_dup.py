"""Near-duplicate documents with SuperMinHash signatures.

Every shingle of a document is hashed once and owns a random permutation of the
signature slots; the slot at rank j of that permutation is offered the value
``j + u`` with u in [0, 1).  A slot keeps its smallest offer.  Because one
permutation spreads a shingle over all slots, the slots are negatively
correlated and the estimate varies less than with independent hashes; and since
ranks only grow, a document is finished as soon as every slot holds a value
below the current rank (two or three ranks for a few hundred shingles).

Plan: signatures are made in one pass over the text; documents with the same
shingle set fall into one class by a map-side-combined minimum; the classes' signature
bands go through the shared steps of ``similar.py`` (collisions, pivots, exact
verification, components).  Every link rests on the exact Jaccard index of the full
sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import GOLDEN, U64, as_int64, binary_values, materialise, mix64, session_of
from veracity.llm.similar import (band_keys, bands_for, collisions, linked, long_lists, marks_of, node_weights,
                                  same_sets, set_lists, sketch_of)

SLOTS = 192
SLICE = 1 << 15     # shingles whose permutations are held at a time in a task
_FULL = np.iinfo(np.uint64).max


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence as
    one shingle when there are fewer words; empty without words."""
    words = (text or b"").lower().split()  # splits at x20 and x09-x0D alone
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    width = min(k, len(words))
    acc = np.full(len(h) - width + 1, width, U64)
    for i in range(width):
        acc = mix64(acc * GOLDEN + h[i:len(h) - width + 1 + i])
    return np.unique(acc)


def superminhash(hashes: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    """Offer the shingles ``hashes`` of documents ``doc`` to the signatures ``out``
    (documents x slots, rank in the high and fraction in the low 32 bits)."""
    m = out.shape[1]
    flat = out.reshape(-1)
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(hashes), m)).copy()
    steps = np.arange(1, m + 1, dtype=U64) * GOLDEN
    alive = np.arange(len(hashes))
    for rank in range(m):
        x = mix64(hashes[alive] + steps[rank])
        pick = rank + (((x >> U64(32)) * U64(m - rank)) >> U64(32)).astype(np.int64)
        slot = perm[alive, pick]
        perm[alive, pick] = perm[alive, rank]
        value = (U64(rank) << U64(32)) | (x & U64(0xFFFFFFFF))
        owner = doc[alive]
        np.minimum.at(flat, owner * m + slot, value)
        todo = out.max(axis=1) >= (U64(rank + 1) << U64(32))
        alive = alive[todo[owner]]
        if not len(alive):
            break


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of many sets, in slices of bounded memory."""
    out = np.full((len(sets), slots), _FULL, dtype=U64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + sizes[stop] <= SLICE):
            total += sizes[stop]
            stop += 1
        part = np.concatenate(sets[start:stop])
        owner = np.repeat(np.arange(stop - start), sizes[start:stop])
        for i in range(0, len(part), SLICE):
            superminhash(part[i:i + SLICE], owner[i:i + SLICE], out[start:stop])
        start = stop
    return out


def signature_table(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """id, th (text hash), n (set size), h1, h2 (128-bit set digest), keys (band keys), sketch."""
    session_of(docs)
    bands, rows = bands_for(threshold, SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(2), binary_values(batch.column(1))
            for i in range(0, len(texts), 256):
                sets = [shingle_set(t, k) for t in texts[i:i + 256]]
                sig = signatures(sets)
                h1 = [np.add.reduce(mix64(s ^ U64(1))) if len(s) else U64(0) for s in sets]
                h2 = [np.bitwise_xor.reduce(mix64(s + GOLDEN)) if len(s) else U64(0) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, len(sets)), hashes.slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(as_int64(np.array(h1, U64))), pa.array(as_int64(np.array(h2, U64))),
                    long_lists(band_keys(sig, bands, rows)), long_lists(sketch_of(sig)),
                ], names=["id", "th", "n", "h1", "h2", "keys", "sketch"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                      F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    return src.mapInArrow(run, "id long, th long, n long, h1 long, h2 long, keys array<long>, sketch array<long>")


def set_table(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles (the full set), marks (a bit map of the set) of the documents in ``nodes``."""
    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_values(batch.column(1))
            for i in range(0, len(texts), 256):
                sets = [shingle_set(t, k) for t in texts[i:i + 256]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(sets)), set_lists(sets), marks_of(sets)],
                                                 names=["node", "shingles", "marks"])

    src = (docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
           .join(nodes, "node", "left_semi")
           .groupBy("node").agg(F.max_by("text", F.xxhash64("text")).alias("text")))
    return src.mapInArrow(run, "node long, shingles array<long>, marks array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    sets of ``words``-word shingles (A-Z lower-cased, words split at ASCII white
    space).  ``component_id`` is the smallest id reachable over links, ``kept``
    marks it.  A null or wordless text has an empty set and is linked with
    nothing.  Rows that repeat an id share their result; when their texts differ,
    the text with the largest xxhash64 stands for the id.  A null id keeps its
    n_shingles and gets a null component and kept = true: it is linked with
    nothing.  An empty table gives an empty result.
    """
    digest = ["n", "h1", "h2"]
    sigs = materialise(signature_table(docs, id_col, text_col, words, percent / 100), "signatures")
    members = (sigs.where("id is not null").groupBy("id")
               .agg(F.max(F.struct("th", *digest)).alias("s")).select("id", "s.*").where("n > 0"))
    # written, so that the join below deals out both sides and can split a hot class
    classes = materialise(members.groupBy(*digest).agg(F.min("id").alias("node")), "digests")
    members = materialise(members.join(classes, digest).select("id", "node", "n"), "members")
    reps = (sigs.join(classes, digest).where("id = node")
            .select("node", "n", "keys", "sketch").dropDuplicates(["node"]))
    reps = materialise(reps, "classes")
    buckets = materialise(collisions(reps.select("node", F.explode("keys").alias("bucket"))), "buckets")
    weights = materialise(node_weights(buckets), "weights")
    sets = materialise(set_table(docs, id_col, text_col, weights.select("node"), words), "sets")
    facts = reps.select("node", "n", "sketch").join(sets.select("node", "marks"), "node")
    labels = linked(buckets, weights, lambda pairs: same_sets(pairs, sets, percent), facts, percent, SLOTS, rounds=1)

    own = members.join(labels, "node", "left").select(
        "id", "n", F.coalesce("component", "node").alias("component"))
    return (sigs.select("id", F.col("n").alias("own_n")).join(own, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n", F.when(F.col("id").isNull(), F.col("own_n")),
                                                          F.lit(0)).alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                         words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one of each group of near duplicates: the
    one with the smallest id.  Of rows that repeat an id one stays, with the text that
    stood for the id.  Rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, words=words, percent=percent)
    kept = found.where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    standing = (rows.join(kept, "__id", "left_semi").groupBy("__id")
                .agg(F.max_by("row", F.xxhash64(F.col(f"row.`{text_col}`").cast("string"))).alias("row")))
    return standing.select("row.*").unionByName(rows.where("__id is null").select("row.*"))
