"""Sharding by fixed virtual slots.

A record hashes into one of a fixed number of virtual slots.  Bytes and rows are
summed per slot (a map-side-combined aggregation to ``slots`` rows, whatever the
input).  A slot-to-shard map sends slots to shards; it is a small versioned
table: version 0 deals slots in turn, and rebalancing edits single entries,
moving slots from the fullest to the emptiest shard while that evens their bytes.
Records move only when their slot's entry is edited.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm._shared import materialise

SLOTS = 4096
SHARDS = 16


def record_slot(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: a hash of its id and text."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], slot_bytes: list[int], shards: int) -> list[tuple[int, int]]:
    """Edits (slot, new shard) that even out the shards' bytes.  Each edit moves, from
    the fullest to the emptiest shard, the slot whose bytes come closest to half
    their difference; it stops when no single move brings them closer."""
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(current):
        load[shard] += slot_bytes[slot]
        if slot_bytes[slot]:
            insort(held[shard], (slot_bytes[slot], slot))
    edits: dict[int, int] = {}
    while True:
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        at = bisect_left(held[high], (gap // 2, -1))
        near = [x for x in held[high][max(0, at - 1):at + 1] if 0 < x[0] < gap]
        if not near:
            return sorted(edits.items())
        size, slot = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
        held[high].remove((size, slot))
        insort(held[low], (size, slot))
        load[high] -= size
        load[low] += size
        edits[slot] = low


def grow(current: list[int], shards: int) -> list[tuple[int, int]]:
    """Edits that give a new shard (number ``shards``) its share of slots, taken
    evenly from the others; no slot moves between old shards."""
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(current):
        held[shard].append(slot)
    edits = []
    for _ in range(len(current) // (shards + 1)):
        most = max(range(shards), key=lambda s: (len(held[s]), -s))
        edits.append((held[most].pop(), shards))
    return sorted(edits)


def apply_edits(current: list[int], edits: list[tuple[int, int]]) -> list[int]:
    out = list(current)
    for slot, shard in edits:
        out[slot] = shard
    return out


def map_table(spark: SparkSession, versions: list[list[int]], label: str = "slot-map") -> DataFrame:
    """The stored map: version, slot, shard; one row per version and slot."""
    text = json.dumps([[s for s in v] for v in versions])
    rows = (spark.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<array<int>>")).alias("version", "m"))
            .select("version", F.posexplode("m").alias("v_slot", "shard")))
    return materialise(rows, label)


def _sized(docs: DataFrame, id_col: str, text_col: str, slots: int, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).cast("long").alias("text_crc32"),
                       record_slot(f"`{id_col}`", f"`{text_col}`", slots).alias("v_slot"), *more)


def balanced_map(sized: DataFrame, shards: int, slots: int) -> tuple[list[list[int]], list[int]]:
    """(map versions, rows of each slot) for sized rows: the first map and, if it can be
    evened, its rebalanced successor.  Only the ``slots`` sums reach the driver."""
    sums = sized.groupBy("v_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).take(slots)
    slot_bytes, slot_rows = [0] * slots, [0] * slots
    for r in sums:
        slot_bytes[r["v_slot"]], slot_rows[r["v_slot"]] = r["bytes"], r["n"]
    versions = [first_map(slots, shards)]
    edits = rebalance(versions[0], slot_bytes, shards)
    if edits:
        versions.append(apply_edits(versions[0], edits))
    return versions, slot_rows


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, map).  rows has one row per input row: id, size (UTF-8 bytes of the text
    plus 1), text_crc32, v_slot (virtual slot), shard, slot (place in the shard,
    gapless from 0), map_version.  map: version, v_slot, shard.

    A null text counts 0 bytes, a null id hashes as nothing beside its text.
    Rows that repeat id and text share a virtual slot and get places of their own.
    The law is ``bytes``: the map's last version evens the shards' sizes.  An empty
    table gives no rows and the unedited map.
    """
    spark = docs.sparkSession
    base = materialise(_sized(docs, id_col, text_col, slots), "sizes")
    versions, slot_rows = balanced_map(base, shards, slots)
    stored = map_table(spark, versions)
    latest = len(versions) - 1
    # a slot's rows take consecutive places after those of the shard's earlier slots
    start, offset = [0] * shards, [0] * slots
    for s, shard in enumerate(versions[-1]):
        offset[s] = start[shard]
        start[shard] += slot_rows[s]
    offsets = materialise(spark.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(offset)), "array<bigint>")).alias("v_slot", "first")), "offsets")
    place = F.row_number().over(Window.partitionBy("v_slot").orderBy("id", "text_crc32", "size"))
    rows = (base.withColumn("place", place)
            .join(stored.where(F.col("version") == latest).select("v_slot", "shard"), "v_slot")
            .join(offsets, "v_slot")
            .select(F.col("id").alias(id_col), "size", "text_crc32", "v_slot", "shard",
                    (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
                    F.lit(latest).alias("map_version")))
    return rows, stored


def with_shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = SHARDS,
               slots: int = SLOTS) -> DataFrame:
    """The documents with all their columns, and last ``v_slot`` and ``shard`` (replacing
    columns of these names).  Texts stay where they are: rows meet only the map."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("v_slot", "shard")]).alias("row")
    versions, _ = balanced_map(_sized(docs, id_col, text_col, slots), shards, slots)
    stored = map_table(docs.sparkSession, versions).where(F.col("version") == len(versions) - 1)
    return (docs.select(row, record_slot(f"`{id_col}`", f"`{text_col}`", slots).alias("v_slot"))
            .join(stored.select("v_slot", "shard"), "v_slot").select("row.*", "v_slot", "shard"))
