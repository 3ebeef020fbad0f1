"""Virtual slots: the map and its edits, places, sizes."""

from __future__ import annotations

import random
import zlib

from veracity.llm import sharding as sh


def check_rows(rows, texts, shards):
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        assert 0 <= r["shard"] < shards
    for s in range(shards):
        places = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert places == list(range(len(places)))


def test_sizes_are_even_and_places_gapless(spark):
    rng = random.Random(1)
    texts = {i: "é" * rng.choice([1, 5, 40, 300, 2000]) for i in range(2000)} | {5000: None, 5001: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows, stored = sh.shard_documents(docs, shards=16)
    got = rows.collect()
    check_rows(got, texts, 16)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 16
    versions = {(r["version"], r["v_slot"]): r["shard"] for r in stored.collect()}
    assert len(versions) == 2 * sh.SLOTS
    assert all(versions[0, s] == s % 16 for s in range(sh.SLOTS))
    assert all(versions[1, r["v_slot"]] == r["shard"] for r in got)


def test_a_slot_moves_only_by_an_edit():
    current = sh.first_map(64, 4)
    sizes = [100 if s % 4 == 0 else 10 for s in range(64)]
    edits = sh.rebalance(current, sizes, 4)
    after = sh.apply_edits(current, edits)
    moved = {s for s in range(64) if after[s] != current[s]}
    assert moved <= {s for s, _ in edits}
    load = [sum(sizes[s] for s in range(64) if after[s] == k) for k in range(4)]
    assert max(load) - min(load) <= 100
    assert sh.rebalance(after, sizes, 4) == []


def test_growing_moves_slots_only_into_the_new_shard():
    current = sh.first_map(4096, 16)
    after = sh.apply_edits(current, sh.grow(current, 16))
    assert all(b in (a, 16) for a, b in zip(current, after, strict=True))
    counts = [after.count(s) for s in range(17)]
    assert max(counts) - min(counts) <= 1


def test_edge_rows(edge_docs, empty_docs):
    rows, _ = sh.shard_documents(edge_docs, shards=4)
    got = rows.collect()
    assert len(got) == edge_docs.count()
    for s in range(4):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    whole = sh.with_shard(edge_docs, shards=4)
    assert whole.count() == edge_docs.count()
    assert whole.columns == [c for c in edge_docs.columns if c not in ("v_slot", "shard")] + ["v_slot", "shard"]
    assert sh.shard_documents(empty_docs)[0].count() == 0
    assert sh.with_shard(empty_docs).count() == 0


def test_hot_text_is_spread(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) as text")
    rows, _ = sh.shard_documents(docs, shards=4)
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) < 1.2 * min(counts)
