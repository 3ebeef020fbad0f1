"""Importance resampling against features counted one by one; payload arithmetic; blocks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from veracity.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def features(t):
    w = fold(t)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, least=20, percent=25):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        f = features(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in f]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(fold(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = {id(r): k for k, r in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def result(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def sample(seed=1):
    rng = random.Random(seed)
    vocab = ["ab", "Cd", "Été", "x9", "lorem", "ipsum", "dolor", "straße", "日本", "éa"] + [f"w{i}" for i in range(200)]
    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", "  "]) for _ in range(n))
    return [(i, text(rng.randrange(90))) for i in range(150)], [text(30) for _ in range(12)]


def test_equals_brute_force(spark):
    docs, target = sample()
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    want = brute(docs, target)
    assert result(importance.importance_scores(d, t)) == want
    # blocks that cut texts give the same rows
    assert result(importance.importance_scores(d, t, block_bytes=64)) == want
    kept = importance.resample(d, t)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want if r[4]) and kept.columns == d.columns


def test_neighbours_follow_from_payloads():
    rng = np.random.default_rng(2)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 60)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 60)]
    crc = np.array([zlib.crc32(x) for x in a], np.uint32)
    got = importance.shifted(crc, np.array([len(x) for x in b])) ^ np.array([zlib.crc32(x) for x in b], np.uint32)
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_dictionary_matches_whole_words_only():
    words = importance.Dictionary({b"a", b"ab", b"aba", b"b", "é".encode()})
    by_number = {i: w for w, i in words.number.items()}
    text = "a ab   aba b é aba a".encode()
    assert [by_number[i] for i in words.scan(text)] == text.split()


def test_overlong_words(spark):
    docs = [(1, "x" * 5000 + " y " * 30), (2, "z " * 25 + "w" * 9000), (3, "x" * 5000)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    t = spark.createDataFrame([("y y z",)], "text string")
    for size in (4 << 20, 1500):
        assert result(importance.importance_scores(d, t, block_bytes=size)) == brute(docs, ["y y z"])


def test_edge_rows(spark, edge_docs, empty_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    target = spark.createDataFrame([("quick brown fox",), (None,), ("",)], "text string")
    assert result(importance.importance_scores(edge_docs, target)) == brute(docs, ["quick brown fox"])
    none = target.where("false")
    assert result(importance.importance_scores(edge_docs, none)) == brute(docs, [])
    assert importance.importance_scores(empty_docs, target).count() == 0
    assert importance.resample(empty_docs, target).columns == empty_docs.columns
    assert importance.resample(empty_docs, target).count() == 0
    all_ = importance.resample(edge_docs, target, percent=100)
    assert all_.columns == edge_docs.columns
    assert all_.count() == sum(len(fold(t)) >= 20 for _, t in docs)
    odd = spark.createDataFrame([(1, "a b " * 20)], "`x.y` int, `t.x` string")
    assert importance.importance_scores(odd, target, "x.y", "t.x").columns == ["x.y", "n_features", "weight", "score", "rank"]
