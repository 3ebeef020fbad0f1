"""SuperMinHash, components and near duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from veracity.llm import near_dup as nd
from veracity.llm import similar as sm
from veracity.llm._shared import U64, mix64
from veracity.llm.components import components


def naive_superminhash(hashes, m):
    """One shingle after another, one permutation at a time, without early stopping."""
    out = [float("inf")] * m
    for h in hashes:
        perm = list(range(m))
        for rank in range(m):
            x = int(mix64(np.array([h], U64) + np.array([rank + 1], U64) * nd.GOLDEN)[0])
            pick = rank + ((x >> 32) * (m - rank) >> 32)
            perm[rank], perm[pick] = perm[pick], perm[rank]
            out[perm[rank]] = min(out[perm[rank]], (rank << 32) | (x & 0xFFFFFFFF))
    return out


def test_signature_equals_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) for n in (1, 2, 7, 40)]
    got = nd.signatures(sets, 16)
    assert [[int(v) for v in row] for row in got] == [naive_superminhash(s, 16) for s in sets]


def test_signature_does_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n, dtype=np.int64).astype(U64) for n in (3000, 5, 900, 1)]
    whole = nd.signatures(sets)
    monkeypatch.setattr(nd, "SLICE", 128)
    assert (nd.signatures(sets) == whole).all()


def test_estimate_is_closer_than_independent_hashing():
    """Equal slots estimate the Jaccard index without bias and, for small sets, with
    less variance than independent slots would."""
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(150):
        a = rng.integers(0, 2**63, 30, dtype=np.int64).astype(U64)
        b = np.concatenate([a[:20], rng.integers(0, 2**63, 10, dtype=np.int64).astype(U64)])
        s = nd.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - 20 / 40)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * 0.25 / nd.SLOTS


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_banding_finds_pairs_at_the_threshold(threshold):
    bands, rows = sm.bands_for(threshold, nd.SLOTS)
    assert bands * rows <= nd.SLOTS and 1 - (1 - threshold ** rows) ** bands >= 0.999


def test_collisions_over_batches_and_pieces(spark):
    """Every bucket of two rows or more is whole, whatever the pieces and Arrow batches."""
    rng = random.Random(6)
    rows = [(rng.randrange(400), n) for n in range(700)] + [(1000, n) for n in range(300)] + [(n, 0) for n in range(2000, 2500)]
    size = {}
    for b, _ in rows:
        size[b] = size.get(b, 0) + 1
    old = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for batch, parts in ((7, 5), (1, 3), (10000, 1), (50, 40)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {(r["bucket"], r["node"]) for r in sm.collisions(
                spark.createDataFrame(rows, "bucket long, node long")).collect()}
            assert {x for x in rows if size[x[0]] > 1} <= got <= set(rows)
            assert len(got) <= sum(1 for x in rows if size[x[0]] > 1) + 2 * parts
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in parent}


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, k, percent):
    """id -> (set size, smallest id reachable) by comparing all pairs."""
    text = {}
    for i, t in rows:
        if i is not None:
            text.setdefault(i, t)
    sets = {}
    for i, t in text.items():
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        n = min(k, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * union:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=5):
    """Groups of edited copies (chains and stars), exact copies and loners."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(900)]
    rows, n = [], 0
    for size in (1, 1, 2, 5, 40):
        base = [rng.choice(vocab) for _ in range(rng.choice([60, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(9)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                base = words
            rows.append((n := n + 1, " ".join(words)))
            if rng.random() < 0.3:
                rows.append((n := n + 1, " ".join(words).upper().replace(" ", "\n")))
    return rows + [(n + 1, "a b"), (n + 2, "A  b"), (n + 3, "a"), (n + 4, None), (n + 5, "  "), (n + 6, "")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, k, percent):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(docs, words=k, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edge_rows(edge_docs):
    got = nd.near_duplicates(edge_docs, words=3, percent=85).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == {(by[1].copy().pop()[0], 1, True)} and {x[1:] for x in by[2]} == {(1, False)}
    assert by[3] == by[3] and {x for x in by[3]} == {(0, 3, True)} and by[5] == {(0, 5, True)}
    assert len(by[10]) == 1                       # rows of one id share one result
    assert {x[1:] for x in by[None]} == {(None, True)}


def test_drop_keeps_one_of_a_group_and_all_columns(edge_docs):
    got = nd.drop_near_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 2 not in ids and ids.count(10) == 1 and ids.count(None) == 2
    assert {1, 3, 4, 5, 6, 8, 11} <= set(ids)


def test_empty(empty_docs):
    assert nd.near_duplicates(empty_docs).count() == 0
    assert nd.drop_near_duplicates(empty_docs).columns == empty_docs.columns


def changed_copies(spark, words, n=40):
    """Rows of two buckets as ``_near_pairs`` takes them: sets that share more or less of one."""
    rng = random.Random(3)
    base, rows, sets = rng.sample(range(1, 1 << 60), 200), [], []
    for i in range(n):
        s = base[rng.randrange(30):] + rng.sample(range(1, 1 << 60), rng.randrange(30))
        sets.append(set(s))
        marks = sm.marks_of([np.array(s, U64)]).to_pylist()[0]
        held = [7, 9] if i % 3 else [9]
        rows += [(b, i, i // 2, held, len(set(s)), marks, *[int(i % 5 == 0)] * words) for b in held]
    schema = "bucket long, node long, component long, buckets array<long>, n long, marks array<long>, " + ", ".join(f"w{i} long" for i in range(words))
    return spark.createDataFrame(rows, schema), sets


@pytest.mark.parametrize("slots", [64, nd.SLOTS])
def test_the_comparison_of_pairs_is_compiled(spark, slots):
    """A method of more than 8000 bytes is interpreted, whatever the number of pairs."""
    words, was = slots * sm.SKETCH_BITS // 64, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        pairs = sm._near_pairs(changed_copies(spark, words)[0], 80, slots, words, sm.MARKS // 64)
        code = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "codegen")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    sizes = [int(x.split(";")[0]) for x in code.split("maxMethodCodeSize:")[1:]]
    assert "SortMergeJoin" in code and sizes and max(sizes) < 8000


def test_the_bound_of_the_marks(spark):
    side, sets = changed_copies(spark, 4)
    marked = [{x % sm.MARKS for x in s} for s in sets]
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets)
            if a // 2 < b // 2 and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y))
            and 180 * min(len(x) - len(marked[a] - marked[b]), len(y) - len(marked[b] - marked[a])) >= 80 * (len(x) + len(y))}
    got = [(r["a"], r["b"]) for r in sm._near_pairs(side, 80, 64, 4, sm.MARKS // 64).collect()]
    assert set(got) == want and len(got) == len(want)      # once, in however many buckets they meet
    close = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets)
             if a // 2 < b // 2 and 100 * len(x & y) >= 80 * len(x | y)}
    assert close and close <= want


def test_components_of_repeated_links_in_rounds(spark):
    links = [(i, i + 1) for i in range(40)] + [(i + 1, i) for i in range(10)] + [(100, 100), (None, 5), (7, None), (60, 61)] * 2
    table = spark.createDataFrame(links, "a long, b long")
    got = components(table).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(41)} | {60: 60, 61: 60} and len(got) == 43
    part = {r["node"]: r["component"] for r in components(table, 1).collect()}
    assert set(part) == {r["node"] for r in got} and part[61] == 60 and all(c <= n for n, c in part.items())
    assert len({r["component"] for r in components(table, 0).collect()}) > len(set(part.values()))
