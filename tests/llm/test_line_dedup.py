"""Fuzzy line deduplication against all pairs."""

from __future__ import annotations

import random

import numpy as np

from veracity.llm import line_dedup as ld
from veracity.llm import similar


def shingle_set(line: bytes) -> set[bytes]:
    return {line[i:i + 8] for i in range(len(line) - 7)} if len(line) >= 8 else {line}


def brute(docs, percent=80):
    """id -> numbers of the lines that go, and the lines that aren't blank."""
    occ = [(d, i, x) for d, t in sorted(docs, key=lambda r: r[0]) for i, x in enumerate(ld.lines_of(None if t is None else t.encode())) if x]
    lines = list(dict.fromkeys(x for _, _, x in occ))
    sets, root = {x: shingle_set(x) for x in lines}, {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for n, a in enumerate(lines):
        for b in lines[n + 1:]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[y] = x
    seen, gone = set(), {d: [] for d, _ in docs}
    for d, i, x in occ:
        if find(x) in seen:
            gone[d].append(i)
        seen.add(find(x))
    return gone, {d: sum(1 for o in occ if o[0] == d) for d, _ in docs}


def sample(seed=1):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "x1", "y22"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 40]))) for _ in range(12)]
    out = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("abcé ") + line[at + 1:]
            lines.append(rng.choice([line, line.upper() if line.isascii() else line, "  " + line + "\t", "short", "", " "]))
        out.append((d, "\n".join(lines)))
    return out + [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, "é")]


def test_dropped_lines_equal_all_pairs(spark):
    docs = sample()
    gone, n = brute(docs)
    got = {r["doc_id"]: r for r in ld.line_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert {d: r["dropped_lines"] for d, r in got.items()} == gone
    assert {d: r["n_lines"] for d, r in got.items()} == n
    assert all(r["n_kept"] == r["n_lines"] - len(r["dropped_lines"]) for r in got.values())


def test_shingles_of_many_lines_at_once():
    rng = random.Random(2)
    lines = [bytes(rng.randrange(97, 100) for _ in range(rng.choice([1, 3, 7, 8, 9, 30, 200]))) for _ in range(80)]
    codes, owner = ld.shingles(lines)
    for i, x in enumerate(lines):
        assert {int(c) for c in codes[owner == i]} == {int.from_bytes(s, "little") for s in shingle_set(x)}
        assert ld._set_of(x).tolist() == sorted({int(c) for c in codes[owner == i]})
    assert ld.shingles([b"abc"])[0].tolist() == [int.from_bytes(b"abc", "little")]


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 2**63, 20, dtype=np.int64).astype(np.uint64)])
        sig = ld.signatures(np.concatenate([a, b]), np.repeat([0, 1], 100), 2)
        errors.append((sig[0] == sig[1]).mean() - 80 / 120)
    assert abs(np.mean(errors)) < 0.02
    few = ld.signatures(a[:1], np.zeros(1, np.int64), 1)
    assert (few == few[0, 0]).all()      # a single shingle fills every slot


def test_texts_lose_the_lines(spark):
    docs = spark.createDataFrame([(1, "The first line of it all\n\nAnother line that differs"),
                                  (2, "keep me here\nthe first line of it all.\n  THE FIRST LINE OF IT ALL"), (3, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.drop_fuzzy_lines(docs).collect()}
    assert got == {1: "The first line of it all\n\nAnother line that differs", 2: "keep me here", 3: None}


def test_rows_that_repeat_an_id_are_told_apart(spark):
    rows = [(1, "alpha beta gamma delta\nsecond line of the first"), (1, "alpha beta gamma delta\ncompletely other content 123"),
            (None, "alpha beta gamma delta"), (2, "one more line here"), (2, "one more line here")]
    got = sorted((r["text"] for r in ld.drop_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    # the common line stays once (a null id comes first); no unique line goes
    assert sum("alpha" in t for t in got) == 1 and "alpha beta gamma delta" in got
    assert any("second line of the first" in t for t in got) and any("completely other content 123" in t for t in got)
    assert got.count("one more line here") == 2      # rows alike in id and text keep the same lines


def test_edge_rows(edge_docs, empty_docs):
    got = ld.line_report(edge_docs)
    assert got.count() == edge_docs.select("doc_id").distinct().count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[3]["n_lines"] == rows[4]["n_lines"] == rows[5]["n_lines"] == 0
    assert rows[12]["dropped_lines"] == [2, 3]
    cleaned = ld.drop_fuzzy_lines(edge_docs)
    assert cleaned.columns == edge_docs.columns and cleaned.count() == edge_docs.count()
    assert ld.line_report(empty_docs).count() == 0 and ld.drop_fuzzy_lines(empty_docs).count() == 0
    assert ld.fuzzy_lines(empty_docs).count() == 0


def test_pairs_at_the_threshold_become_candidates(spark):
    """Pairs of random lines whose Jaccard index is exactly 0.8 (one letter of 79 changed)."""
    rng = random.Random(8)
    docs = []
    for i in range(6000):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(79))
        at = rng.randrange(8, 71)
        docs += [(2 * i, line), (2 * i + 1, line[:at] + "#" + line[at + 1:])]
    a, b = shingle_set(docs[0][1].encode()), shingle_set(docs[1][1].encode())
    assert (len(a & b), len(a | b)) == (64, 80)
    found = ld.line_report(spark.createDataFrame(docs, "doc_id long, text string")).where("n_kept = 0").count()
    assert found >= 0.997 * 6000


def test_short_lines_near_the_threshold_become_candidates():
    """Candidates of pairs of few shingles, Jaccard index 0.8 or a little more, by a shared band."""
    rng = np.random.default_rng(9)
    for common, each in ((8, 1), (12, 1), (16, 2), (20, 2)):      # 8/10, 12/14, 16/20, 20/24
        hit = 0
        for _ in range(20):
            sets = rng.integers(0, 2**63, (100, common + 2 * each), dtype=np.int64).astype(np.uint64)
            a, b = sets[:, :common + each], np.concatenate([sets[:, :common], sets[:, common + each:]], axis=1)
            keys = [similar.band_keys(ld.signatures(x.reshape(-1), np.repeat(np.arange(100), x.shape[1]), 100),
                                      *similar.bands_for(0.8, ld.SLOTS)) for x in (a, b)]
            hit += int((keys[0] == keys[1]).any(axis=1).sum())
        assert hit >= 0.997 * 2000


def test_a_task_remembers_what_it_sent(monkeypatch):
    monkeypatch.setattr(ld, "SENT", 4)
    sent, rng = ld._Sent(), random.Random(10)
    ever: set[int] = set()
    for _ in range(200):
        ids = np.array(sorted({rng.randrange(12) for _ in range(5)}), np.uint64)
        fresh = {int(x) for x in ids[sent.new(ids)]}
        assert {int(x) for x in ids} - ever <= fresh      # it may send twice, never leave out
        ever |= {int(x) for x in ids}
    assert not len(sent.new(ids[-1:]))


def test_collisions_count_a_repeated_row_once(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(300), rng.randrange(40)) for _ in range(400)] + [(1000, 7)] * 500 + [(1001, x % 3) for x in range(500)]
    got = [tuple(r) for r in similar.collisions(spark.createDataFrame(rows, "bucket long, node long").repartition(8)).collect()]
    nodes: dict[int, set[int]] = {}
    for bucket, node in rows:
        nodes.setdefault(bucket, set()).add(node)
    wanted = {(b, n) for b, ns in nodes.items() if len(ns) > 1 for n in ns}
    assert len(got) == len(set(got)) and wanted <= set(got) <= set(rows)
    # besides those, a piece may show its first and last bucket
    assert len(set(got) - wanted) <= 2 * spark.sparkContext.defaultParallelism + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
