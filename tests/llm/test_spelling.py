"""Spelling variants against all pairs, and the keys against every single edit."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from veracity.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = "abcdé"


def fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def counts(docs, least=3):
    n = Counter()
    for key, text in docs:
        for run in RUN.findall(fold(text)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def sample(seed=1, n=300):
    rng = random.Random(seed)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 12))) for _ in range(60)]
    vocab = []
    for w in base:
        for _ in range(rng.randrange(1, 8)):
            vocab.append(w)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1:]])
    return [(i, rng.choice([" ", ", ", "-1-"]).join(rng.choice(vocab).upper() if rng.random() < .1 else vocab[int(rng.random() ** 3 * len(vocab))]
                                                    for _ in range(rng.randrange(80)))) for i in range(n)]


def test_equals_all_pairs(spark):
    docs = sample()
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    got, want = result(spelling.spelling_variants(df)), brute(counts(docs))
    assert got == want
    assert len({r for _, r, *_ in want.values()}) < len(want) and any(f is not None and f != r for f, r, *_ in want.values())


def test_every_single_edit_is_found_once(spark):
    rng = random.Random(3)
    words = set()
    for m in range(5, 14):
        w = "".join(rng.choice("abé") for _ in range(m))
        words |= {w} | {w[:i] + w[i + 1:] for i in range(m)} | {w[:i] + c + w[i:] for i in range(m + 1) for c in "abé\U0001F600"}
        words |= {w[:i] + c + w[i + 1:] for i in range(m) for c in "abé"}
    words = sorted(w for w in words if len(w) >= 5)
    df = spark.createDataFrame(list(enumerate(words, 1)), "id long, word string")
    got = Counter(tuple(sorted((words[r["a"] - 1], words[r["b"] - 1]))) for r in spelling.near_pairs(df).collect())
    want = {(x, y) for i, x in enumerate(words) for y in words[i + 1:] if one_edit(x, y)}
    assert set(got) == want and set(got.values()) == {1}


def test_no_side_of_the_words_is_broadcast(spark, tmp_path):
    """However small the words' file is: the sides made of it are many times its size."""
    rows = [(i, w, n) for i, (w, n) in enumerate([("abcdef", 9), ("abcdeg", 4), ("abcde", 3)], 1)]
    spark.createDataFrame(rows, "id long, word string, n long").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for df in (spelling.near_pairs(words), spelling.grouped_words(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_long_texts_are_counted_in_parts(spark, monkeypatch):
    docs = sample(4, 40)
    parts = [c for key, text in docs for c in spelling._text_words(str(key), text.encode(), re.compile("[a-zÀ-ÿ]{5,}"), 5, 97)]
    monkeypatch.setattr(spelling, "RUNS_AT_ONCE", 7)
    cut = [c for key, text in docs for c in spelling._text_words(str(key), text.encode(), re.compile("[a-zÀ-ÿ]{5,}"), 5, 97)]
    assert sum(parts, Counter()) == sum(cut, Counter()) and len(cut) > len(parts)


def test_an_altered_run_may_equal_another_run():
    # all runs are altered: the words of one text must not be altered twice
    text = b"abcdefg abcdef abcdeg bcdefg acdefg abdefg abcefg abcdfg"
    got = sum(spelling._text_words("1", text, re.compile("[a-z]{5,}"), 5, 1), Counter())
    want = Counter()
    for run in text.decode().split():
        h = zlib.crc32(f"1:{run}".encode())
        want[run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    assert got == want


def test_edge_rows(spark, edge_docs, empty_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(spelling.spelling_variants(edge_docs)) == brute(counts(docs))
    assert result(spelling.spelling_variants(edge_docs, min_count=1)) == brute(counts(docs, 1))
    assert spelling.spelling_variants(empty_docs).count() == 0
    few = spark.createDataFrame([(1, None), (2, ""), (3, "a b c 12")], "`x.y` int, `t.x` string")
    assert spelling.spelling_variants(few, "x.y", "t.x").count() == 0
