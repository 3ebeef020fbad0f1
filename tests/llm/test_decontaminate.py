"""Decontamination against a word-by-word search; spans; blocks; odd rows."""

from __future__ import annotations

import random
import re

from veracity.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items, window=13, share=20):
    out = {}
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for item, text in items:
            x = fold(text)
            n = min(window, len(x))
            wins = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j:j + n]) in wins:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(w))
    return out


def sample(seed=1):
    rng = random.Random(seed)
    vocab = ["ab", "cd", "Été", "x9", "lorem", "ipsum", "dolor", "straße"]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(length))) for n, length in
             enumerate([20, 30, 13, 5, 1, 14, 40])] + [(7, None), (8, " .. "), (None, "un item sans id"), (3, "zz yy xx ww")]
    docs = []
    for n in range(60):
        words = [rng.choice(vocab + ["other%d" % rng.randrange(50)]) for _ in range(rng.randrange(120))]
        if rng.random() < 0.5:
            item = rng.choice(items)[1] or ""
            cut = item.split(" ")[rng.randrange(3):]
            words[len(words) // 2:len(words) // 2] = cut
        docs.append((n, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + [(100, None), (101, ""), (102, "?!"), (103, "ZZ-yy xx/WW!")], items


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()}


def test_equals_brute_force(spark):
    docs, items = sample()
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert result(dc.contamination(d, b)) == brute(docs, items)


def test_blocks_give_the_same_result(spark):
    docs, items = sample(2)
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert result(dc.contamination(d, b, block_bytes=300)) == brute(docs, items)


def test_spans_are_cut(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "Keep. Alpha, beta; GAMMA then delta epsilon!"), (2, "alpha beta"), (3, None)],
                                 "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, items, mode="spans").collect()}
    assert got == {1: "Keep.  then !".replace("  then !", "  then !"), 2: "alpha beta", 3: None}


def test_documents_go_and_columns_stay(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id int, text string")
    kept = dc.decontaminate(edge_docs, items)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert 8 not in [r["doc_id"] for r in kept.collect()]
    assert dc.contamination(empty_docs, items).count() == 0
    none = spark.createDataFrame([], "item_id int, text string")
    assert dc.decontaminate(edge_docs, none).count() == edge_docs.count()
    assert dc.decontaminate(edge_docs, none, mode="spans").count() == edge_docs.count()
