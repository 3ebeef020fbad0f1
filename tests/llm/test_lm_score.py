"""Language-model scores against a dictionary version."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veracity.llm import lm_score as lm


def split(t):
    return [w.lower() if w.isascii() else w for w in (t or "").split()] + [None]


def brute(rows, training):
    """id -> (tokens, known, N, base, score), weights fitted on the same grid."""
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if training(i):
            w = split(t)
            uni.update(w)
            bi.update(zip([None, *w], w, strict=False))
    n, v, docs = sum(uni.values()), len(uni), uni[None]
    held = []
    for i, t in rows:
        if training(i):
            w = split(t)
            for a, b in zip([None, *w], w, strict=False):
                rest = uni[a] - 1
                held.append((rest, (bi[a, b] - 1) / rest if rest else 0.0, (uni[b] - 1) / (n - 1)))
    grid = lambda x: lm._off_grid(lm._grid(np.array([x])))[0]
    hist = Counter((int(lm.bucket_of(np.array([r]))[0]), grid(f2), grid(f1)) for r, f2, f1 in held)
    cols = np.array([[*k, c] for k, c in hist.items()]).T
    lam = lm.em_weights(cols[0].astype(int), cols[1], cols[2], cols[3], v)
    out = {}
    for i, t in rows:
        w, base, score = split(t), 0.0, 0.0
        for a, b in zip([None, *w], w, strict=False):
            base += math.log10((uni[b] + 1) / (n + v + 1))
            l2, l1, l0 = lam[int(lm.bucket_of(np.array([uni[a]]))[0])]
            score += math.log10(l2 * (bi[a, b] / uni[a] if uni[a] else 0) + l1 * uni[b] / n + l0 / (v + 1))
        out[i] = (len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out, docs, lam


def rows(seed=1, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % int(40 * rng.random() ** 3) for _ in range(200)] + ["É", "é", "THE", "the"]
    return [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(50)))) for i in range(n)] + [
        (n, None), (n + 1, ""), (n + 2, "\n never-seen \t")]


def test_scores_equal_the_dictionary_version(spark, monkeypatch):
    data = rows()
    want, _, _ = brute(data, lambda i: i % 4 != 2 and i < 150)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    training = (F.col("doc_id") % 4 != 2) & (F.col("doc_id") < 150)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    got = lm.lm_scores(docs, training=training).collect()
    assert len(got) == len(data)
    for r in got:
        t, k, n, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (t, k, n)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6 * max(1, abs(score))


def test_blocks_and_parts_do_not_change_the_scores(spark):
    docs = spark.createDataFrame(rows(2), "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 * max(1, abs(one[i])) for i in one)


def test_weights_make_a_distribution_and_fit():
    """EM never lowers the held-out likelihood, and each bucket's weights sum to 1."""
    rng = np.random.default_rng(3)
    bucket, f2 = rng.integers(0, 6, 500), rng.random(500) * (rng.random(500) < 0.6)
    f1, w = rng.random(500) * 0.1, rng.integers(1, 9, 500).astype(float)
    f2[bucket == 0] = 0
    last = -np.inf
    for rounds in (1, 5, 30, 100):
        lam = lm.em_weights(bucket, f2, f1, w, 99, rounds)
        assert np.allclose(lam.sum(axis=1), 1) and (lam[:, 2] > 0).all() and (lam[0, 0] == 0)
        now = (w * np.log((lam[bucket] * np.stack([f2, f1, np.full(500, 0.01)], 1)).sum(1))).sum()
        assert now >= last - 1e-9
        last = now


def test_probabilities_of_a_context_sum_to_one():
    uni, bi = np.array([5, 3, 2]), np.array([2, 1, 1])      # after a context seen 4 times
    model = lm.Model(10, 3, 1, lm.em_weights(np.array([2, 3]), np.array([0.5, 0.0]), np.array([0.2, 0.1]),
                                             np.array([3.0, 1.0]), 3))
    known = 10 ** model.log10_tokens(uni, bi, np.full(3, 4))
    new = 10 ** model.log10_tokens(np.array([0]), np.array([0]), np.array([4]))
    assert abs(known.sum() + new.sum() - 1) < 1e-12


def test_packing_round_trip():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], lm.U64)
    assert (lm.unpacked(lm.packed(x)) == x).all() and (lm.unpacked_keys(lm.packed_keys(x)) == x).all()
    assert len(lm.unpacked(lm.packed(x[:0]))) == 0


def test_edge_rows(edge_docs, empty_docs):
    got = lm.lm_scores(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    untrained = lm.lm_scores(edge_docs, training=F.lit(None).cast("boolean")).collect()
    assert {(r["n_known"], r["train_tokens"], r["score"]) for r in untrained} == {(0, 0, 0.0)}
    assert lm.lm_scores(empty_docs).count() == 0
