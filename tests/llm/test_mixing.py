"""Raking against numpy; calibrated sampling; odd rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np

from veracity.llm import mixing as mx


def brute(rows, fraction=0.5, rounds=200):
    """(id -> rate) for rows (id, source, lang, topic, tokens)."""
    cells = defaultdict(float)
    for _, *key, n in rows:
        cells[tuple(key)] += n
    total = sum(cells.values())
    wanted = []
    for d, power in enumerate((0.5, 0.7, 1.0)):
        sums = defaultdict(float)
        for key, n in cells.items():
            sums[key[d]] += n
        whole = sum(s**power for s in sums.values())
        wanted.append({v: fraction * total * s**power / whole for v, s in sums.items()})
    w = {key: fraction * n for key, n in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            fixed, free = defaultdict(float), defaultdict(float)
            for key, x in w.items():
                (fixed if x >= cells[key] else free)[key[d]] += min(x, cells[key])
            for key, x in w.items():
                t, f, g = wanted[d][key[d]], fixed[key[d]], free[key[d]]
                w[key] = min(x * ((t - f) / g if g and t > f else t / (f + g)), 1e6 * cells[key])
    return {i: min(w[tuple(key)] / cells[tuple(key)], 1.0) for i, *key, _ in rows}


def table(spark):
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        text = " ".join(["word"] * (1 + i % 17)) + (" | x" if i % 7 == 0 else "")
        rows.append((i, text, "en" if i % 4 else None, source))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_rates_equal_numpy(spark):
    got = mx.mix(table(spark)).collect()
    want = brute([(r["doc_id"], r["source"], r["lang"], r["topic"], r["n_tokens"]) for r in got])
    assert len(got) == 600 and {r["topic"] for r in got} == {"prose", "table"}
    for r in got:
        assert abs(r["rate"] - want[r["doc_id"]]) <= 1e-5 * want[r["doc_id"]]
        unit = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32
        assert r["sampled"] == (unit < r["rate"])


def test_given_targets_are_met(spark):
    # a quarter of the tokens is "(none)": three quarters of a mix of 0.3 exist
    got = mx.mix(table(spark), fraction=0.3, given={"lang": {"en": 1, "(none)": 3}}).collect()
    share = sum(r["rate"] * r["n_tokens"] for r in got if r["lang"] == "en") / sum(r["rate"] * r["n_tokens"] for r in got)
    assert abs(share - 0.25) < 0.01
    assert all(r["rate"] == 0 for r in mx.mix(table(spark), given={"lang": {"en": 1}}).collect() if r["lang"] != "en")


def test_given_targets_that_can_not_be_met_still_give_the_wanted_total(spark):
    got = mx.mix(table(spark), given={"lang": {"en": 1, "(none)": 3}}).collect()
    total = sum(r["n_tokens"] for r in got)
    assert all(r["rate"] == 1 for r in got if r["lang"] == "(none)")
    assert abs(sum(r["rate"] * r["n_tokens"] for r in got) / total - 0.5) < 0.01


def test_sample_has_the_expected_tokens(spark):
    got = mx.mix(table(spark)).collect()
    want = sum(r["rate"] * r["n_tokens"] for r in got)
    have = sum(r["n_tokens"] for r in got if r["sampled"])
    assert abs(have - want) < 5 * np.sqrt(sum(r["rate"] * (1 - r["rate"]) * r["n_tokens"] ** 2 for r in got))


def rare_table(spark, hot=2000, rare=5, words=25):
    text = " ".join(["word"] * words)
    return spark.createDataFrame([(i, text, "en", "hot" if i < hot else "rare") for i in range(hot + rare)],
                                 "doc_id long, text string, lang string, source string")


def test_a_source_too_small_for_its_target_leaves_its_share_to_others(spark):
    docs = rare_table(spark)
    got = mx.mix(docs).collect()
    rates = {r["source"]: r["rate"] for r in got}
    assert rates["rare"] == 1.0 and all(r["sampled"] for r in got if r["source"] == "rare")
    total = sum(r["n_tokens"] for r in got)
    assert abs(sum(r["rate"] * r["n_tokens"] for r in got) - 0.5 * total) < 1
    report = {(r["dimension"], r["value"]): r for r in mx.marginals(docs).collect()}
    assert set(report) == {("source", "hot"), ("source", "rare"), ("lang", "en"), ("topic", "prose")}
    rare = report["source", "rare"]
    assert rare["tokens"] == rare["expected"] == 125 and rare["shortfall"] == rare["wanted"] - 125 > 1000
    assert abs(report["source", "hot"]["shortfall"] + rare["shortfall"]) < 1
    assert abs(report["lang", "en"]["shortfall"]) < 1


def test_capped_rates_equal_numpy_with_several_capped_cells(spark):
    rows = [(i, "word " * (1 + i % 9) + (" | x" if i % 50 == 0 else ""), "en" if i % 40 else "de",
             "hot" if i % 100 else f"r{i % 300}") for i in range(3000)]
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = brute([(r["doc_id"], r["source"], r["lang"], r["topic"], r["n_tokens"]) for r in got])
    assert any(r["rate"] == 1 for r in got) and any(r["rate"] < 1 for r in got)
    for r in got:
        assert abs(r["rate"] - want[r["doc_id"]]) <= 1e-4 * want[r["doc_id"]]


def test_small_rates_are_not_rounded_away(spark):
    got = mx.mix(rare_table(spark), fraction=1e-8).collect()
    assert all(0 < r["rate"] < 1e-5 for r in got)


def test_everything_wanted_takes_everything(spark):
    got = mx.mix(table(spark), fraction=2.0).collect()
    assert len(got) == 600 and all(r["rate"] == 1 and r["sampled"] for r in got)
    assert mx.sample_mix(table(spark), fraction=0.0).count() == 0


def test_sample_mix_keeps_the_sampled_rows(spark):
    docs = table(spark)
    want = {r["doc_id"] for r in mx.mix(docs).collect() if r["sampled"]}
    got = mx.sample_mix(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want


def test_edge_rows(edge_docs, empty_docs):
    assert mx.mix(edge_docs).count() == edge_docs.count()
    assert mx.sample_mix(edge_docs).columns == edge_docs.columns
    assert mx.mix(empty_docs).count() == 0 and mx.sample_mix(empty_docs).count() == 0
