"""Measures against plain Python; the binomial tail; certified cutoffs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veracity.llm import quality_rules as qr


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if twice[x] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n \n", "é\x0bü\x0c#|", "<b>$&*%",
           "a b c d e f\n" * 3, "  nbsp is a word too", "it's \\ 'quoted' \"x\""]
    for _ in range(60):
        words = [rng.choice(["ab", "c", "dé", "#x", "|", "fgh"] + ["u%d" % rng.randrange(40)] * 4) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            words += words[:rng.randrange(1, 12)]
        out.append("".join(x + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for x in words))
    return out


def test_measures_equal_plain_python(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = qr.measures(docs, "doc_id", "text", None).collect()
    assert {r["id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            for r in got} == {i: brute(t) for i, t in rows}


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 200, 3000) for k in (0, 1, 2, 5, 20) if k < n]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", qr.binomial_tail("n", "k", 0.01))
    for r in df.collect():
        want = (1.0 if r["k"] >= r["n"] * 0.01 else
                sum(math.comb(r["n"], i) * 0.01 ** i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert abs(r["p"] - want) < 1e-9


def labelled(spark, n=6000):
    """Half of the bad documents are full of symbols; good ones almost never."""
    return spark.range(n).selectExpr(
        "id as doc_id",
        "case when id % 10 = 0 and id % 20 = 0 then repeat('word # $ % & ', 10 + int(id % 7))"
        " else concat_ws(' ', transform(sequence(1, 40), i -> concat('w', i * 31 + id))) end as text",
        "if(id % 2 = 0, 'en', 'de') as lang", "if(id % 10 = 0, 0, 1) as quality")


def test_rules_reject_bad_and_spare_good(spark):
    docs = labelled(spark)
    got = qr.quality_rules(docs, docs.select("doc_id", "quality"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 6000
    good = [i for i in rows if i % 10]
    assert sum(not rows[i]["kept"] and not rows[i]["base_failed"] for i in good) <= qr.ALPHA * len(good)
    assert all("symbols" in rows[i]["failed"] for i in rows if i % 20 == 0)


def test_cutoffs_equal_a_plain_search(spark):
    docs = labelled(spark, 4000)
    table = qr.measures(docs, "doc_id", "text", "lang").cache()
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in qr.certified_cutoffs(
        table, docs.where("quality = 1").select(F.col("doc_id").alias("id"))).collect()}
    values = [(r["stratum"], r) for r in table.select("id", "stratum", *[c.alias(n) for n, c in qr.rule_values().items()])
              .collect() if r["id"] % 10]
    want, rate, level = {}, qr.ALPHA / 5, qr.DELTA / 10
    for s in ("en", "de"):
        for rule in qr.RULES:
            mine = [r[rule] for x, r in values if x == s]
            for c in reversed(qr.CUTOFFS):
                k, n = sum(v > c for v in mine), len(mine)
                p = sum(math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1)) if k < n * rate else 1
                if p > level:
                    break
                want[s, rule] = c
    assert got == want and want


def test_false_rejection_stays_below_alpha_over_many_draws(spark):
    """Good values are uniform: a certified cutoff c loses 1 - c of them.  Over 200
    strata of fresh draws no more than delta of the families may exceed the rate."""
    n = 3000
    rows = spark.range(200 * n).select(
        (F.col("id") % 200).cast("string").alias("stratum"), F.col("id"), F.lit(100).alias("n_words"),
        F.lit(1000).alias("word_chars"), (F.rand(11) * 1000).alias("n_symbols"), F.lit(0).alias("n_dup_lines"),
        F.lit(0).alias("n_repeat_words"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_capitals"),
        F.lit(0).alias("n_exclamations"))
    cut = [r["cutoff"] for r in qr.certified_cutoffs(rows, rows.select("id"), alpha=0.5).where("rule = 'symbols'").collect()]
    assert cut and all(1 - c <= 0.5 / 5 + 1e-9 for c in cut)


def test_edge_rows(spark, edge_docs, edge_labels, empty_docs):
    got = qr.quality_rules(edge_docs, edge_labels)
    assert got.count() == edge_docs.count()
    assert all(r["kept"] is not None for r in got.collect())
    assert qr.quality_rules(empty_docs, edge_labels).count() == 0
    assert qr.quality_rules(edge_docs, edge_labels.limit(0)).where("size(failed) > 0").count() == 0
