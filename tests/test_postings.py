"""Similar articles by free text against every article and every term."""

from __future__ import annotations

import datetime as dt
import random

from veracity.operators import postings as PO

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, title string, short_summary string, content string, created_at timestamp_ntz"


def fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute(arts, queries, k):
    out = []
    for i, q in queries:
        terms = {fold(t.strip(" ")) for t in (q or "").split(" OR ")} - {""}
        hits = {a[0]: a for a in arts if a[0] != i and any(t in fold("\n".join(x for x in a[1:4] if x is not None)) for t in terms)}
        hits = sorted(hits.values(), key=lambda a: (a[4] is None, -(a[4] or T0).timestamp(), a[0]))
        out += [(i, r, a[0]) for r, a in enumerate(hits[:k], 1)]
    return sorted(out)


def sample(seed, n=150):
    rnd = random.Random(seed)
    words = ["Conflict", "média", "100%", "a_b", "Élan", "vote", "voter", "the", "日本"]
    def text(m):
        return " ".join(rnd.choice(words) for _ in range(m))
    arts = [(i, rnd.choice([None, text(1)]), rnd.choice(["", text(2)]), text(rnd.randrange(4)),
             None if rnd.random() < .1 else T0 + dt.timedelta(hours=rnd.randrange(20))) for i in range(n)]
    asked = ["conflict", "MÉDIA", "média", "%", "_", "a_b OR 100%", "vote", "élan", "ot", "日本 OR conflict", "", " OR ", None, "nothing",
             "conflict OR Conflict OR vote"]
    return arts, [(i, rnd.choice(asked)) for i in range(n)] + [(5000, "the")]


def test_equals_all_pairs(spark):
    for seed, k in ((1, 3), (2, 1), (3, 200)):
        arts, queries = sample(seed)
        a, q = spark.createDataFrame(arts, SCHEMA).repartition(4), spark.createDataFrame(queries, "id long, query string")
        got = [(r.id, r["rank"], r.similar_id) for r in PO.similar_by_text(a, q, k).collect()]
        assert sorted(got) == brute(arts, queries, k)
    few = [(r.id, r["rank"], r.similar_id) for r in PO.similar_by_text(a, q, k, block_bytes=9).collect()]
    assert sorted(few) == brute(arts, queries, k)      # several automata


def test_empty_sides(spark):
    arts, queries = sample(4, 10)
    a, q = spark.createDataFrame(arts, SCHEMA), spark.createDataFrame(queries, "id long, query string")
    assert PO.similar_by_text(a.where("false"), q).count() == 0
    assert PO.similar_by_text(a, q.where("false")).count() == 0


def test_an_article_reached_by_topics_outside_the_tags(spark):
    """Stored topics that are none of the keyword tags find the articles whose text holds them."""
    a = spark.createDataFrame([(1, "t", "s", "an essay", T0), (2, "t", "s", "the Conflict goes on", T0),
                               (3, "conflict", "s", "x", T0 + dt.timedelta(hours=1))], SCHEMA)
    q = spark.createDataFrame([(1, "conflict OR media")], "id long, query string")
    assert [tuple(r) for r in PO.similar_by_text(a, q).collect()] == [(1, 1, 3, 1), (1, 2, 2, 1)]
