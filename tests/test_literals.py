"""Literal edge cases from the reading of the reference."""

from __future__ import annotations

import datetime as dt
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veracity.functions import scoring as S
from veracity.functions import text as TX
from veracity.operators import history as H
from veracity.operators import stats
from veracity.sources import pages
from veracity.sources.pages import extract_one

T0 = dt.datetime(2024, 1, 1)

HIST_DDL = ("id long, article_id long, created_at timestamp_ntz, credibility_score double, "
            "sentiment_score double, bias_score double, topics array<string>, key_arguments array<string>, "
            "perspectives map<string,struct<credibility:string,summary:string,key_points:array<string>>>, "
            "summary string")


def hist(spark, rows):
    full = [(r.get("id"), r.get("article_id", 1), r["created_at"], r.get("c"), r.get("s"), r.get("b"),
             r.get("topics"), r.get("args"), r.get("persp"), r.get("summary")) for r in rows]
    return spark.createDataFrame(full, HIST_DDL)


def arts(spark, ids=(1,)):
    return spark.createDataFrame([(i, f"t{i}", "src", T0) for i in ids],
                                 "id long, title string, source string, created_at timestamp_ntz")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_seed_scores(spark):
    chart = stats.source_credibility_chart(stats.seed_rows(spark)).collect()
    got = {r.source: r.credibility_score for r in chart}
    assert got["BBC News"] == 0.92 and got["Reuters"] == 0.92
    assert got["The New York Times"] == 0.83 and got["CNN"] == 0.75
    assert got["Al Jazeera"] == 0.67 and got["Fox News"] == 0.58
    assert got["Daily Mail"] == 0.5 and got["RT"] == 0.33 and got["Breitbart"] == 0.25
    assert [r.source for r in chart][:2] == ["BBC News", "Reuters"]


def test_latest_analysis_keeps_ties_and_dedups(spark):
    h = hist(spark, [{"id": 1, "created_at": T0}, {"id": 2, "created_at": T0 + dt.timedelta(hours=1)},
                     {"id": 3, "created_at": T0 + dt.timedelta(hours=1)}])
    assert sorted(r.id for r in H.latest_analysis(h).collect()) == [2, 3]
    assert [r.id for r in H.latest_analysis(h, dedup=True).collect()] == [3]


def _quality(spark, rows):
    return one(H.analysis_quality(arts(spark), hist(spark, rows)))


def test_consistency_cases(spark):
    hr = dt.timedelta(hours=1)
    # no score present twice -> 1.0
    q = _quality(spark, [{"id": 1, "created_at": T0, "c": 0.5}, {"id": 2, "created_at": T0 + hr}])
    assert q.consistency == 1.0
    # one field, changes 0.2 then 0.5 (max 0.5) -> 0.5
    q = _quality(spark, [{"id": 1, "created_at": T0, "c": 0.1}, {"id": 2, "created_at": T0 + hr, "c": 0.3},
                         {"id": 3, "created_at": T0 + 2 * hr}, {"id": 4, "created_at": T0 + 3 * hr, "c": 0.8}])
    assert q.consistency == pytest.approx(0.5)


def test_depth_completeness_timeliness(spark):
    day = dt.timedelta(hours=24)
    persp = {k: ("High", "s", ["a", "b", "c"]) for k in ("w", "i", "x", "n")}
    first = {"id": 1, "created_at": T0, "c": 0.82, "s": 0.6, "b": 0.3, "topics": ["a", "b", "c", "d"],
             "args": ["1", "2", "3", "4", "5"], "persp": persp}
    q = _quality(spark, [first, {"id": 2, "created_at": T0 + day}])
    # the featured document's shape: (1 + 1 + 0.8 + 0.9) / 5
    assert q.depth == pytest.approx(0.74)
    assert q.completeness == 6 / 8
    assert q.timeliness == pytest.approx(0.5)
    full = dict(first, topics=list("abcde"), summary="x")
    q = _quality(spark, [full, {"id": 2, "created_at": T0 + day}])
    assert q.depth == pytest.approx(0.78)       # the reachable maximum
    assert q.completeness == 7 / 8              # at most 0.875


def test_trend_threshold_is_strict_on_doubles(spark):
    hr = dt.timedelta(hours=1)
    rows = [{"id": 1, "created_at": T0, "c": 0.6, "s": 0.7}, {"id": 2, "created_at": T0 + hr, "c": 0.7, "s": 0.8}]
    r = one(H.analysis_evolution(arts(spark), hist(spark, rows)))
    assert r.credibility_trend == "stable"          # 0.7 - 0.6 = 0.0999...
    assert r.sentiment_trend == "more_positive"     # 0.8 - 0.7 = 0.1000...09
    assert r.bias_trend == "stable" and r.bias_first is None


def test_comparison_summary_text(spark):
    hr = dt.timedelta(hours=1)
    rows = [{"id": 1, "created_at": T0, "c": 0.5, "topics": ["a", "b"]},
            {"id": 2, "created_at": T0 + hr, "c": 0.9, "topics": ["b", "c"]}]
    r = one(H.comparison_summary(arts(spark), hist(spark, rows)))
    assert r.comparison_summary == ("Analysis comparison summary: The credibility score increased from 0.50 "
                                    "to 0.90. Added topics: c. Removed topics: a.")
    rows = [{"id": 1, "created_at": T0, "c": 0.5}, {"id": 2, "created_at": T0 + hr, "c": 0.55}]
    r = one(H.comparison_summary(arts(spark), hist(spark, rows)))
    assert r.comparison_summary == "No significant changes detected between analyses."


@pytest.mark.parametrize("source,level", [
    (None, "Medium"), ("", "Medium"), ("https://x.gov/a", "High"), ("https://x.gov:8080/a", "Medium"),
    ("Fox & Reuters", "High"), ("The New York Times", "Medium"), ("dailymail.co.uk", "Low"),
    ("http://uni.edu/x", "High"), ("x.gov", "Medium")])
def test_source_level(spark, source, level):
    df = spark.createDataFrame([(source,)], "s string")
    assert one(df.select(TX.source_level("s").alias("l"))).l == level


def test_score_bands(spark):
    df = spark.createDataFrame([(0.6,), (0.8,), (0.59,), (None,)], "x double")
    rows = df.select("x", TX.score_band("x").alias("faq"), TX.chart_band("x").alias("chart")).collect()
    got = {r.x: (r.faq, r.chart) for r in rows}
    assert got[0.6] == ("Medium", "Low") and got[0.8] == ("High", "Medium")
    assert got[0.59] == ("Low", "Low") and got[None] == (None, None)


@pytest.mark.parametrize("n,expect", [(0, None), (200, 200), (201, 203), (5000, 5000), (5001, 4989)])
def test_summary_and_preview_lengths(spark, n, expect):
    df = spark.createDataFrame([("x" * n,)], "c string")
    r = one(df.select(F.length(TX.short_summary("c")).alias("s"), F.length(TX.content_preview("c")).alias("p")))
    if n == 0:
        assert r.s == 0 and r.p == len("No content available")
    else:
        assert r.s == expect if n <= 201 else r.s == 203
        assert r.p == (n if n <= 5000 else 4989)


def test_preview_keeps_head_and_tail(spark):
    text = "H" * 200 + "M" * 6000 + "T" * 200
    p = one(spark.createDataFrame([(text,)], "c string").select(TX.content_preview("c").alias("p"))).p
    assert p.startswith("H" * 200 + "\n\n[CONTENT TRIMMED FOR ANALYSIS]\n\n")
    assert p.endswith("\n\n..." + "T" * 200)


@pytest.mark.parametrize("term,text,match", [
    ("50%", "a 50% rise", True), ("50%", "a 50 rise", True), ("a_c", "xabcx", True),
    ("a\\b", "a\\b", True), ("É", "é", False), ("abc", "xABCx", True), ("abc", None, False)])
def test_like_ci(spark, term, text, match):
    df = spark.createDataFrame([(text,)], "t string")
    assert bool(one(df.select(F.coalesce(TX.like_ci("t", term), F.lit(False)).alias("m"))).m) is match


def test_tag_topics(spark):
    df = spark.createDataFrame([("He said the market and the vaccine study",), ("",), (None,), ("nothing",)],
                               "t string")
    got = [r.t for r in df.select(TX.tag_topics("t").alias("t")).collect()]
    assert got[0] == ["economy", "technology", "science"]   # "ai" in "said": first three hits
    assert got[1] == got[2] == got[3] == ["General News", "Politics"]


def test_keywords_are_not_prefixes_across_topics():
    words = [(t, w) for t, ws in TX.TOPIC_KEYWORDS.items() for w in ws]
    for t1, w1 in words:
        for t2, w2 in words:
            assert t1 == t2 or not w2.startswith(w1)


@pytest.mark.parametrize("text,outcome,topics", [
    ("", "error_fallback", ["General News", "Politics"]),
    ("no json here about the economy", "text_fallback", ["economy"]),
    ("{broken json", "text_fallback", ["General News", "Politics"]),
    ('Sure: {"credibility": {"score": 0.7}, "topics": ["a", "b"]} done', "parsed", ["a", "b"]),
    ('{"credibility": {"score": 0.9}, "topics": [{"name": "x", "relevance": 1}, {"name": "y"}]}', "parsed",
     ["x", "y"]),
    ('{"summary": "no credibility"}', "parsed", ["General News", "Politics"]),
])
def test_decode_response(spark, text, outcome, topics):
    df = spark.createDataFrame([(text,)], "t string")
    r = one(df.select(S.decode_response("t").alias("d")).select("d.*"))
    assert r.outcome == outcome and list(r.topics) == topics
    if text == "":
        assert r.error == "Empty response from API" and r.credibility_score == 0.6
    if "no credibility" in text:
        assert r.credibility_score == 0.6 and r.explanation == "Normalized credibility score"


def test_credibility_index_range(spark):
    df = spark.createDataFrame([("High", 1.0, 0.0), ("Low", 0.0, 1.0), ("other", None, None)],
                               "l string, s double, b double")
    got = [round(r.i, 6) for r in df.select(S.credibility_index("l", "s", "b").alias("i")).collect()]
    assert got == [0.88, 0.33, 0.575]


def test_extract_pages_rules():
    html = ('<html><head><script>var t="</p>";</script></head><body><article><h1>T&amp;1</h1>'
            '<p>one <b>bold</b><p>two</article><p>outside</p></body></html>')
    text, host, title, err = extract_one("https://www.a.example.com/x", html)
    assert (text, host, title, err) == ("one bold two", "a.example.com", "T&1", None)
    text, host, title, err = extract_one("http://b.org", '<div class="x article"><p>d</p></div>')
    assert (text, title, err) == ("d", "No title available", None)
    assert extract_one("http://b.org", "<p>none</p>") == (None, "b.org", "No title available",
                                                          "Failed to extract content")
    assert extract_one("not a url", "")[3] == "Invalid URL format"


def test_pages_are_parsed_a_few_at_a_time(spark):
    """A task holds few pages as strings, however many an Arrow batch has."""
    n = 5 * pages.PAGES_AT_ONCE + 3
    rows = [(i, f"https://a.org/{i}", f"<article><h1>t{i}</h1><p>x{i}</p></article>") for i in range(n)]
    rows += [(None, None, None), (n, "https://a.org/", None), (n, "no url", "<p>x</p>")]
    want = [(i, u, *extract_one(u, h)) for i, u, h in rows]
    columns = [pa.array(c) for c in zip(*rows)]
    taken = list(pages._extract_batches(iter([pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "html"])])))
    assert max(b.num_rows for b in taken) <= pages.PAGES_AT_ONCE
    assert [tuple(r.values()) for b in taken for r in b.to_pylist()] == want
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_large_page_is_held_as_a_string_at_a_time():
    """What a task holds goes by a page and by the size of the results, not by 64 pages of any size."""
    n, text = pages.PAGES_AT_ONCE, "\u20ac uro " * 50_000
    html = pa.array([f"<article><p>{text}</p></article>"] * n)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["https://a.org/"] * n), html],
                                       names=["page_id", "url", "html"])
    ids = []
    tracemalloc.start()
    for out in pages._extract_batches(iter([batch])):
        ids += out.column("page_id").to_pylist()
        assert set(out.column("text").to_pylist()) == {text}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(n))
    assert peak < n // 2 * sys.getsizeof(text), peak
