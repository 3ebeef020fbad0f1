"""Property tests, a few examples each: Spark calls are slow."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veracity.functions import scoring as S
from veracity.operators import history as H
from veracity.operators import stats

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=500_000), min_size=2, max_size=7, unique=True))
def test_timeliness_telescopes_to_mean_gap(spark, seconds):
    seconds = sorted(seconds)
    rows = [(i + 1, 1, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    hist = spark.createDataFrame(rows, "id long, article_id long, created_at timestamp_ntz").select(
        "id", "article_id", "created_at", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("credibility_score", "double"), ("sentiment_score", "double"), ("bias_score", "double"),
            ("topics", "array<string>"), ("key_arguments", "array<string>"),
            ("perspectives", "map<string,struct<credibility:string,summary:string,key_points:array<string>>>"),
            ("summary", "string"))])
    arts = spark.createDataFrame([(1, "t", "s")], "id long, title string, source string")
    got = H.analysis_quality(arts, hist).collect()[0].timeliness
    gaps = [(b - a) / 3600 for a, b in zip(seconds, seconds[1:])]
    want = max(0.0, min(1.0, 1.0 / (1.0 + (sum(gaps) / len(gaps)) / 24)))
    assert got == pytest.approx(want, rel=1e-12)


LEVEL = st.sampled_from(["High", "Medium", "Low", None, "odd"])


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "BBC News"]), LEVEL), min_size=1, max_size=20),
       st.integers(min_value=0, max_value=20))
def test_additive_merge_equals_recount(spark, rows, cut):
    schema = "source string, credibility_level string"
    seed = stats.seed_rows(spark)
    both = stats.update_source_stats(seed, spark.createDataFrame(rows, schema))
    first = stats.update_source_stats(seed, spark.createDataFrame(rows[:cut], schema))
    twice = stats.update_source_stats(first, spark.createDataFrame(rows[cut:], schema))
    cols = ["source", "high", "medium", "low", "total_analyzed", "is_initial"]
    assert sorted(both.select(*cols).collect()) == sorted(twice.select(*cols).collect())


TOPICS = st.lists(st.sampled_from(["x", "y", "z", "w"]), max_size=4)


@SETTINGS
@given(st.lists(st.one_of(st.none(), TOPICS), min_size=2, max_size=6))
def test_topic_diffs_are_disjoint(spark, topic_lists):
    rows = [(i + 1, 1, T0 + dt.timedelta(hours=i), t) for i, t in enumerate(topic_lists)]
    hist = spark.createDataFrame(rows, "id long, article_id long, created_at timestamp_ntz, topics array<string>") \
        .withColumn("perspectives", F.lit(None).cast("map<string,struct<credibility:string,summary:string,"
                                                     "key_points:array<string>>>"))
    for r in H.evolution_steps(hist).collect():
        if r.has_prev:
            added, removed = set(r.topics_added), set(r.topics_removed)
            assert not added & removed
            assert added == set(r.topic_set) - set(r.prev_topic_set)
            assert removed == set(r.prev_topic_set) - set(r.topic_set)


@SETTINGS
@given(st.lists(st.tuples(LEVEL, st.one_of(st.none(), st.floats(0, 1)), st.one_of(st.none(), st.floats(0, 1))),
                min_size=1, max_size=10))
def test_index_stays_in_reachable_range(spark, rows):
    df = spark.createDataFrame(rows, "l string, s double, b double")
    for r in df.select(S.credibility_index("l", "s", "b").alias("i")).collect():
        assert 0.33 - 1e-9 <= r.i <= 0.88 + 1e-9
