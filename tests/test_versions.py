"""The store on disk against the whole-table operators; what a save writes; lost saves."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from veracity.operators import stats as st
from veracity.operators import store as ST
from veracity.operators import versions as VS

T0 = dt.datetime(2024, 1, 1)
ART = ("id long, title string, source string, url string, content string, short_summary string, credibility_level string,"
       " created_at timestamp_ntz, updated_at timestamp_ntz, is_featured boolean, analysis_data string")
HIST = "id long, article_id long, created_at timestamp_ntz, analysis_data string"
BATCH = ("seq long, title string, source string, url string, content string, credibility_level string, is_featured boolean,"
         " analysis_data string")
NOW = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    arts = [(i, f"t{i}", f"s{i % 5}", f"u{i}" if i % 4 else None, "c", "c", "High", T0, T0, False, None) for i in range(1, 201)]
    arts.append((300, "again", "s1", "u7", "c", "c", "Low", T0, T0, False, None))     # a url twice
    hist = [(i, 1 + i % 200, T0, f'{{"n":{i}}}') for i in range(1, 401)]
    a, h = spark.createDataFrame(arts, ART), spark.createDataFrame(hist, HIST)
    return a, h, st.source_stats_from(a)


def batch(spark, seed, n, first=0):
    rnd = random.Random(seed)
    rows = [(first + i, f"n{seed}-{i}", f"s{rnd.randrange(7)}", rnd.choice([f"u{rnd.randrange(1, 200)}", f"new{rnd.randrange(6)}", None, ""]),
             "body", rnd.choice(["High", "Low", None]), False, f'{{"b":{i}}}') for i in range(n)]
    return spark.createDataFrame(rows, BATCH)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_saves_equal_the_whole_table_operators(spark, tables, tmp_path):
    a, h, counters = tables
    base = str(tmp_path / "store")
    VS.create_store(spark, base, a, h, counters, buckets=16)
    for seed in (1, 2):
        b = batch(spark, seed, 40, first=100 * seed)
        a, h, counters = ST.save_articles(a, h, counters, b, NOW)
        a, h, counters = (spark.createDataFrame(x.collect(), x.schema) for x in (a, h, counters))
        v = VS.save_batch(spark, base, b, NOW)
        for got in (v, VS.read_version(spark, base)):
            assert got.number == seed
            assert rows_of(got.table("articles")) == rows_of(a)
            assert rows_of(got.table("history")) == rows_of(h)
            assert rows_of(got.table("source_stats")) == rows_of(counters)
    ids = [1, 7, 202, 10_000]
    asked = spark.createDataFrame([(i,) for i in ids], "article_id long")
    assert rows_of(v.history_of(ids)) == rows_of(h.join(asked, "article_id", "left_semi"))


def test_old_versions_stay_readable(spark, tables, tmp_path):
    a, h, counters = tables
    base = str(tmp_path / "store")
    VS.create_store(spark, base, a, h, counters, buckets=8)
    VS.save_batch(spark, base, batch(spark, 3, 30), NOW)
    old = VS.read_version(spark, base, 0)
    assert rows_of(old.table("articles")) == rows_of(a) and rows_of(old.table("history")) == rows_of(h)
    assert VS.versions(spark, base) == [0, 1]
    with pytest.raises(ValueError):
        VS.read_version(spark, base, 5)
    with pytest.raises(ValueError):
        VS.read_version(spark, str(tmp_path / "nothing"))


def test_a_small_batch_writes_little(spark, tables, tmp_path):
    a, h, counters = tables
    base = str(tmp_path / "store")
    VS.create_store(spark, base, a, h, counters, buckets=100)
    before = files(base)
    two = spark.createDataFrame([(1, "x", "s1", "u9", "c", "Low", False, "{}"), (2, "y", "s1", "u10", "c", "Low", False, "{}")], BATCH)
    v = VS.save_batch(spark, base, two, NOW)
    after = files(base)
    assert {f: after[f] for f in before} == before           # nothing is overwritten
    new = [f for f in after if f not in before]
    assert len([f for f in new if "/articles/" in f]) <= 2 and len([f for f in new if "/history/" in f]) <= 2
    kept = [x for x in v.folders["articles"] if x[1] == 0]
    assert len(kept) >= len(VS.read_version(spark, base, 0).folders["articles"]) - 2


def test_a_lost_save_is_invisible_and_can_be_repeated(spark, tables, tmp_path, monkeypatch):
    a, h, counters = tables
    base = str(tmp_path / "store")
    VS.create_store(spark, base, a, h, counters, buckets=8)
    b = batch(spark, 5, 25)
    whole = VS._write

    def lost(df, base, name, version, bucket):
        if name == "source_stats":
            raise RuntimeError("lost")
        whole(df, base, name, version, bucket)
    monkeypatch.setattr(VS, "_write", lost)
    with pytest.raises(RuntimeError):
        VS.save_batch(spark, base, b, NOW)
    now = VS.read_version(spark, base)
    assert now.number == 0 and rows_of(now.table("articles")) == rows_of(a) and rows_of(now.table("history")) == rows_of(h)
    monkeypatch.setattr(VS, "_write", whole)
    v = VS.save_batch(spark, base, b, NOW)
    want = ST.save_articles(a, h, counters, b, NOW)
    assert [rows_of(v.table(n)) for n in ("articles", "history", "source_stats")] == [rows_of(x) for x in want]


def test_empty_batches_and_stores(spark, tables, tmp_path):
    a, h, counters = tables
    base = str(tmp_path / "store")
    VS.create_store(spark, base, a.where("false"), h.where("false"), st.empty_source_stats(spark), buckets=4)
    v = VS.save_batch(spark, base, batch(spark, 1, 0), NOW)
    assert [v.table(n).count() for n in ("articles", "history", "source_stats")] == [0, 0, 0]
    b = batch(spark, 6, 12)
    v = VS.save_batch(spark, base, b, NOW)
    want = ST.save_articles(a.where("false"), h.where("false"), st.empty_source_stats(spark), b, NOW)
    assert [rows_of(v.table(n)) for n in ("articles", "history", "source_stats")] == [rows_of(x) for x in want]
    assert v.history_of([10**9]).count() == 0
