"""Skew-safe plan helpers against their plain (single-task) definitions,
the store's batch semantics, and streams against their batch twins."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from veracity.operators import store as ST
from veracity.plans.ordered import dense_index, with_previous
from veracity.streaming import streams as SS

T0 = dt.datetime(2024, 1, 1)


def test_with_previous_equals_plain_lag(spark):
    rnd = random.Random(7)
    # one hot group (k=1) holds most rows, many share a timestamp: it must be
    # cut over several range partitions and still give the plain answer
    rows = [(i, rnd.choice([1, 1, 1, 1, 2, 3]), T0 + dt.timedelta(minutes=rnd.randrange(0, 30)),
             rnd.choice([None, rnd.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")
    got = with_previous(df, ["k"], "ts", "id", ["v"], partitions=7)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("id", F.lag("v").over(w).alias("pv"), F.row_number().over(w).alias("rn"))
    j = got.join(want, "id").collect()
    assert len(j) == 400
    assert all(r.prev_v == r.pv and r.seq == r.rn for r in j)


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("seq"))
    r = dense_index(df, ["seq"], "i", start=11, partitions=7).collect()
    assert sorted(x.i for x in r) == list(range(11, 1011))
    assert all(x.i == x.seq + 11 for x in r)


ART = ("id long, title string, source string, url string, content string, short_summary string, "
       "credibility_level string, created_at timestamp_ntz, updated_at timestamp_ntz, is_featured boolean")
BATCH = "seq long, title string, source string, url string, content string, credibility_level string, is_featured boolean"


def test_upsert_blank_and_repeated_urls(spark):
    a = spark.createDataFrame([(1, "old", "s", "u1", "c", "c", "High", T0, T0, False)], ART)
    b = spark.createDataFrame([
        (1, "b1", "s", "", "x", "Low", False), (2, "b2", "s", "", "y", "Low", False),   # blank url twice
        (3, "n1", "s", "u2", "x", "Low", False), (4, "n2", "s", "u2", "z", "High", False),  # new url twice
        (5, "upd", "s2", "u1", "w", "Medium", True)], BATCH)
    out = {r.id: r for r in ST.upsert_articles(a, b, "2024-02-01 00:00:00").collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert out[1].title == "upd" and out[1].created_at == T0 and out[1].url == "u1"
    assert out[2].title == "b1" and out[3].title == "b2"
    assert out[4].title == "n2" and out[4].url == "u2"          # id at first row, values of the last
    h = ST.append_history(spark.createDataFrame([(9, 1, T0)], "id long, article_id long, created_at timestamp_ntz"),
                          a, b, "2024-02-01 00:00:00", analysis_cols=[]).collect()
    assert sorted((r.id, r.article_id) for r in h) == [(10, 2), (11, 3), (12, 4), (13, 4), (14, 1)]


def test_reuse_expiry_edges(spark):
    ts = [T0 + dt.timedelta(seconds=s) for s in (0, 3599, 3600, 3601, 7300)]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(ts)], "event_id long, key string, ts timestamp_ntz")
    got = sorted(SS.reusable_results(df, 3600).collect(), key=lambda r: r.event_id)
    assert [r.hit for r in got] == [False, True, False, True, False]


def test_streams_equal_batch_twins_over_many_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{src}/events.parquet")
    folder = tmp_path / "tables"
    # split the events into consecutive time ranges that arrive as separate
    # micro-batches (in order, so the watermark drops nothing)
    n = ev.count()
    for i in range(3):
        part = ev.filter((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3)).toPandas()
        folder.mkdir(exist_ok=True)
        part.to_parquet(folder / f"events_{i}.parquet", index=False, coerce_timestamps="us")
    d = str(folder)
    from veracity.sources.views import history_from_events
    stream = SS.latest_analysis_stream(spark, d, base=str(tmp_path / "s1"), max_files_per_trigger=1)
    twin = SS.latest_per_article(history_from_events(ev).select(
        "id", "article_id", "created_at", "credibility_score", "sentiment_score", "bias_score"))
    assert sorted(stream.collect()) == sorted(twin.select(*stream.columns).collect())
    qs = SS.quota_windows_stream(spark, d, base=str(tmp_path / "s2"), max_files_per_trigger=1)
    qb = SS.quota_windows(ev)
    assert sorted(qs.collect()) == sorted(qb.select(*qs.columns).collect())


def test_save_job_writes_three_versions(spark, tmp_path):
    from veracity.operators import stats as st
    a = spark.createDataFrame([(1, "old", "s", "u1", "c", "c", "High", T0, T0, False)], ART)
    h = spark.createDataFrame([(1, 1, T0)], "id long, article_id long, created_at timestamp_ntz")
    b = spark.createDataFrame([(1, "n", "s2", "u1", "x", "Low", False), (2, "m", "s3", "", "y", "High", False)],
                              BATCH)
    arts, hist, counters = ST.save_articles(a, h, st.source_stats_from(a), b, "2024-02-01 00:00:00")
    paths = ST.commit_save(str(tmp_path / "store"), 1, arts, hist, counters)
    ST.commit_save(str(tmp_path / "store"), 1, arts, hist, counters)      # a retry is idempotent
    assert spark.read.parquet(paths["articles"]).count() == 2
    assert spark.read.parquet(paths["history"]).count() == 3
    got = {r.source: (r.high, r.low, r.total_analyzed) for r in spark.read.parquet(paths["source_stats"]).collect()}
    assert got["s"] == (1, 0, 1) and got["s2"] == (0, 1, 1) and got["s3"] == (1, 0, 1)


def test_source_stats_and_reuse_streams_over_many_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    folder = tmp_path / "tables"
    folder.mkdir()
    docs = spark.read.parquet(f"{src}/documents.parquet").toPandas()
    for i in range(4):
        docs.iloc[i::4].to_parquet(folder / f"documents_{i}.parquet", index=False)
    spark.read.parquet(f"{src}/labels.parquet").toPandas().to_parquet(folder / "labels.parquet", index=False)
    from veracity.operators import stats as st
    from veracity.sources import views
    got = SS.source_stats_stream(spark, str(folder), base=str(tmp_path / "t1"), max_files_per_trigger=1)
    want = st.source_stats_from(views.articles(spark, src, url=False))
    cols = ["source", "high", "medium", "low", "total_analyzed"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    ev = spark.read.parquet(f"{src}/events.parquet")
    n = ev.count()
    for i in range(3):
        ev.filter((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3)).toPandas() \
            .to_parquet(folder / f"events_{i}.parquet", index=False, coerce_timestamps="us")
    rs = SS.reusable_results_stream(spark, str(folder), base=str(tmp_path / "t3"), max_files_per_trigger=1)
    rb = SS.reusable_results(SS.submissions_from_events(ev))
    assert sorted(rs.select("event_id", "hit", "cached_at").collect()) == \
        sorted(rb.select("event_id", "hit", "cached_at").collect())


def walk(rows, ttl):
    """(id, key, t) rows one after another: id -> (hit, cached at)."""
    out, anchor = {}, {}
    for k, t, i in sorted((k, t, i) for i, k, t in rows):
        a = anchor.get(k)
        if a is None or t >= a + ttl:
            anchor[k] = t
        out[i] = (anchor[k] != a, anchor[k])
    return out


def _submissions(spark, rows):
    return spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=t)) for i, k, t in rows],
                                 "event_id long, key string, ts timestamp_ntz")


def test_reuse_equals_walk_with_a_hot_key_over_many_pieces(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # dense (a ttl spans pieces), sparse, many ties, a single key
        for seed, (n, span, keys) in enumerate([(1500, 6000, 3), (1500, 900_000, 3), (800, 50, 2), (1000, 100_000, 1)]):
            rnd = random.Random(seed)
            rows = [(i, "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(keys)}", rnd.randrange(span)) for i in range(n)]
            got = {r.event_id: (not r.hit, int((r.cached_at - T0).total_seconds()))
                   for r in SS.reusable_results(_submissions(spark, rows), 3600).collect()}
            assert got == {i: (new, at) for i, (new, at) in walk(rows, 3600).items()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_reuse_stream_answers_in_any_file_order(spark, tmp_path):
    """File 1 holds second 5000, file 2 holds 0 and 4000; the stream gives the batch answer."""
    import os
    folder = tmp_path / "tables"
    folder.mkdir()
    rows = [[(1, 5000)], [(2, 0), (3, 4000)], [(4, 8999), (5, 9000), (6, 100)]]
    for n, part in enumerate(rows):
        df = spark.createDataFrame([(i, "login", T0 + dt.timedelta(seconds=s), "p") for i, s in part],
                                   "event_id long, event_type string, ts timestamp_ntz, props string").toPandas()
        df.to_parquet(folder / f"events_{n}.parquet", index=False, coerce_timestamps="us")
        os.utime(folder / f"events_{n}.parquet", (1_700_000_000 + 100 * n, 1_700_000_000 + 100 * n))
    got = SS.reusable_results_stream(spark, str(folder), base=str(tmp_path / "s"), max_files_per_trigger=1)
    want = SS.reusable_results(SS.submissions_from_events(spark.read.parquet(str(folder))))
    cols = ("event_id", "hit", "cached_at")
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    # anchors at 0, 4000 and 8999
    assert {r.event_id: r.hit for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True}
    assert SS.dropped_rows(spark, str(tmp_path / "s")) == 0


def test_streams_read_folder_tables_and_compact(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    d = tmp_path / "tables"
    spark.read.parquet(f"{src}/events.parquet").repartition(3).write.parquet(str(d / "events.parquet"))
    base = str(tmp_path / "s")
    got = SS.quota_windows_stream(spark, str(d), watermark="60 days", base=base, max_files_per_trigger=1)
    want = SS.quota_windows(spark.read.parquet(f"{src}/events.parquet"))
    rows = sorted(got.collect())
    assert rows == sorted(want.select(*got.columns).collect())
    SS.compact_changelog(spark, base, ["user_id", "window_start"])
    import os
    assert len([f for f in os.listdir(f"{base}/changes") if f.startswith("batch_id=")]) == 1
    again = SS.read_changelog(spark, base, ["user_id", "window_start"])
    assert sorted((r.user_id, r.window_start, r.requests) for r in again.collect()) == \
        [(r[0], r[1], r[2]) for r in rows]


def test_patch_with_analysis_adds_history_rows(spark):
    a = spark.createDataFrame([(1, "t", "s", "u", "c", "c", "High", T0, T0, False)], ART)
    h = spark.createDataFrame([(5, 1, T0, 0.5)], "id long, article_id long, created_at timestamp_ntz, credibility_score double")
    patch = spark.createDataFrame([(1, 1, 0.9), (2, 1, None), (3, 7, 0.4)],
                                  "seq long, id long, credibility_score double")
    rows = ST.history_from_update(h, a, patch, "2024-02-01 00:00:00", ["credibility_score"]).collect()
    # only the patch that carries an analysis and targets an existing article
    assert [(r.id, r.article_id, r.credibility_score) for r in rows] == [(6, 1, 0.9)]


def test_quota_stream_with_events_behind_the_watermark(spark, tmp_path):
    """Spark guarantees that events within the watermark are counted; older
    ones may or may not be.  Either way no window may be partly counted."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    folder = tmp_path / "late"
    folder.mkdir()
    on_time = ev.filter(F.col("ts") >= mid)
    late = ev.filter(F.col("ts") < mid - dt.timedelta(days=2))      # older than max - 1 day
    on_time.toPandas().to_parquet(folder / "events_0.parquet", index=False, coerce_timestamps="us")
    late.toPandas().to_parquet(folder / "events_1.parquet", index=False, coerce_timestamps="us")
    # the file source reads files oldest first (modification time): make the
    # late file arrive second
    import os
    os.utime(folder / "events_0.parquet", (1_700_000_000, 1_700_000_000))
    os.utime(folder / "events_1.parquet", (1_700_000_100, 1_700_000_100))
    assert late.count() > 0
    got = SS.quota_windows_stream(spark, str(folder), base=str(tmp_path / "s"), max_files_per_trigger=1)
    got_rows = sorted(got.collect())
    dropped = SS.dropped_rows(spark, str(tmp_path / "s"))
    only_on_time = sorted(SS.quota_windows(on_time).select(*got.columns).collect())
    everything = sorted(SS.quota_windows(on_time.unionByName(late)).select(*got.columns).collect())
    # counted whole, or dropped and reported
    assert got_rows == (only_on_time if dropped else everything)
    assert dropped in (0, late.count())


def test_known_previous_values_over_pieces(spark):
    """One group holds two thirds of the rows; previous non-null values cross its pieces."""
    rnd = random.Random(9)
    rows = [(i, 1 if i % 3 else 2, T0 + dt.timedelta(minutes=rnd.randrange(50)), rnd.choice([None, None, rnd.random()]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v double")
    got = {r.id: (r.prev_v, r.seq, r.group_size) for r in
           with_previous(df, ["k"], "ts", "id", ["v"], partitions=9, known=True).collect()}
    want, last, n = {}, {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        n[k] = n.get(k, 0) + 1
        want[i] = (last.get(k), n[k])
        last[k] = v if v is not None else last.get(k)
    assert {i: x[:2] for i, x in got.items()} == want
    assert all(x[2] == n[rows[i][1]] for i, x in got.items())


def test_article_times_of_large_ids(spark):
    from veracity.sources.views import ARTICLE_CYCLE, article_time
    ids = [0, 1, 58_040_099, 4_000_000_000, 60_000_000_000, ARTICLE_CYCLE]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", article_time(F.col("doc_id")).alias("t"))
    for r in got.collect():
        assert r.t == T0 + dt.timedelta(minutes=37 * (r.doc_id % ARTICLE_CYCLE))


def test_a_cluster_session_needs_a_shared_folder():
    import pytest

    from veracity.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_saved_documents_reach_articles_and_history(spark):
    a = spark.createDataFrame([(1, "old", "s", "u1", "c", "c", "High", T0, T0, False)], ART)
    b = spark.createDataFrame([(1, "n", "s", "u1", "x", "Low", False, '{"credibility_score":0.3}'),
                               (2, "m", "s", "", "y", "High", False, None)], BATCH + ", analysis_data string")
    got = {r.id: r.analysis_data for r in ST.upsert_articles(a, b, "2024-02-01 00:00:00").collect()}
    assert got == {1: '{"credibility_score":0.3}', 2: None}
    h = spark.createDataFrame([(9, 1, T0)], "id long, article_id long, created_at timestamp_ntz")
    rows = ST.append_history(h, a, b, "2024-02-01 00:00:00").collect()
    assert sorted((r.id, r.article_id, r.analysis_data) for r in rows) == [(10, 1, '{"credibility_score":0.3}'), (11, 2, None)]
    bare = ST.append_history(h, a, b, "2024-02-01 00:00:00", analysis_cols=[])
    assert bare.columns == ["id", "article_id", "created_at"]


def test_documents_of_all_shapes_fold(spark):
    from veracity.functions.scoring import fold_analysis
    rows = [(1, '{"credibility":{"score":0.7},"topics":[{"name":"a","relevance":0.5}],"key_points":["k"],"bias":{"level":0.1}}'),
            (2, '{"index_of_credibility":0.8,"topics":["a","b"],"western_perspective":{"credibility":"High","summary":"s","key_points":[]},'
                '"iranian_perspective":{"credibility":"Low"}}'),
            (3, '{"credibility_score":0.9,"perspectives":{"neutral":{"summary":"n"}},"summary":"x"}'), (4, "no json"), (5, None)]
    got = {r.id: r.a for r in spark.createDataFrame(rows, "id int, t string").select("id", fold_analysis("t").alias("a")).collect()}
    assert (got[1].credibility_score, got[1].bias_score, got[1].topics, got[1].topic_relevance, got[1].key_arguments) == (
        0.7, 0.1, ["a"], [0.5], ["k"])
    assert got[2].credibility_score == 0.8 and set(got[2].perspectives) == {"western", "iranian"}
    assert got[2].perspectives["western"].summary == "s" and got[2].topics == ["a", "b"]
    assert got[3].credibility_score == 0.9 and set(got[3].perspectives) == {"neutral"} and got[3].summary == "x"
    assert all(v is None for i in (4, 5) for v in got[i])


def _event_files(spark, folder, parts):
    """Files of (id, type, second), read in the order of ``parts``."""
    import os

    import pandas as pd
    folder.mkdir()
    for n, part in enumerate(parts):
        rows = pd.DataFrame([(i, e, pd.Timestamp(T0) + pd.Timedelta(seconds=s), "p") for i, e, s in part],
                            columns=["event_id", "event_type", "ts", "props"])
        rows.to_parquet(folder / f"events_{n:03}.parquet", index=False, coerce_timestamps="us")
        os.utime(folder / f"events_{n:03}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def test_reuse_query_over_more_files_than_a_trigger_takes(spark, tmp_path):
    """140 files without order over 30 days (three triggers): the registered query equals the walk."""
    from veracity.plans import catalog
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b"]), rnd.randrange(30 * 86400)) for i in range(2100)]
    d = _event_files(spark, tmp_path / "tables", [rows[i::140] for i in range(140)])
    got = catalog.q_reusable_results_stream(spark, d).collect()
    want = walk([(i, e, s) for i, e, s in rows], catalog.REUSE_TTL)
    assert {r.event_id: (not r.hit, int((r.cached_at - T0).total_seconds())) for r in got} == want


def test_reuse_stream_with_ties_over_many_triggers(spark, tmp_path):
    """Late rows before, at and after anchors, at equal times with smaller and larger ids."""
    rnd = random.Random(6)
    rows = [(i, rnd.choice("ab"), 600 * rnd.randrange(40)) for i in range(120)]
    rnd.shuffle(rows)
    d = _event_files(spark, tmp_path / "tables", [rows[i::6] for i in range(6)])
    got = SS.reusable_results_stream(spark, d, base=str(tmp_path / "s"), max_files_per_trigger=1).collect()
    assert {r.event_id: (not r.hit, int((r.cached_at - T0).total_seconds())) for r in got} == walk(rows, 3600)


def test_dropped_rows_of_triggers_that_recent_progress_forgot(spark, tmp_path):
    """File 2 is behind the watermark of file 1; with a short memory of reports it still counts."""
    conf = "spark.sql.streaming.numRecentProgressUpdates"
    day = 86400
    parts = [[(1, "a", 90 * day)], [(2, "a", 91 * day)], [(3, "a", 0)], *[[(4 + k, "a", (92 + k) * day)] for k in range(4)]]
    d = _event_files(spark, tmp_path / "tables", [[(i, e, s) for i, e, s in p] for p in parts])
    import pandas as pd
    for n in range(len(parts)):
        f = tmp_path / "tables" / f"events_{n:03}.parquet"
        at = f.stat().st_mtime
        pd.read_parquet(f).assign(user_id=7).to_parquet(f, index=False, coerce_timestamps="us")
        import os
        os.utime(f, (at, at))
    spark.conf.set(conf, "1")
    try:
        got = SS.quota_windows_stream(spark, d, base=str(tmp_path / "s"), max_files_per_trigger=1).count()
    finally:
        spark.conf.unset(conf)
    assert (got, SS.dropped_rows(spark, str(tmp_path / "s"))) == (6, 1)


def test_similar_articles_follow_the_stored_analysis(spark):
    """The stored query comes before stored topics, and those before the text's tags."""
    from veracity.operators import scoring as SC
    arts = [(1, "s", "software news", 0), (2, "s", "an election", 1), (3, "s", "a new vaccine study", 2), (4, "s", "an election", 3),
            (5, "s", "zzz", 4)]
    a = spark.createDataFrame([(i, s, c, T0 + dt.timedelta(days=n)) for i, s, c, n in arts],
                              "id long, source string, content string, created_at timestamp_ntz")
    docs = [(10, 1, 0, '{"topics": ["technology"]}'),
            (11, 1, 1, '{"topics": [{"name": "technology"}], "similar_articles_query": "Politics", "potential_biases": ["b"]}'),
            (12, 2, 0, '{"topics": ["technology"], "key_arguments": ["k"]}'), (13, 3, 0, '{"topics": []}')]
    d = spark.createDataFrame([(i, n, T0 + dt.timedelta(days=t), x) for i, n, t, x in docs],
                              "id long, article_id long, created_at timestamp_ntz, analysis_data string")
    h = spark.createDataFrame([(i, n, T0 + dt.timedelta(days=t), 0.5, 0.5, None) for i, n, t, _ in docs],
                              "id long, article_id long, created_at timestamp_ntz, credibility_score double,"
                              " bias_score double, topics array<string>")
    got = {r.id: r for r in SC.analyze_with_documents(a, h, d).collect()}
    assert {i: r.similar_query for i, r in got.items()} == {
        1: "Politics", 2: "technology", 3: "general news", 4: "politics", 5: "General News OR Politics"}
    assert got[1].similar_ids == [5, 4, 2] and got[2].similar_ids == [1] and got[3].similar_ids == [5]
    assert (got[1].potential_biases, got[2].key_points) == (["b"], ["k"])


def test_json_is_parsed_once(spark):
    """One parse and one search for braces, however many fields are read."""
    from veracity.plans import catalog
    conf = "spark.sql.debug.maxToStringFields"
    spark.conf.set(conf, "2000")
    try:
        for name in ("decode_response", "decode_stored_documents", "fold_analysis"):
            plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
            assert plan.lower().count("parsejson(") + plan.lower().count("parse_json(") == 1, name
            assert plan.count("{.*") == (0 if name == "fold_analysis" else 1), name
    finally:
        spark.conf.unset(conf)
