"""Pages by rank against sorted rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from veracity.operators import lookup as L
from veracity.operators import ranked as RK

T0 = dt.datetime(2024, 1, 1)


def sample(seed, n, times):
    rnd = random.Random(seed)
    ids = rnd.sample(range(-5 * n, 5 * n), n)
    return [(i, None if rnd.random() < 0.05 else T0 + dt.timedelta(microseconds=rnd.randrange(times) ** 2)) for i in ids]


def newest(rows):
    return sorted(rows, key=lambda r: (r[1] is None, -(r[1] or T0).timestamp(), r[0]))


def test_pages_at_any_depth(spark):
    # spread times, a third at one time, all at one time
    for seed, (n, times) in enumerate([(900, 10**7), (900, 3), (500, 1)]):
        rows = sample(seed, n, times)
        df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz").repartition(5).cache()
        want = newest(rows)
        for offset in (0, n // 3, n - 4):
            got = [(r.id, r.created_at) for r in RK.deep_page(df, 7, offset, bins=8, piece=20).collect()]
            assert got == want[offset:offset + 7], (seed, offset)
        assert RK.deep_page(df, 7, n, bins=8, piece=20).count() == 0
    assert RK.deep_page(df.where("false"), 7, 0).count() == 0


def test_extreme_ids_and_rows_alike(spark):
    ids = [-(1 << 63), (1 << 63) - 1, 0, 0, 0, None, 5]
    df = spark.createDataFrame([(i, T0) for i in ids], "id long, created_at timestamp_ntz")
    want = sorted(ids, key=lambda i: (i is not None, i or 0))
    for offset in (0, 2, 6):
        got = [r.id for r in RK.deep_page(df, 2, offset, bins=4, piece=1).collect()]
        assert got == want[offset:offset + 2], offset


def test_history_pages_count_every_latest_analysis(spark):
    rnd = random.Random(4)
    arts = [(i, f"t{i}", "s", "x", "High", f"u{i}", T0 + dt.timedelta(hours=rnd.randrange(40)), T0) for i in range(150)]
    a = spark.createDataFrame(arts, "id long, title string, source string, short_summary string, credibility_level string,"
                                    " url string, created_at timestamp_ntz, updated_at timestamp_ntz")
    hist = [(k, rnd.randrange(100), T0 + dt.timedelta(hours=rnd.randrange(3)), rnd.random()) for k in range(600)]
    h = spark.createDataFrame(hist, "id long, article_id long, created_at timestamp_ntz, credibility_score double")
    total = L.history_page(a, h, limit=10_000)[0].collect()
    assert len(total) > 170       # ties fill several rows
    for offset in (3, len(total) // 2):
        got, info = RK.deep_history_page(a, h, 9, offset, bins=4, piece=10)
        assert got.collect() == total[offset:offset + 9], offset
        assert tuple(info.first()) == (150, 9, offset, offset + 9 < 150)
    assert RK.deep_history_page(a, h, 9, len(total))[0].count() == 0


def test_no_task_holds_the_rows_before_the_page(spark):
    """The plan of the page sorts rows from its first one on, and keeps ``limit`` of them."""
    import contextlib
    import io
    df = spark.range(20_000).select("id", F.timestamp_add("SECOND", F.col("id"), F.lit(T0)).cast("timestamp_ntz").alias("created_at"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        RK.deep_page(df, 10, 10_000, piece=100).explain()
    plan = out.getvalue()
    assert "TakeOrderedAndProject(limit=10," in plan and "10010" not in plan
