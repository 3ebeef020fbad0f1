"""Keyed state machines against walks over the rows, one after the other."""

from __future__ import annotations

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracity.operators import stats
from veracity.streaming import keyed
from veracity.streaming import streams as SS

T0 = dt.datetime(2024, 1, 1)


def put_files(folder, name, frames):
    """Files that the source reads in the order of ``frames``."""
    folder.mkdir(exist_ok=True)
    for n, df in enumerate(frames):
        path = folder / f"{name}_{n:04}.parquet"
        df.to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def event_files(folder, parts):
    """parts of (event_id, user_id, event_type, second)."""
    return put_files(folder, "events", [
        pd.DataFrame([(i, u, e, pd.Timestamp(T0) + pd.Timedelta(seconds=s), "p") for i, u, e, s in part],
                     columns=["event_id", "user_id", "event_type", "ts", "props"]) for part in parts])


def limited(rows, limits):
    """(event_id, client, second) -> event_id: (admitted, refused_by), in order of time."""
    used, out = {}, {}
    for i, client, s in sorted(rows, key=lambda r: (r[2], r[0])):
        keys = [(client, w, s // w) for w, _ in limits]
        full = next((w for k, (w, n) in zip(keys, limits) if used.get(k, 0) >= n), None)
        if full is None:
            for k in keys:
                used[k] = used.get(k, 0) + 1
        out[i] = (full is None, full)
    return out


def requests(seed, n=1200, days=3):
    """One client holds two thirds; bursts that fill minutes, hours and days."""
    rnd = random.Random(seed)
    burst = [rnd.randrange(days * 86400) for _ in range(25)]
    return [(i, rnd.choice([7, 7, 7, 7, 1, 2]), "e", min(days * 86400 - 1, rnd.choice(burst) + int(rnd.expovariate(1 / 900))))
            for i in range(n)]


LIMITS = [(60, 2), (3600, 9), (86400, 60)]


def test_combined_limits_equal_a_walk(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")     # the hot client is cut over many pieces
    try:
        for seed, limits in enumerate([LIMITS, [(60, 1)], [(3600, 3), (7200, 4)], [(86400, 5), (60, 3)], [(60, 0), (3600, 1)]]):
            rows = requests(seed, 700)
            df = spark.createDataFrame([(i, u, T0 + dt.timedelta(seconds=s)) for i, u, _, s in rows],
                                       "event_id long, user_id long, ts timestamp_ntz")
            got = {r.event_id: (r.admitted, r.refused_by) for r in SS.quota_admissions_combined(df, limits).collect()}
            want = limited([(i, u, s) for i, u, _, s in rows], sorted(limits))
            assert got == want
        assert {w for _, w in limited([(i, u, s) for i, u, _, s in requests(0, 700)], LIMITS).values()} == {None, 60, 3600, 86400}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_limit_is_the_single_window_operator(spark):
    rows = requests(5, 500)
    df = spark.createDataFrame([(i, u, T0 + dt.timedelta(seconds=s)) for i, u, _, s in rows],
                               "event_id long, user_id long, ts timestamp_ntz")
    one = SS.quota_admissions(df, "1 hour", 3).select("event_id", "admitted").collect()
    assert sorted(one) == sorted(SS.quota_admissions_combined(df, [(3600, 3)]).select("event_id", "admitted").collect())


def test_windows_must_divide_each_other(spark):
    for bad in ([], [(60, 1), (90, 2)], [(0, 1)]):
        with pytest.raises(ValueError):
            keyed.check_nested(bad)
    none = spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz")
    assert SS.quota_admissions_combined(none).count() == 0


def test_admission_stream_equals_the_batch_for_files_in_order(spark, tmp_path):
    rows = sorted(requests(8), key=lambda r: (r[3], r[0]))
    d = event_files(tmp_path / "t", [rows[i:i + 60] for i in range(0, len(rows), 60)])
    base = str(tmp_path / "s")
    got = SS.quota_admissions_stream(spark, d, LIMITS, base=base, max_files_per_trigger=1).collect()
    assert {r.event_id: (r.admitted, r.refused_by) for r in got} == limited([(i, u, s) for i, u, _, s in rows], LIMITS)
    assert len(got) == len(rows) and not any(r.late for r in got)
    # one row a client at most is held, and the clients of closed days are gone
    held = spark.read.format("statestore").option("stateVarName", "state").load(f"{base}/checkpoint").count()
    assert held <= 3
    assert SS.dropped_rows(spark, base) == 0


def test_late_requests_are_counted_and_use_up_nothing(spark, tmp_path):
    day = 86400
    parts = [[(1, 7, "e", 5 * day)], [(2, 7, "e", 5 * day + 70), (3, 7, "e", 5 * day + 75)],
             [(4, 7, "e", 5 * day + 10), (5, 8, "e", 0), (6, 7, "e", 5 * day + 80)], [(7, 9, "e", 9 * day)],
             [(8, 8, "e", 10), (9, 9, "e", 9 * day + 1), (10, 9, "e", 9 * day + 2)]]
    d = event_files(tmp_path / "t", parts)
    got = {r.event_id: (r.admitted, r.refused_by, r.late) for r in
           SS.quota_admissions_stream(spark, d, [(60, 2), (day, 4)], base=str(tmp_path / "s"), max_files_per_trigger=1).collect()}
    yes, late = (True, None, False), (None, None, True)
    # 4: its minute is over; 5 and 8: their day is behind the watermark; 6: the minute is full
    assert got == {1: yes, 2: yes, 3: yes, 4: late, 5: late, 6: (False, 60, False), 7: yes, 8: late, 9: yes, 10: (False, 60, False)}


class HeldState:
    """One key's value state and timers."""

    def __init__(self):
        self.value, self.timers = None, set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_a_hot_clients_answers_come_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(keyed, "ROWS_AT_ONCE", 50)
    rows = [(i, 7, s) for i, _, _, s in requests(5, 900)]
    held, machine = HeldState(), keyed.LimitMachine(LIMITS)
    machine.init(held)
    got = {}
    for days in (range(0, 1), range(1, 3)):      # two triggers, each of many frames in any order
        mine = [(i, s * 1_000_000, True) for i, _, s in rows if s // 86400 in days]
        frames = [pd.DataFrame(mine[k:k + 40], columns=["event_id", "t", "known"]) for k in range(0, len(mine), 40)]
        for pdf in machine.handleInputRows(("7",), iter(frames), held):
            assert len(pdf) <= 50
            got |= {r.event_id: (r.admitted, r.refused_by) for r in pdf.itertuples()}
    assert got == limited(rows, LIMITS) and len(held.timers) == 1


def test_requests_without_id_or_client_are_answered(spark, tmp_path):
    d = str(tmp_path / "t")
    big = 2**60 + 1     # no float holds it
    rows = [(1, "a", 0), (None, "a", 5), (big, "a", 5), (3, None, 1), (4, None, 2), (None, None, 90)]
    df = spark.createDataFrame([(i, e, T0 + dt.timedelta(seconds=s)) for i, e, s in rows],
                               "event_id long, event_type string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(f"{d}/events.parquet")
    got = SS.quota_admissions_stream(spark, d, [(60, 1)], "event_type", base=str(tmp_path / "s")).collect()
    assert {(r.event_id, r.client, r.admitted, r.refused_by, r.late) for r in got} == {
        (1, "a", True, None, False), (None, "a", False, 60, False), (big, "a", False, 60, False),
        (3, None, True, None, False), (4, None, False, 60, False), (None, None, True, None, False)}


def test_reuse_state_is_an_anchor_and_expires(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted(((i, 0, f"k{rnd.randrange(30)}", rnd.randrange(20 * 86400)) for i in range(600)), key=lambda r: (r[3], r[0]))
    d = event_files(tmp_path / "t", [rows[i::1][k:k + 60] for i in [0] for k in range(0, 600, 60)])
    base = str(tmp_path / "s")
    got = SS.reusable_results_stream(spark, d, base=base, max_files_per_trigger=1)
    want = SS.reusable_results(SS.submissions_from_events(spark.read.parquet(d)))
    cols = ["event_id", "key", "ts", "hit", "cached_at"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    log = spark.read.parquet(f"{base}/changes")
    assert log.where("late").count() == 0
    # the last trigger's watermark is a day back: what was cached before has left the state
    held = spark.read.format("statestore").option("stateVarName", "state").load(f"{base}/checkpoint").count()
    last_files = {e for *_, e, s in rows if s >= rows[-1][3] - 2 * 86400}
    assert 0 < held <= 30 and held <= len(last_files) + 5


def test_reuse_stream_over_unordered_files_marks_late_rows(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, 0, rnd.choice(["hot", "hot", "a", "b", f"x{i}"]), rnd.randrange(5 * 86400)) for i in range(700)]
    d = event_files(tmp_path / "t", [rows[i::70] for i in range(70)])
    base = str(tmp_path / "s")
    got = SS.reusable_results_stream(spark, d, base=base, max_files_per_trigger=20)
    cols = ["event_id", "key", "ts", "hit", "cached_at"]
    want = SS.reusable_results(SS.submissions_from_events(spark.read.parquet(d)))
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    log = spark.read.parquet(f"{base}/changes")
    assert log.count() == 700 and 0 < log.where("late").count() < 700


def test_changes_in_any_order_equal_the_restated_counters(spark, tmp_path):
    rnd = random.Random(6)
    docs = pd.DataFrame([(i, rnd.choice(["CNN", "a", "b", "c"])) for i in range(120)], columns=["doc_id", "source"])
    labels = pd.DataFrame([(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 150, 2)], columns=["doc_id", "quality", "toxic"])
    folder = tmp_path / "t"
    put_files(folder, "documents", [docs[k::5] for k in range(5)])
    put_files(folder, "labels", [labels[k::4] for k in range(4)])     # some before their document
    # the static reader takes one table folder
    (folder / "labels.parquet").mkdir()
    for k in range(4):
        os.rename(folder / f"labels_{k:04}.parquet", folder / "labels.parquet" / f"part_{k}.parquet")
    got = SS.restated_stats_stream(spark, str(folder), base=str(tmp_path / "s"), max_files_per_trigger=1)
    d = spark.createDataFrame(docs).join(spark.createDataFrame(labels), "doc_id", "left")
    from veracity.sources.views import article_level
    before = d.select(F.col("doc_id").alias("id"), "source", article_level().alias("credibility_level"))
    after = d.select(F.col("doc_id").alias("id"), "source",
                     F.when(F.col("toxic") == 1, "Low").otherwise(article_level()).alias("credibility_level"))
    want = stats.restate_source_stats(stats.source_stats_from(before), before, after)
    cols = ["source", "high", "medium", "low", "total_analyzed", "is_initial"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_changes_follow_sequence_numbers_not_arrival(spark, tmp_path):
    """Patches before inserts, older patches after newer ones, moves between sources."""
    changes = [(1, 5, False, "z", None), (1, 0, True, "a", "High"), (1, 3, False, "y", "Low"), (2, 0, True, "a", "Medium"),
               (2, 2, False, None, "High"), (2, 1, False, None, "Low"), (3, 4, False, "q", "High"), (4, 0, True, "b", None)]
    cols = ["id", "seq", "inserts", "source", "credibility_level"]
    d = put_files(tmp_path / "t", "changes", [pd.DataFrame([c], columns=cols).astype({"source": "string", "credibility_level": "string"})
                                              for c in changes])
    base = str(tmp_path / "s")
    schema = "id long, seq long, inserts boolean, source string, credibility_level string"
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/changes*.parquet")
    with keyed.rocksdb_state(spark):
        SS.run_available(keyed.change_stream(sdf), base, "append")
    assert spark.conf.get(keyed.PROVIDER) != keyed.ROCKSDB
    log = spark.read.parquet(f"{base}/changes")
    net = {(r.source, r.credibility_level): r.n for r in
           log.groupBy("source", "credibility_level").agg(F.sum("change").alias("n")).collect() if r.n}
    # article 1: source by 5, level by 3; article 3 was never inserted
    assert net == {("z", "Low"): 1, ("a", "High"): 1, ("b", None): 1}
    counts = {r.source: (r.high, r.medium, r.low, r.total_analyzed) for r in keyed.counted_changes(log).collect()}
    assert counts["z"] == (0, 0, 1, 1) and counts["a"] == (1, 0, 0, 1) and counts["b"] == (0, 0, 1, 1)
    assert counts.get("y", (0, 0, 0, 0)) == (0, 0, 0, 0)
