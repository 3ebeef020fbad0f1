"""Static rules for the library code: operators never pull data
to the driver, and windows are partitioned (one bounded exception)."""

from __future__ import annotations

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "veracity"


def _sources():
    return {p: p.read_text() for p in ROOT.rglob("*.py")}


def test_no_driver_collection_in_library():
    bad = [str(p) for p, s in _sources().items()
           if re.search(r"\.(collect|toPandas|toLocalIterator)\(", s) or "localCheckpoint" in s]
    assert not bad, bad


def test_windows_are_partitioned():
    # the only unpartitioned window runs over one row per partition (dense_index offsets)
    hits = [(str(p), m.group(0)) for p, s in _sources().items()
            for m in re.finditer(r"Window\.orderBy\([^)]*\)", s)]
    assert hits == [(str(ROOT / "plans" / "ordered.py"), 'Window.orderBy("_pid")')], hits


def test_no_broadcast_hints():
    # sizes are measured at run time by adaptive execution, never assumed
    raw = [(str(p), i) for p, s in _sources().items() for i, line in enumerate(s.splitlines()) if "F.broadcast(" in line]
    assert not raw, raw


def test_no_cross_or_nested_loop_joins_in_any_plan(spark):
    import contextlib
    import io

    from veracity.plans.catalog import QUERIES
    bad = []
    for name, q in QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            q(spark, "/root/testdata/sf0.001").explain()
        plan = buf.getvalue()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            bad.append(name)
    assert not bad, bad
