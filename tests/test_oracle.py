"""Every registered query equals its SQL oracle (the driver's gate),
at the smallest scale for speed and at sf0.01 for the tie cases."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_util import assert_same, duck

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def test_every_library_query_has_an_oracle():
    # the optional training-data queries have tests of their own in tests/llm
    from veracity.plans.catalog import QUERIES as LIBRARY
    assert set(LIBRARY) <= set(ORACLE), set(LIBRARY) - set(ORACLE)


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle_small(spark, con_small, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con_small.execute(ORACLE[name]).df()
    assert_same(got, want)


TIE_CASES = ["latest_analysis", "history_page", "analysis_quality", "analysis_evolution",
             "comparison_summary", "similar_for_all"]


@pytest.mark.parametrize("name", TIE_CASES)
def test_query_matches_oracle_sf001(spark, name):
    got = QUERIES[name](spark, SF_CHECK).toPandas()
    want = duck(SF_CHECK).execute(ORACLE[name]).df()
    assert_same(got, want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "overall_rating" in df.columns
