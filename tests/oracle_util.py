"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from veracity.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating, float)):
        return float(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def multiset(pdf: pd.DataFrame, cols: list[str]) -> Counter:
    return Counter(tuple(norm(r[c]) for c in cols) for _, r in pdf.iterrows())


def assert_same(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> None:
    sc, dc = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    assert sc == dc, (sc, dc)
    assert len(spark_pdf) == len(duck_pdf)
    a, b = multiset(spark_pdf, sc), multiset(duck_pdf, sc)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
