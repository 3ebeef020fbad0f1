"""Pages at any depth (P1, P3, F8, F9): selection by rank instead of sorting up to it.

``ORDER BY ... LIMIT limit OFFSET offset`` as a top-k keeps ``offset + limit`` rows in one
place.  Here a histogram of the order key finds the piece that holds row ``offset``: the
key's range is cut into equal bins, rows are counted by bin (combined map-side; at most
``BINS`` rows come back), and the bin with the row is cut again until it holds few rows.
Only that piece is sorted, and the page is a top-k of ``limit`` rows from its first row on.
No row is shuffled, each look reads the order key alone, and from the second look on the
scan is filtered to the piece's range.

The order is ``created_at`` descending (NULL last), then ``id``.  A row may count as several
(``weight``): an article fills as many rows of a history page as it has latest analyses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.operators.lookup import PAGE_COLUMNS, count_total, page, page_info, with_latest_and_counts

BINS = 1024
PIECE = 50_000      # rows of the piece that is sorted
_LAST, _FIRST = (1 << 63) - 1, -(1 << 63)


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _keys(rows: DataFrame, weight: Column | None) -> DataFrame:
    """The order key as two longs, both ascending, and the weight."""
    return rows.select(F.coalesce(-_micros(F.col("created_at")), F.lit(_LAST)).alias("k1"),
                       F.coalesce(F.col("id").cast("long"), F.lit(_FIRST)).alias("k2"),
                       (F.lit(1) if weight is None else weight).cast("long").alias("w"))


def first_row(rows: DataFrame, offset: int, weight: Column | None = None, *, bins: int = BINS,
              piece: int = PIECE) -> tuple[int, int, int] | None:
    """(k1, k2, rows of it to skip) of the row that holds place ``offset`` (from 0), or None
    when there are fewer rows."""
    left = _keys(rows, weight)
    skip = offset
    for key in ("k1", "k2"):
        low, high, total, n = left.agg(F.min(key), F.max(key), F.sum("w"), F.count(F.lit(1))).first()
        if not n or skip >= total:
            return None
        while n > piece and low < high:
            width = -(-(high - low + 1) // bins)
            # as decimals: two longs may lie further apart than a long holds
            place = F.expr(f"(cast({key} as decimal(20,0)) - cast('{low}' as decimal(20,0))) div cast('{width}' as decimal(20,0))")
            counts = (left.where(F.col(key).between(low, high)).groupBy(place.alias("bin"))
                      .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("bin").take(bins))
            for r in counts:
                if skip < r["w"]:
                    low, high, n = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1), r["n"]
                    break
                skip -= r["w"]
        left = left.where(F.col(key).between(low, high))
        if n <= piece:
            break
    # a piece, or rows alike in both keys
    same = left.groupBy("k1", "k2").agg(F.sum("w").alias("w")).orderBy("k1", "k2").take(piece)
    for r in same:
        if skip < r["w"]:
            return r["k1"], r["k2"], skip
        skip -= r["w"]
    return None


def rows_from(rows: DataFrame, start: tuple[int, int, int]) -> DataFrame:
    """The rows at or after the place that ``first_row`` found."""
    k1, k2, _ = start
    if k1 == _LAST:
        after, here = F.lit(False), F.col("created_at").isNull()
    else:
        at = F.timestamp_add("MICROSECOND", F.lit(-k1), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        after, here = F.col("created_at").isNull() | (F.col("created_at") < at), F.col("created_at") == at
    id_ = F.lit(True) if k2 == _FIRST else F.col("id") >= k2
    return rows.where(after | (here & id_))


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def deep_page(rows: DataFrame, limit: int, offset: int, **options) -> DataFrame:
    """P1 at any depth: ``limit`` rows from place ``offset``, newest first, by rank."""
    start = first_row(rows, offset, **options)
    if start is None:
        return rows.limit(0)
    return page(rows_from(rows, start), _newest(), limit, start[2])


def deep_history_page(articles: DataFrame, history: DataFrame, limit: int, offset: int,
                      keys: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """P3, F8, F9 at any depth: (page, page_info) of the candidates ``keys`` (id, created_at; all
    articles by default) with their latest analyses and counts."""
    keys = (articles if keys is None else keys).select("id", "created_at")
    times = history.groupBy("article_id", "created_at").agg(F.count("id").alias("_n"))
    ties = times.groupBy("article_id").agg(F.max_by("_n", "created_at").alias("_rows"))
    weighed = keys.join(ties, F.col("id") == F.col("article_id"), "left").select(
        "id", "created_at", F.coalesce("_rows", F.lit(1).cast("long")).alias("_rows"))
    start = first_row(weighed, offset, F.col("_rows"), **options)
    info = page_info(count_total(keys), limit, offset)
    from_here = keys.limit(0) if start is None else page(rows_from(keys, start), _newest(), limit + start[2])
    ids = from_here.select("id")
    rows = with_latest_and_counts(articles.select(*PAGE_COLUMNS).join(ids, "id", "left_semi"), history,
                                  ids.withColumnRenamed("id", "article_id"))
    names = [*PAGE_COLUMNS, "analysis_id", "analysis_created_at", "analysis_credibility_score", "analysis_count"]
    return page(rows.select(*names), [*_newest(), F.asc_nulls_first("analysis_id")], limit, start[2] if start else 0), info
