"""Point lookups, filters, paging and search.

Lookups take a DataFrame of keys, never a driver-side list, so one plan
answers any number of requests.  Every ordered result breaks ties by id
(and analysis id), so a page is the same page in every engine.

Top-k pages are planned so the expensive part only touches the page: the
``k = offset + limit`` best ids are chosen first (TakeOrderedAndProject:
each task keeps k rows) from ``keys``, a narrow form of the article table that
joins nothing the filter and the order don't need (the article table itself when
not given); url, level, text and history are then looked up for those ids only,
through semi joins that Catalyst pushes below the table's own joins.  Totals are
counted on ``keys`` too.  The page
is exact even when latest-analysis ties add rows, because every article
contributes at least one row, so the page never needs more than k articles.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import any_like_ci, level_rank, like_ci, with_tags
from veracity.operators.history import latest_analysis

PAGE_COLUMNS = ["id", "title", "source", "short_summary", "credibility_level", "url",
                "created_at", "updated_at"]


# ------------------------------------------------------------------ paging (P*)

def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``ORDER BY ... LIMIT limit OFFSET offset`` (top-k, no full sort)."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def page_info(total: DataFrame | Column, limit: int, offset: int = 0) -> DataFrame:
    """One row total, limit, offset, has_more.

    ``total`` is a one-row DataFrame with a ``total`` column.
    """
    return total.select(
        F.col("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def count_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def with_latest_and_counts(page_articles: DataFrame, history: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Attach the latest analysis (ties multiply rows) and the analysis count
    to a set of articles.  With ``ids`` (article_id) the history is first narrowed to
    those articles."""
    h = history.select("article_id", "id", "created_at", "credibility_score")
    if ids is not None:
        h = h.join(ids, "article_id", "left_semi")
    per = h.groupBy("article_id").agg(F.count("id").alias("analysis_count"), F.max("created_at").alias("created_at"))
    lat = h.join(per, ["article_id", "created_at"]).select(
        "article_id", F.col("id").alias("analysis_id"), F.col("created_at").alias("analysis_created_at"),
        F.col("credibility_score").alias("analysis_credibility_score"), "analysis_count")
    a = page_articles.join(lat, page_articles["id"] == lat["article_id"], "left").drop("article_id")
    return a.withColumn("analysis_count", F.coalesce("analysis_count", F.lit(0).cast("long")))


def _page_with_latest(candidates: DataFrame, articles: DataFrame, history: DataFrame, order: list[Column],
                      limit: int, offset: int = 0, rank_cols: tuple[str, ...] = ()) -> DataFrame:
    """``candidates``: id, created_at and ``rank_cols`` of the matching articles."""
    top = page(candidates.select("id", "created_at", *rank_cols), order, limit + offset)
    ids = top.select("id")
    rows = articles.select(*PAGE_COLUMNS).join(ids, "id", "left_semi")
    if rank_cols:
        rows = rows.join(top.select("id", *rank_cols), "id")
    rows = with_latest_and_counts(rows, history, ids.withColumnRenamed("id", "article_id"))
    names = [*PAGE_COLUMNS, *rank_cols, "analysis_id", "analysis_created_at", "analysis_credibility_score", "analysis_count"]
    return page(rows.select(*names), [*order, F.asc_nulls_first("analysis_id")], limit, offset)


# ------------------------------------------------------------------ lookups (F*)

def article_exists(articles: DataFrame, keys: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """for each key (key_id, title, url): does an article have that
    title or that url?  Empty strings count as missing; both missing -> False.
    ``titles`` may give the titles without the table's joins.  Titles and urls are
    first narrowed to the probed ones and made distinct, so a title that a third of
    all articles carry is one row.

    Two semi joins (one per equality) instead of one OR join, which Spark
    could only run as a nested loop.
    """
    t = F.when(F.col("title") != "", F.col("title"))
    u = F.when(F.col("url") != "", F.col("url"))
    k = keys.select("key_id", t.alias("title"), u.alias("url"))

    def known(df: DataFrame, c: str) -> DataFrame:
        probed = k.select(c).filter(F.col(c).isNotNull()).distinct()
        return df.select(c).join(probed, c, "left_semi").distinct()
    by_title = k.join(known(articles if titles is None else titles, "title"), "title", "left_semi")
    by_url = k.join(known(articles, "url"), "url", "left_semi")
    hits = by_title.select("key_id").union(by_url.select("key_id")).distinct() \
        .withColumn("exists", F.lit(True))
    return (k.join(hits, "key_id", "left")
            .select("key_id", "title", "url", F.coalesce("exists", F.lit(False)).alias("exists")))


def article_by_id(articles: DataFrame, history: DataFrame, ids: DataFrame,
                  columns: list[str] | None = None) -> DataFrame:
    """the requested articles (``ids.id``) with their analysis history
    as rows, newest first (``position`` 1 = newest)."""
    from veracity.operators.history import article_with_history
    a = articles.join(ids.select("id").distinct(), "id", "left_semi")
    h = history.join(ids.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi")
    return article_with_history(a, h, newest_first=True, columns=columns)


def article_by_url(articles: DataFrame, history: DataFrame, urls: DataFrame,
                   columns: list[str] | None = None) -> DataFrame:
    """the article of each requested url (lowest id when several share
    it) with its history rows."""
    from veracity.operators.history import article_with_history
    req = urls.select("url").filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()
    a = (articles.join(req, "url", "left_semi")
         .groupBy("url").agg(F.min("id").alias("id")))
    hit = articles.join(a.select("id"), "id", "left_semi")
    h = history.join(a.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return article_with_history(hit, h, newest_first=True, columns=columns)


def daily_buzz(articles: DataFrame, history: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """the featured article (latest, then lowest id) and its history."""
    from veracity.operators.history import article_with_history
    feat = page(articles.filter(F.col("is_featured")), _newest(), 1)
    h = history.join(feat.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return article_with_history(feat, h, newest_first=True, columns=columns)


def article_history(history: DataFrame, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """the analyses of the requested articles, newest first, with the history's
    ``columns`` (all by default)."""
    from veracity.plans.ordered import with_previous
    if columns is not None:
        history = history.select(*dict.fromkeys(["article_id", "created_at", "id", *columns]))
    h = history.join(ids.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_semi")
    seq = with_previous(h, ["article_id"], "created_at", "id", [])
    return seq.withColumn("position", F.col("group_size") - F.col("seq") + 1) \
        .drop("seq", "has_prev", "group_size")


def articles_by_source(articles: DataFrame, history: DataFrame, source: str, limit: int = 10,
                       keys: DataFrame | None = None) -> DataFrame:
    """newest articles of one source with latest analysis and count."""
    cand = (articles if keys is None else keys).filter(F.col("source") == source)
    return _page_with_latest(cand, articles, history, _newest(), limit).drop("source")


def recent_filter(days: int, as_of: str) -> Column:
    """Articles created on or after the date ``days`` before ``as_of``."""
    return F.to_date("created_at") >= F.date_sub(F.to_date(F.lit(as_of)), days)


def recent_articles(articles: DataFrame, history: DataFrame, days: int = 7, limit: int = 10,
                    as_of: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """newest articles created within ``days`` of ``as_of`` (a date;
    defaults to today, pass it for reproducible results)."""
    as_of = as_of or dt.date.today().isoformat()
    cand = (articles if keys is None else keys).filter(recent_filter(days, as_of))
    return _page_with_latest(cand, articles, history, _newest(), limit)


def _ts_bound(d: str) -> Column:
    return F.to_timestamp_ntz(F.lit(d))


def filter_predicate(source: str | None = None, level: str | None = None,
                     date_from: str | None = None, date_to: str | None = None) -> Column:
    """F8 predicate: the given conditions ANDed (none -> TRUE).  Date bounds
    are timestamps (a bare date means midnight, so ``date_to`` excludes the
    rest of that day, as the text comparison of the reference does)."""
    conds = []
    if source:
        conds.append(F.col("source") == source)
    if level:
        conds.append(F.col("credibility_level") == level)
    if date_from:
        conds.append(F.col("created_at") >= _ts_bound(date_from))
    if date_to:
        conds.append(F.col("created_at") <= _ts_bound(date_to))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def filter_articles(articles: DataFrame, history: DataFrame, source: str | None = None,
                    level: str | None = None, date_from: str | None = None,
                    date_to: str | None = None, limit: int = 10, offset: int = 0,
                    keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F8: (page, page_info) of the articles matching every given filter."""
    cand = (articles if keys is None else keys).filter(filter_predicate(source, level, date_from, date_to))
    rows = _page_with_latest(cand, articles, history, _newest(), limit, offset)
    return rows, page_info(count_total(cand), limit, offset)


def articles_in_range(articles: DataFrame, history: DataFrame, start: str, end: str,
                      limit: int = 10, offset: int = 0, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """inclusive BETWEEN on created_at, paged, with the total."""
    cand = (articles if keys is None else keys).filter(F.col("created_at").between(_ts_bound(start), _ts_bound(end)))
    rows = _page_with_latest(cand, articles, history, _newest(), limit, offset)
    return rows, page_info(count_total(cand), limit, offset)


def history_page(articles: DataFrame, history: DataFrame, limit: int = 10, offset: int = 0,
                 keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All articles newest first with latest analysis and count, paged."""
    cand = articles if keys is None else keys
    rows = _page_with_latest(cand, articles, history, _newest(), limit, offset)
    return rows, page_info(count_total(cand), limit, offset)


# ------------------------------------------------------------------ search (Q*)

def search_articles(articles: DataFrame, history: DataFrame, term: str, limit: int = 10,
                    keys: DataFrame | None = None) -> DataFrame:
    """Q1: match in title, summary or content (SQLite LIKE folding); rank
    title 1, summary 2, content 3; then High, Medium, other; then newest."""
    if not term:
        return articles.limit(0).select(*PAGE_COLUMNS)
    t, s = like_ci("title", term), like_ci("short_summary", term)
    match = any_like_ci(["title", "short_summary", "content"], [term])
    rank = F.when(F.coalesce(t, F.lit(False)), 1).when(F.coalesce(s, F.lit(False)), 2).otherwise(3)
    cand = ((articles if keys is None else keys).filter(match)
            .select("id", "created_at", rank.alias("match_rank"),
                    level_rank("credibility_level").alias("level_rank")))
    order = [F.asc("match_rank"), F.asc("level_rank"), *_newest()]
    return _page_with_latest(cand, articles, history, order, limit, rank_cols=("match_rank", "level_rank"))


def similar_articles(articles: DataFrame, history: DataFrame, topics: list[str], limit: int = 5,
                     keys: DataFrame | None = None) -> DataFrame:
    """Q2: any topic in summary or content; High/Medium only; level rank,
    then newest.  No topics -> no rows."""
    if not topics:
        return articles.limit(0).select(*PAGE_COLUMNS)
    cand = ((articles if keys is None else keys)
            .filter(any_like_ci(["short_summary", "content"], topics) & F.col("credibility_level").isin("High", "Medium"))
            .select("id", "created_at", level_rank("credibility_level").alias("level_rank")))
    return _page_with_latest(cand, articles, history, [F.asc("level_rank"), *_newest()], limit,
                             rank_cols=("level_rank",))


def articles_with_topics(articles: DataFrame, history: DataFrame, topics: list[str], limit: int = 10,
                         offset: int = 0, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Q3: as Q2 without the level filter, newest first, paged, with total."""
    if not topics:
        empty = articles.limit(0).select(*PAGE_COLUMNS)
        return empty, page_info(count_total(empty), limit, offset)
    cand = (articles if keys is None else keys).filter(any_like_ci(["short_summary", "content"], topics))
    rows = _page_with_latest(cand, articles, history, _newest(), limit, offset)
    return rows, page_info(count_total(cand), limit, offset)


def similar_for_all(articles: DataFrame, k: int = 3, salt: int = 64,
                    queries: DataFrame | None = None) -> DataFrame:
    """Q4: for every article, the ``k`` newest other articles that share a
    topic of its query (query topics = the article's first three tags, E7).

    ``queries`` (article_id, query; one row an article) holds the queries of the stored
    analyses, topics joined by ' OR ' (``scoring.latest_documents``): an article that has
    one is answered by it, the others by their tags, and letter case doesn't count.

    Never builds all pairs: only the k+1 newest articles of a tag can be
    anyone's answer, so those are found first (a two-level top-k: per
    (tag, salt) then per tag, so a tag holding a third of all articles is
    still split over ``salt`` tasks).  The result is at most
    tags x (k+1) rows — bounded by the fixed tag vocabulary — and is
    broadcast to every article.
    """
    from pyspark.storagelevel import StorageLevel
    from pyspark.sql import Window
    # the tags are needed twice (candidates and queries); keep the narrow
    # (id, created_at, tags) projection instead of scanning the text twice
    tagged = (with_tags(articles.select("id", "created_at", "content"), "content")
              .select("id", "created_at", F.array_distinct("tags").alias("tags"),
                      F.array_distinct(F.slice("tags", 1, 3)).alias("query_tags")))
    if queries is not None:
        terms = F.transform(F.split(F.lower("query"), " or "), F.trim)
        q = queries.select(F.col("article_id").alias("id"), F.array_distinct(terms).alias("_terms"))
        tagged = (tagged.join(q, "id", "left")
                  .select("id", "created_at", F.array_distinct(F.transform("tags", F.lower)).alias("tags"),
                          F.coalesce("_terms", F.array_distinct(F.transform("query_tags", F.lower))).alias("query_tags")))
    tagged = tagged.persist(StorageLevel.MEMORY_AND_DISK)
    per_tag = tagged.select("id", "created_at", "tags", F.explode("tags").alias("tag"))
    salted = per_tag.withColumn("_s", F.abs(F.xxhash64("id")) % salt)
    w1 = Window.partitionBy("tag", "_s").orderBy(F.desc("created_at"), "id")
    local = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k + 1)
    w2 = Window.partitionBy("tag").orderBy(F.desc("created_at"), "id")
    best = (local.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k + 1)
            .select("tag", F.col("id").alias("similar_id"),
                    F.col("created_at").alias("similar_created_at"),
                    F.col("tags").alias("similar_tags")))
    pairs = (tagged.select("id", "query_tags", F.explode("query_tags").alias("tag"))
             .join(best, "tag")
             .filter(F.col("similar_id") != F.col("id"))
             .select("id", "similar_id", "similar_created_at",
                     F.size(F.array_intersect("query_tags", "similar_tags")).cast("long").alias("shared_topics"))
             .dropDuplicates(["id", "similar_id"]))
    w3 = Window.partitionBy("id").orderBy(F.desc("similar_created_at"), "similar_id")
    return (pairs.withColumn("rank", F.row_number().over(w3).cast("long")).filter(F.col("rank") <= k)
            .select("id", "rank", "similar_id", "shared_topics"))
