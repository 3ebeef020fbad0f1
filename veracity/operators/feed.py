"""Article-feed operators (N1-N5), re-aimed from a remote news service at
the article table: query search, headlines, url lookup, source listing.

Feed record: id, title, description (= short summary), source, url,
published_at (= created_at), lang, host.  Query grammar: terms joined by
`` OR `` (the form the scoring job builds); a term matches title,
description or content with SQLite LIKE folding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import any_like_ci, bare_host, like_ci, with_tags

# Our mapping of feed countries to article languages.
COUNTRY_LANGUAGE = {"us": "en", "gb": "en", "au": "en", "fr": "fr", "de": "de", "es": "es", "mx": "es"}
SORTS = ("publishedAt", "relevancy")

FEED_COLUMNS = ["id", "title", "description", "source", "url", "published_at", "lang"]


def feed(articles: DataFrame) -> DataFrame:
    """Project the article table into feed records (keeps content for matching)."""
    return articles.select("id", "title", F.col("short_summary").alias("description"), "source", "url",
                           F.col("created_at").alias("published_at"), "lang", "content")


def query_terms(query: str) -> list[str]:
    return [t.strip() for t in query.split(" OR ") if t.strip()]


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_results"))


def search_news(articles: DataFrame, query: str, from_date: str | None = None, to_date: str | None = None,
                language: str | None = "en", sort_by: str = "publishedAt", page_size: int = 20,
                domains: list[str] | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the articles matching ``query`` and the filters.

    Dates are whole days (inclusive); ``domains`` match the url's host
    without ``www.``.  ``relevancy`` ranks title matches first.  ``keys`` may give
    the article table without joins the filters don't need: the page is chosen there.
    """
    terms = query_terms(query or "")
    if not terms:
        raise ValueError("Query parameter is required")
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}")
    f = feed(articles if keys is None else keys)
    conds: list[Column] = [any_like_ci(["title", "description", "content"], terms)]
    if language:
        conds.append(F.col("lang") == language)
    if from_date:
        conds.append(F.to_date("published_at") >= F.to_date(F.lit(from_date)))
    if to_date:
        conds.append(F.to_date("published_at") <= F.to_date(F.lit(to_date)))
    if domains:
        conds.append(bare_host("url").isin(*domains))
    cand = f.filter(reduce(lambda a, b: a & b, conds))
    order = [F.desc("published_at"), F.asc("id")]
    if sort_by == "relevancy":
        title_hit = reduce(lambda a, b: a | b, [F.coalesce(like_ci("title", t), F.lit(False)) for t in terms])
        order = [F.when(title_hit, 1).otherwise(2), *order]
    return _feed_page(cand, articles, order, page_size), _total(cand)


def _feed_page(cand: DataFrame, articles: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` candidates: ids first, then their records."""
    ids = cand.select("id", "published_at", "title").orderBy(*order).limit(size).select("id")
    rows = feed(articles).join(ids, "id", "left_semi")
    return rows.select(*FEED_COLUMNS).orderBy(*order).limit(size)


def get_everything(articles: DataFrame, query: str, page_size: int = 5, keys: DataFrame | None = None) -> DataFrame:
    """The first ``page_size`` matches of ``query``, newest first."""
    return search_news(articles, query, language=None, page_size=page_size, keys=keys)[0]


def news_article_by_url(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """The feed record of each requested url (exact match)."""
    req = urls.select("url").filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()
    return feed(articles).join(req, "url", "left_semi").select(*FEED_COLUMNS)


def top_headlines(articles: DataFrame, country: str = "us", category: str | None = None,
                  sources: list[str] | None = None, page_size: int = 20,
                  keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest articles of the country's language, optionally of one
    topic tag (E7) and of some sources; (page, total)."""
    f = feed(articles if keys is None else keys).filter(F.col("lang") == COUNTRY_LANGUAGE.get(country, country))
    if sources:
        f = f.filter(F.col("source").isin(*sources))
    if category:
        f = with_tags(f, "content").filter(F.array_contains("tags", category.lower()))
    return _feed_page(f, articles, [F.desc("published_at"), F.asc("id")], page_size), _total(f)


def list_sources(articles: DataFrame, category: str | None = None, language: str | None = "en",
                 country: str | None = None) -> DataFrame:
    """The distinct sources with their article count, filtered by
    language (or country) and topic tag."""
    f = feed(articles)
    lang = COUNTRY_LANGUAGE.get(country, country) if country else language
    if lang:
        f = f.filter(F.col("lang") == lang)
    if category:
        f = with_tags(f, "content").filter(F.array_contains("tags", category.lower()))
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("articles"),
                                   F.max("published_at").alias("latest_published_at"))
