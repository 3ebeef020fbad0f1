"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables (through the views) in full; a limit
appears only where top-k is the operator's feature.  Nested results
(arrays, maps) are rendered as sorted, comma-joined text so that the Spark
answer and the SQL oracle can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions import scoring as SF
from veracity.functions import text as TX
from veracity.functions.text import join_set
from veracity.operators import feed as FD
from veracity.operators import history as H
from veracity.operators import lookup as L
from veracity.operators import postings as PO
from veracity.operators import ranked as RK
from veracity.operators import scoring as SC
from veracity.operators import stats
from veracity.operators import store as ST
from veracity.operators import versions as VS
from veracity.session import ensure_checkpoint_dir
from veracity.sources import pages as PG
from veracity.sources import views
from veracity.sources.tables import read_table
from veracity.streaming import streams as SS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_stats_from(views.articles(spark, d, url=False))


@register("source_credibility_chart")
def q_source_credibility_chart(spark, d):
    return stats.source_credibility_chart(_stats(spark, d))


@register("source_statistics")
def q_source_statistics(spark, d):
    return stats.source_statistics(_stats(spark, d))


@register("seed_source_stats")
def q_seed_source_stats(spark, d):
    # the counters of an empty store, seeded, then the fixture articles saved
    return _stats(spark, d).select("source", "high", "medium", "low", "total_analyzed", "is_initial")


@register("total_sources")
def q_total_sources(spark, d):
    return stats.total_sources(_stats(spark, d))


@register("seed_when_empty")
def q_seed_when_empty(spark, d):
    # an empty table takes the seeds, a table with rows none
    full = stats.batch_counts(views.articles(spark, d, url=False))
    cols = ("source", "high", "medium", "low", "total_analyzed", "is_initial")
    out = [stats.seed_source_stats(t).select(F.lit(case).alias("case"), *cols)
           for case, t in (("empty", full.filter("total_analyzed < 0")), ("kept", full))]
    return out[0].unionByName(out[1])


@register("credibility_distribution")
def q_credibility_distribution(spark, d):
    return stats.credibility_distribution(views.articles(spark, d, url=False))


@register("corpus_totals")
def q_corpus_totals(spark, d):
    return stats.corpus_totals(views.articles(spark, d, level=False, url=False))


# ------------------------------------------------------------------ history


AS_OF = "2024-01-10"


def _ah(spark, d, level=False, url=False):
    return views.articles(spark, d, level=level, url=url), views.history(spark, d)


@register("multi_analysis_articles")
def q_multi_analysis_articles(spark, d):
    return H.multi_analysis_articles(*_ah(spark, d))


@register("latest_analysis")
def q_latest_analysis(spark, d):
    a, h = _ah(spark, d, level=True)
    j = H.articles_with_latest(a.select("id", "title", "source", "credibility_level", "created_at"),
                               h.select("id", "article_id", "created_at", "credibility_score",
                                        "sentiment_score", "bias_score", "topics"))
    return j.select("id", "title", "source", "credibility_level", "created_at", "analysis_id",
                    "analysis_created_at", "analysis_credibility_score", "analysis_sentiment_score",
                    "analysis_bias_score", join_set("analysis_topics").alias("analysis_topics"))


@register("article_with_history")
def q_article_with_history(spark, d):
    a, h = _ah(spark, d)
    j = H.article_with_history(a.select("id", "title"),
                               h.select("id", "article_id", "created_at", "credibility_score"))
    return j.select("id", "title", "analysis_id", "analysis_created_at", "position",
                    "analysis_credibility_score")


@register("analysis_counts")
def q_analysis_counts(spark, d):
    a, h = _ah(spark, d)
    return H.with_analysis_counts(a.select("id", "title"), h).select("id", "title", "analysis_count")


@register("analysis_quality")
def q_analysis_quality(spark, d):
    return H.analysis_quality(*_ah(spark, d))


@register("consistency")
def q_consistency(spark, d):
    return H.consistency(*_ah(spark, d))


for _metric in ("depth", "completeness", "timeliness"):
    def _mk(metric):
        def q(spark, d):
            return H.oldest_metrics(*_ah(spark, d)).select("id", metric)
        return q
    register(_metric)(_mk(_metric))


@register("quality_summary")
def q_quality_summary(spark, d):
    return H.quality_summary(*_ah(spark, d))


@register("score_trend")
def q_score_trend(spark, d):
    return H.score_trend(*_ah(spark, d))


@register("topic_evolution")
def q_topic_evolution(spark, d):
    r = H.topic_evolution(*_ah(spark, d), kind="topic")
    return r.withColumn("all_topics", F.array_join("all_topics", ","))


@register("perspective_evolution")
def q_perspective_evolution(spark, d):
    r = H.topic_evolution(*_ah(spark, d), kind="perspective")
    return r.withColumn("all_perspectives", F.array_join("all_perspectives", ","))


@register("topic_change_steps")
def q_topic_change_steps(spark, d):
    r = H.change_steps(*_ah(spark, d), kind="topic")
    return r.select("id", "analysis_id", "date", F.array_join("added", ",").alias("added"),
                    F.array_join("removed", ",").alias("removed"))


@register("perspective_change_steps")
def q_perspective_change_steps(spark, d):
    r = H.change_steps(*_ah(spark, d), kind="perspective")
    return r.select("id", "analysis_id", "date", F.array_join("added", ",").alias("added"),
                    F.array_join("removed", ",").alias("removed"))


@register("analysis_evolution")
def q_analysis_evolution(spark, d):
    r = H.analysis_evolution(*_ah(spark, d)).drop("first_analysis_date", "last_analysis_date")
    return (r.withColumn("all_topics", F.array_join("all_topics", ","))
            .withColumn("all_perspectives", F.array_join("all_perspectives", ",")))


@register("evolution_summary")
def q_evolution_summary(spark, d):
    return H.evolution_summary(*_ah(spark, d))


@register("analysis_comparison")
def q_analysis_comparison(spark, d):
    return H.analysis_comparison(*_ah(spark, d))


@register("topic_diff")
def q_topic_diff(spark, d):
    r = H.topic_diff(*_ah(spark, d))
    return r.select("id", *[F.array_join(c, ",").alias(c)
                            for c in ("topics_added", "topics_removed", "topics_common")])


@register("perspective_diff")
def q_perspective_diff(spark, d):
    return H.perspective_diff(*_ah(spark, d))


@register("comparison_summary")
def q_comparison_summary(spark, d):
    return H.comparison_summary(*_ah(spark, d))


@register("credibility_changes")
def q_credibility_changes(spark, d):
    return H.credibility_changes(*_ah(spark, d))


@register("credibility_trend")
def q_credibility_trend(spark, d):
    a, h = _ah(spark, d, level=True)
    return H.credibility_trend(a, h, days=7, as_of=AS_OF)


@register("credibility_history")
def q_credibility_history(spark, d):
    a, h = _ah(spark, d, level=True)
    return H.credibility_history(a, h, days=7, as_of=AS_OF)


@register("multiple_analyses")
def q_multiple_analyses(spark, d):
    return H.multiple_analyses(*_ah(spark, d))


@register("analysis_complexity")
def q_analysis_complexity(spark, d):
    # the reference has two identical operators (H3); one plan, both names
    return H.multiple_analyses(*_ah(spark, d))


@register("analysis_trends")
def q_analysis_trends(spark, d):
    return H.multiple_analyses(*_ah(spark, d), days=7, as_of=AS_OF)


# ------------------------------------------------------------------ lookups

SEARCH_TERM = "The_"
SIMILAR_TOPICS = ["Ether", "ü"]
TOPIC_TERMS = ["ai_", "ether"]


def lookup_keys(spark, d):
    """Existence probes derived from the data: every page (its <title> and
    url) and every benchmark passage (its first 60 characters, no url)."""
    p = read_table(spark, d, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("key_id"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), "url")
    b = read_table(spark, d, "benchmark").select(
        F.concat(F.lit("bench:"), F.col("item_id").cast("string")).alias("key_id"),
        F.substring("text", 1, 60).alias("title"), F.lit(None).cast("string").alias("url"))
    return p.unionByName(b)


def _labelled_ids(spark, d):
    return read_table(spark, d, "labels").select(F.col("doc_id").alias("id"))


@register("article_exists")
def q_article_exists(spark, d):
    a = views.articles(spark, d, level=False)
    return L.article_exists(a, lookup_keys(spark, d), titles=_keys(spark, d))


def _hist_rows(df):
    return df.select("id", "title", "analysis_id", "analysis_created_at", "position")


@register("article_by_id")
def q_article_by_id(spark, d):
    a, h = _ah(spark, d)
    return _hist_rows(L.article_by_id(a, h, _labelled_ids(spark, d), columns=[]))


@register("article_by_url")
def q_article_by_url(spark, d):
    a, h = _ah(spark, d, url=True)
    urls = read_table(spark, d, "pages").select("url")
    return _hist_rows(L.article_by_url(a, h, urls, columns=[]))


@register("daily_buzz")
def q_daily_buzz(spark, d):
    return _hist_rows(L.daily_buzz(*_ah(spark, d), columns=[]))


@register("article_history")
def q_article_history(spark, d):
    h = views.history(spark, d)
    return L.article_history(h, _labelled_ids(spark, d), columns=["credibility_score"]).select(
        "id", "article_id", "created_at", "position", "credibility_score")


def _full(spark, d):
    return views.articles(spark, d), views.history(spark, d)


def _keys(spark, d, level=False):
    """The article table without the joins that a filter or an order doesn't need."""
    return views.articles(spark, d, level=level, url=False)


@register("articles_by_source")
def q_articles_by_source(spark, d):
    return L.articles_by_source(*_full(spark, d), source="src3", limit=10, keys=_keys(spark, d))


@register("recent_articles")
def q_recent_articles(spark, d):
    return L.recent_articles(*_full(spark, d), days=7, limit=10, as_of=AS_OF, keys=_keys(spark, d))


FILTER_ARGS = dict(source="src1", level="High", date_from="2024-01-02", date_to="2024-01-20",
                   limit=5, offset=2)
RANGE_ARGS = dict(start="2024-01-03", end="2024-01-09", limit=10, offset=5)


@register("filter_articles")
def q_filter_articles(spark, d):
    return L.filter_articles(*_full(spark, d), **FILTER_ARGS, keys=_keys(spark, d, level=True))[0]


@register("filter_articles_info")
def q_filter_articles_info(spark, d):
    return L.filter_articles(*_full(spark, d), **FILTER_ARGS, keys=_keys(spark, d, level=True))[1]


@register("articles_in_range")
def q_articles_in_range(spark, d):
    return L.articles_in_range(*_full(spark, d), **RANGE_ARGS, keys=_keys(spark, d))[0]


@register("articles_in_range_info")
def q_articles_in_range_info(spark, d):
    return L.articles_in_range(*_full(spark, d), **RANGE_ARGS, keys=_keys(spark, d))[1]


@register("history_page")
def q_history_page(spark, d):
    return L.history_page(*_full(spark, d), limit=10, offset=20, keys=_keys(spark, d))[0]


@register("page_info")
def q_page_info(spark, d):
    return L.history_page(*_full(spark, d), limit=10, offset=20, keys=_keys(spark, d))[1]


@register("article_page")
def q_article_page(spark, d):
    a = views.articles(spark, d, level=False, url=False).select("id", "title", "created_at")
    return L.page(a, [F.desc("created_at"), F.asc("id")], limit=10, offset=30)


@register("article_page_deep")
def q_article_page_deep(spark, d):
    a = views.articles(spark, d, level=False, url=False).select("id", "title", "created_at")
    return RK.deep_page(a, limit=10, offset=a.count() // 2)


@register("history_page_deep")
def q_history_page_deep(spark, d):
    keys = _keys(spark, d)
    return RK.deep_history_page(*_full(spark, d), limit=10, offset=keys.count() // 2, keys=keys)[0]


@register("search_articles")
def q_search_articles(spark, d):
    return L.search_articles(*_full(spark, d), term=SEARCH_TERM, limit=10, keys=_keys(spark, d, level=True))


@register("similar_articles")
def q_similar_articles(spark, d):
    return L.similar_articles(*_full(spark, d), topics=SIMILAR_TOPICS, limit=5, keys=_keys(spark, d, level=True))


@register("articles_with_topics")
def q_articles_with_topics(spark, d):
    return L.articles_with_topics(*_full(spark, d), topics=TOPIC_TERMS, limit=10, offset=10, keys=_keys(spark, d))[0]


@register("articles_with_topics_info")
def q_articles_with_topics_info(spark, d):
    return L.articles_with_topics(*_full(spark, d), topics=TOPIC_TERMS, limit=10, offset=10, keys=_keys(spark, d))[1]


@register("similar_for_all")
def q_similar_for_all(spark, d):
    return L.similar_for_all(views.articles(spark, d, level=False, url=False), k=3)


@register("similar_by_analysis")
def q_similar_by_analysis(spark, d):
    return SC.similar_by_analysis(views.articles(spark, d, level=False, url=False), views.analysis_documents(spark, d))


@register("similar_by_text")
def q_similar_by_text(spark, d):
    # what is similar by the words of an article's own title
    a = views.articles(spark, d, level=False, url=False).select("id", "title", "short_summary", "content", "created_at")
    words = F.regexp_extract_all(TX.ascii_lower("title"), F.lit("[a-z]{6,}"), 0)
    queries = a.select("id", F.array_join(F.slice(words, 1, 2), " OR ").alias("query"))
    return PO.similar_by_text(a, queries).select("id", "rank", "similar_id")


# ------------------------------------------------------------------ scoring / text


@register("source_level")
def q_source_level(spark, d):
    a = views.articles(spark, d, level=False)
    return a.select("id", "source", "url", TX.source_level("source").alias("level_by_source"),
                    TX.source_level("url").alias("level_by_url"))


def named_hosts(spark, d):
    """Every page's url under one of several hosts, so that each rule of E1 is met."""
    hosts = ["www.bbc.com", "reuters.com", "edition.cnn.com", "www.dailymail.co.uk", "data.agency.gov",
             "lab.college.edu", "plain.example.org", "breitbart.com"]
    host = F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % len(hosts) + 1).cast("int"))
    return read_table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 9 == 8, host)
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/"), F.col("page_id").cast("string"))).alias("source"))


@register("source_level_by_host")
def q_source_level_by_host(spark, d):
    return named_hosts(spark, d).select("page_id", "source", TX.source_level("source").alias("level"))


@register("score_band")
def q_score_band(spark, d):
    h = views.history(spark, d)
    return h.select("id", "credibility_score", TX.score_band("credibility_score").alias("faq_band"),
                    TX.chart_band("credibility_score").alias("chart_band"))


@register("credibility_index")
def q_credibility_index(spark, d):
    return SC.score_history(views.history(spark, d), views.articles(spark, d, level=False, url=False))


@register("short_summary")
def q_short_summary(spark, d):
    a = views.articles(spark, d, level=False, url=False)
    return a.select("id", TX.short_summary("content").alias("short_summary"))


@register("content_preview")
def q_content_preview(spark, d):
    a = views.articles(spark, d, level=False, url=False)
    return a.select("id", TX.content_preview("content").alias("content_preview"))


@register("tag_topics")
def q_tag_topics(spark, d):
    a = views.articles(spark, d, level=False, url=False)
    return TX.with_tags(a.select("id", "content"), "content").select(
        "id", F.array_join("tags", ",").alias("topics"))


@register("topic_counts")
def q_topic_counts(spark, d):
    return SC.topic_counts(views.articles(spark, d, level=False, url=False))


@register("build_topic_query")
def q_build_topic_query(spark, d):
    h = views.history(spark, d)
    return h.select("id", TX.topic_query("topics").alias("query"))


@register("host_counts")
def q_host_counts(spark, d):
    return SC.host_counts(read_table(spark, d, "pages").select("url"))


@register("normalize_analysis")
def q_normalize_analysis(spark, d):
    h = views.history(spark, d)
    c, t = SF.normalize_scores("credibility_score", "topics")
    return h.select("id", c.alias("credibility_score"), F.array_join(t, ",").alias("topics"))


@register("fold_analysis")
def q_fold_analysis(spark, d):
    doc = views.analysis_documents(spark, d).withColumn("a", SF.fold_analysis("analysis_data"))
    return doc.select("id", "a.credibility_score", "a.sentiment_score", "a.bias_score",
                      F.array_join("a.topics", ",").alias("topics"), F.array_max("a.topic_relevance").alias("top_relevance"),
                      F.array_join("a.key_arguments", ",").alias("key_arguments"),
                      F.array_join(F.array_sort(F.map_keys("a.perspectives")), ",").alias("perspectives"),
                      F.col("a.perspectives")["western"]["summary"].alias("western_summary"),
                      "a.similar_articles_query", "a.news_integrity")


@register("topic_relevance")
def q_topic_relevance(spark, d):
    a = TX.with_tags(views.articles(spark, d, level=False, url=False).select("id", "content"), "content")
    return a.select("id", F.explode(TX.with_relevance("tags")).alias("t")).select("id", "t.name", "t.relevance")


@register("default_documents")
def q_default_documents(spark, d):
    p = read_table(spark, d, "pages").select("page_id", SF.default_analysis(F.col("url")).alias("a"))
    return p.select("page_id", "a.credibility_score", "a.explanation", F.array_join("a.topics", ",").alias("topics"),
                    "a.similar_articles_query", "a.error", "a.outcome")


@register("decode_response")
def q_decode_response(spark, d):
    r = SC.decode_responses(views.stored_responses(spark, d))
    return r.select("conv_id", "turn", "credibility_score", "explanation",
                    F.array_join("topics", ",").alias("topics"),
                    F.array_join("key_points", "|").alias("key_points"),
                    "similar_articles_query", "error", "outcome")


@register("decode_stored_documents")
def q_decode_stored_documents(spark, d):
    # responses that hold a JSON document inside prose
    docs = views.analysis_documents(spark, d).select(
        "id", F.concat(F.lit("Here it is:\n"), "analysis_data", F.lit("\nDone.")).alias("response_text"))
    return SC.decode_responses(docs).select(
        "id", "credibility_score", "explanation", F.array_join("topics", ",").alias("topics"),
        F.array_join("key_points", "|").alias("key_points"), "similar_articles_query", "error", "outcome")


@register("build_prompt")
def q_build_prompt(spark, d):
    a = views.articles(spark, d, level=False, url=False)
    return a.select("id", SF.build_prompt("content", "source").alias("prompt"))


@register("analyze_articles")
def q_analyze_articles(spark, d):
    return SC.analyze_articles(views.articles(spark, d, level=False, url=False),
                               views.history(spark, d))


@register("analyze_with_documents")
def q_analyze_with_documents(spark, d):
    a = SC.analyze_with_documents(views.articles(spark, d, level=False, url=False), views.history(spark, d),
                                  views.analysis_documents(spark, d))
    return a.select("id", "source_credibility", "credibility_score", "similar_query",
                    F.array_join("topics", ",").alias("topics"), F.array_join("key_points", "|").alias("key_points"),
                    F.array_join("potential_biases", "|").alias("potential_biases"),
                    F.array_join(F.col("similar_ids").cast("array<string>"), ",").alias("similar_ids"))


# ------------------------------------------------------------------ store

NOW = "2024-02-01 00:00:00"
TALK_HOST = "talk.example.org"
FEATURED_TITLE = "Featured: how the sources compare this week"


def _seq(kind: int, first, second=None):
    """The order of a submission: pages, then passages, then turns; unique at any scale."""
    second = F.lit(0) if second is None else second
    return F.struct(F.lit(kind).alias("kind"), first.cast("long").alias("first"),
                    second.cast("long").alias("second")).alias("seq")


def save_batch(spark, d):
    """Submissions derived from the data: every page (its extracted title and text,
    host and url: all urls already stored, so updates), every benchmark passage (no
    url: inserts) and every turn of a conversation filed under one of
    50 discussion urls (new urls, each repeated: first row creates, last
    row's values win)."""
    p = PG.extract_pages(read_table(spark, d, "pages"))
    pages = p.select(_seq(0, F.col("page_id")), "title", TX.bare_host("url").alias("source"),
                     "url", F.coalesce("text", "title").alias("content"), TX.source_level("url").alias("credibility_level"),
                     F.lit(False).alias("is_featured"))
    bench = read_table(spark, d, "benchmark").select(
        _seq(1, F.col("item_id")), F.substring("text", 1, 60).alias("title"),
        F.lit("benchmark").alias("source"), F.lit(None).cast("string").alias("url"),
        F.col("text").alias("content"), F.lit("Medium").alias("credibility_level"),
        F.lit(False).alias("is_featured"))
    talk = read_table(spark, d, "conversations").select(
        _seq(2, F.col("conv_id"), F.col("turn")),
        F.substring("text", 1, 60).alias("title"), F.lit(TALK_HOST).alias("source"),
        F.concat(F.lit(f"https://{TALK_HOST}/"), (F.col("conv_id") % 50).cast("string")).alias("url"),
        F.col("text").alias("content"), F.lit("Low").alias("credibility_level"),
        F.lit(False).alias("is_featured"))
    return _with_document(pages.unionByName(bench).unionByName(talk))


def _with_document(df):
    """The analysis document of a submission: a score by its level and the content's topics."""
    score = (F.when(F.col("credibility_level") == "High", 0.9).when(F.col("credibility_level") == "Medium", 0.6)
             .otherwise(0.3))
    return (TX.with_tags(df, "content", "_tags")
            .withColumn("analysis_data", F.to_json(F.struct(score.alias("credibility_score"), F.col("_tags").alias("topics"))))
            .drop("_tags"))


def _document(df, *cols):
    """``cols`` and the stored document's score and topics, decoded."""
    return df.withColumn("_d", SF.fold_analysis("analysis_data")).select(
        *cols, F.col("_d.credibility_score").alias("credibility_score"),
        F.array_join("_d.topics", ",").alias("topics"))


def _store_articles(spark, d):
    return views.articles(spark, d).drop("lang")


@register("upsert_articles")
def q_upsert_articles(spark, d):
    out = ST.upsert_articles(_store_articles(spark, d), save_batch(spark, d), NOW)
    return _document(out, "id", "title", "source", "url", "short_summary", "credibility_level",
                     "created_at", "updated_at", "is_featured")


@register("append_history")
def q_append_history(spark, d):
    h = views.history(spark, d)
    rows = ST.append_history(h, _store_articles(spark, d), save_batch(spark, d), NOW)
    return _document(rows, "id", "article_id", "created_at")


def _saved_store(spark, d):
    """A store made of the views, into which the batch is saved in two parts."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/veracity-store-{uuid.uuid4().hex[:12]}"
    h = _encoded_history(spark, d)
    a = _store_articles(spark, d).withColumn("analysis_data", F.lit(None).cast("string"))
    VS.create_store(spark, base, a, h, stats.source_stats_from(_store_articles(spark, d)), buckets=32)
    batch = save_batch(spark, d)
    VS.save_batch(spark, base, batch.where("seq.kind = 0"), NOW)
    return VS.save_batch(spark, base, batch.where("seq.kind > 0"), NOW)


def _encoded_history(spark, d):
    return views.history(spark, d).select("id", "article_id", "created_at", F.lit(None).cast("string").alias("analysis_data"))


@register("stored_articles")
def q_stored_articles(spark, d):
    return _document(_saved_store(spark, d).table("articles"), "id", "title", "source", "url", "short_summary",
                     "credibility_level", "created_at", "updated_at", "is_featured")


@register("stored_history")
def q_stored_history(spark, d):
    # the rows that the saves added
    new = _saved_store(spark, d).table("history").where("analysis_data is not null")
    return _document(new, "id", "article_id", "created_at")


def label_patch(spark, d):
    """Partial updates derived from the labels: toxic -> level Low,
    good and clean -> featured; other fields left alone."""
    lab = read_table(spark, d, "labels")
    return lab.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"),
                      F.when(F.col("toxic") == 1, F.lit("Low")).alias("credibility_level"),
                      F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(True)).alias("is_featured"),
                      F.when(F.col("quality") == 0, F.lit('{"credibility":{"score":0.2},"topics":["review"]}'))
                      .alias("analysis_data"))


@register("update_articles")
def q_update_articles(spark, d):
    a = _store_articles(spark, d).withColumn("analysis_data", F.lit(None).cast("string"))
    out = ST.update_articles(a, label_patch(spark, d), NOW)
    return _document(out, "id", "source", "credibility_level", "is_featured", "updated_at", "was_updated")


@register("history_from_update")
def q_history_from_update(spark, d):
    rows = ST.history_from_update(views.history(spark, d), _keys(spark, d), label_patch(spark, d), NOW, ["analysis_data"])
    return _document(rows, "id", "article_id", "created_at")


@register("restate_source_stats")
def q_restate_source_stats(spark, d):
    a = _store_articles(spark, d)
    after = ST.update_articles(a, label_patch(spark, d), NOW)
    st = stats.source_stats_from(a)
    return stats.restate_source_stats(st, a, after).select(
        "source", "high", "medium", "low", "total_analyzed", "is_initial")


@register("restate_moved_sources")
def q_restate_moved_sources(spark, d):
    # low-quality articles move to another source; the observed rule (compat)
    a = _store_articles(spark, d)
    moves = read_table(spark, d, "labels").filter("quality = 0").select(
        F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"), F.lit("moved.example.org").alias("source"))
    after = ST.update_articles(a, moves, NOW)
    return stats.restate_source_stats(stats.source_stats_from(a), a, after, compat=True).select(
        "source", "high", "medium", "low", "total_analyzed", "is_initial")


@register("update_source_stats")
def q_update_source_stats(spark, d):
    st = stats.source_stats_from(_store_articles(spark, d))
    b = save_batch(spark, d).withColumn("updated_at", F.to_timestamp_ntz(F.lit(NOW)))
    return stats.update_source_stats(st, b).select(
        "source", "high", "medium", "low", "total_analyzed", "is_initial", "last_updated")


@register("validate_articles")
def q_validate_articles(spark, d):
    good, bad = ST.validate_articles(_store_articles(spark, d))
    g = good.select("id", F.lit("").alias("reasons"))
    b = bad.select("id", F.array_join("reasons", "; ").alias("reasons"))
    return g.unionByName(b)


def broken_articles(spark, d):
    """The articles with rule violations: missing titles and sources, an unknown level, ids twice."""
    a = views.articles(spark, d, url=False).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("title")).alias("title"),
        F.when(F.col("id") % 11 != 0, F.col("source")).alias("source"),
        F.when(F.col("id") % 17 != 0, F.col("content")).alias("content"),
        F.when(F.col("id") % 5 == 0, F.lit("Unknown")).when(F.col("id") % 5 == 1, F.lit(None))
        .otherwise(F.col("credibility_level")).alias("credibility_level"))
    return a.unionByName(a.filter(F.col("id") % 13 == 0))


@register("validate_broken_articles")
def q_validate_broken_articles(spark, d):
    good, bad = ST.validate_articles(broken_articles(spark, d))
    return good.select("id", F.lit("").alias("reasons")).unionByName(
        bad.select("id", F.array_join("reasons", "; ").alias("reasons")))


@register("orphan_history")
def q_orphan_history(spark, d):
    return ST.orphan_history(views.history(spark, d), views.articles(spark, d, level=False, url=False)) \
        .select("id", "article_id", "created_at")


@register("cascade_delete")
def q_cascade_delete(spark, d):
    toxic = read_table(spark, d, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    _, h = ST.cascade_delete(views.articles(spark, d, level=False, url=False), views.history(spark, d), toxic)
    return h.select("id", "article_id")


@register("cascade_delete_articles")
def q_cascade_delete_articles(spark, d):
    toxic = read_table(spark, d, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    a, _ = ST.cascade_delete(views.articles(spark, d, level=False, url=False), views.history(spark, d), toxic)
    return a.select("id", "title", "source")


@register("seed_featured")
def q_seed_featured(spark, d):
    a = _store_articles(spark, d)
    feat = a.limit(0).unionByName(spark.createDataFrame(
        [(0, FEATURED_TITLE, "veracity", None, FEATURED_TITLE, FEATURED_TITLE, "High", None, None, True)],
        a.schema))
    feat = feat.withColumn("created_at", F.to_timestamp_ntz(F.lit(NOW))).withColumn(
        "updated_at", F.to_timestamp_ntz(F.lit(NOW)))
    return ST.seed_featured(a, feat).select("id", "title", "is_featured")


@register("encode_analysis")
def q_encode_analysis(spark, d):
    h = views.history(spark, d).drop("k")
    return ST.encode_analysis(h.select("id", "credibility_score", "sentiment_score", "bias_score", "topics",
                                       "key_arguments", "perspectives"))


@register("decode_analysis")
def q_decode_analysis(spark, d):
    enc = q_encode_analysis(spark, d)
    dec = ST.decode_analysis(enc)
    return dec.select("id", "credibility_score", "sentiment_score", "bias_score",
                      F.array_join("topics", ",").alias("topics"),
                      F.array_join("key_arguments", ",").alias("key_arguments"),
                      F.array_join(F.array_sort(F.map_keys("perspectives")), ",").alias("perspectives"))


# ------------------------------------------------------------------ pages / feed

NEWS_QUERY = "Ether OR the_"
EVERYTHING_QUERY = "ether OR ai_"
FEED_DOMAINS = ["blog.tionsh.example.net", "thther.example.org", "blog.ththan.example.net", "ththhe.example.com"]
FEED_SOURCES = ["src1", "src2", "src3"]


@register("extract_pages")
def q_extract_pages(spark, d):
    return PG.extract_pages(read_table(spark, d, "pages"))


@register("page_extraction_report")
def q_page_extraction_report(spark, d):
    return PG.page_extraction_report(PG.extract_pages(read_table(spark, d, "pages")))


def route_inputs(spark, d):
    """Submissions as typed: every conversation turn and every page url."""
    c = read_table(spark, d, "conversations").select(
        F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
        .alias("input_id"), F.col("text").alias("input_text"))
    p = read_table(spark, d, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("input_id"),
        F.concat(F.lit("  "), F.col("url"), F.lit("\n")).alias("input_text"))
    return c.unionByName(p)


@register("route_input")
def q_route_input(spark, d):
    return PG.route_input(route_inputs(spark, d)).select("input_id", "kind", "error", "title", "source",
                                                         F.length("input").cast("long").alias("input_length"))


def _feed_articles(spark, d):
    return views.articles(spark, d, level=False)


@register("search_news")
def q_search_news(spark, d):
    return FD.search_news(_feed_articles(spark, d), NEWS_QUERY, "2024-01-02", "2024-01-20", "en",
                          keys=_keys(spark, d))[0]


@register("search_news_total")
def q_search_news_total(spark, d):
    return FD.search_news(_keys(spark, d), NEWS_QUERY, "2024-01-02", "2024-01-20", "en")[1]


@register("search_news_relevancy")
def q_search_news_relevancy(spark, d):
    hosts = FEED_DOMAINS
    return FD.search_news(_feed_articles(spark, d), NEWS_QUERY, language=None, sort_by="relevancy", page_size=15,
                          domains=hosts)[0]


@register("get_everything")
def q_get_everything(spark, d):
    return FD.get_everything(_feed_articles(spark, d), EVERYTHING_QUERY, page_size=5, keys=_keys(spark, d))


@register("news_article_by_url")
def q_news_article_by_url(spark, d):
    return FD.news_article_by_url(_feed_articles(spark, d), read_table(spark, d, "pages").select("url"))


@register("top_headlines")
def q_top_headlines(spark, d):
    return FD.top_headlines(_feed_articles(spark, d), country="fr", category="technology", keys=_keys(spark, d))[0]


@register("top_headlines_total")
def q_top_headlines_total(spark, d):
    return FD.top_headlines(_keys(spark, d), country="fr", category="technology")[1]


@register("top_headlines_by_source")
def q_top_headlines_by_source(spark, d):
    return FD.top_headlines(_feed_articles(spark, d), country="us", sources=FEED_SOURCES, page_size=12,
                            keys=_keys(spark, d))[0]


@register("list_sources_by_country")
def q_list_sources_by_country(spark, d):
    return FD.list_sources(_keys(spark, d), category="technology", country="fr")


@register("list_sources")
def q_list_sources(spark, d):
    return FD.list_sources(_keys(spark, d), language="en")


# ------------------------------------------------------------------ streams

QUOTA_PER, QUOTA_N = "1 minute", 10
REUSE_TTL = 3600


@register("source_stats_stream")
def q_source_stats_stream(spark, d):
    return SS.source_stats_stream(spark, d).select("source", "high", "medium", "low", "total_analyzed",
                                                   "is_initial")


def _events(spark, d):
    return read_table(spark, d, "events")


@register("quota_windows")
def q_quota_windows(spark, d):
    return SS.quota_windows(_events(spark, d), QUOTA_PER, QUOTA_N)


@register("quota_windows_daily")
def q_quota_windows_daily(spark, d):
    # a limit that the events exceed
    return SS.quota_windows(_events(spark, d), "1 day", 1)


@register("quota_admissions_daily")
def q_quota_admissions_daily(spark, d):
    return SS.quota_admissions(_events(spark, d), "1 day", 1)


@register("quota_admissions")
def q_quota_admissions(spark, d):
    return SS.quota_admissions(_events(spark, d), QUOTA_PER, QUOTA_N)


#: limits that the events exceed, of clients that share a route
TIGHT_LIMITS = [(60, 1), (3600, 2), (86_400, 12)]


@register("quota_admissions_combined")
def q_quota_admissions_combined(spark, d):
    return SS.quota_admissions_combined(_events(spark, d))


@register("quota_admissions_combined_tight")
def q_quota_admissions_combined_tight(spark, d):
    return SS.quota_admissions_combined(_events(spark, d), TIGHT_LIMITS, "event_type")


@register("quota_admissions_stream")
def q_quota_admissions_stream(spark, d):
    return SS.quota_admissions_stream(spark, d, TIGHT_LIMITS, "event_type").select(
        "event_id", "client", "admitted", "refused_by", "late")


@register("restated_stats_stream")
def q_restated_stats_stream(spark, d):
    return SS.restated_stats_stream(spark, d).select("source", "high", "medium", "low", "total_analyzed", "is_initial")


@register("quota_windows_stream")
def q_quota_windows_stream(spark, d):
    return SS.quota_windows_stream(spark, d, QUOTA_PER, QUOTA_N)


@register("reusable_results")
def q_reusable_results(spark, d):
    return SS.reusable_results(SS.submissions_from_events(_events(spark, d)), REUSE_TTL)


@register("reusable_results_stream")
def q_reusable_results_stream(spark, d):
    return SS.reusable_results_stream(spark, d, REUSE_TTL)


@register("latest_analysis_stream")
def q_latest_analysis_stream(spark, d):
    return SS.latest_analysis_stream(spark, d)


@register("feedback_check")
def q_feedback_check(spark, d):
    return SS.feedback_check(views.feedback(spark, d)).select("conv_id", "turn", "valid", "reason")
