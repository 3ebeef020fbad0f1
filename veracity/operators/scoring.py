"""Scoring jobs over article tables (E1-E14 as DataFrame operators).

``analyze_articles`` is the whole scoring batch of one article as one lazy
projection over (articles LEFT JOIN latest analysis): no model call, no UDF.
The analysis comes from the article's stored history (latest, highest id on
ties) or, when it has none, from the keyword fallback of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import scoring as S
from veracity.functions.text import (bare_host, short_summary, source_level, tags_from_string,
                                     topic_query, topic_tag_string, with_tags)
from veracity.operators.history import latest_analysis
from veracity.operators.lookup import similar_for_all


def analyze_articles(articles: DataFrame, history: DataFrame) -> DataFrame:
    """Source level, analysis (stored or fallback, normalised), index
    and its breakdown, summary and the similar-articles query per article."""
    lat = latest_analysis(history.select("id", "article_id", "created_at", "credibility_score",
                                         "bias_score", "topics"), dedup=True)
    lat = lat.select("article_id", F.col("id").alias("analysis_id"),
                     F.col("credibility_score").alias("_cs"), F.col("bias_score").alias("_bs"),
                     F.col("topics").alias("_tp"))
    a = articles.select("id", "source", "content").join(lat, F.col("id") == F.col("article_id"), "left")
    stored = F.col("analysis_id").isNotNull()
    # tags only for articles without a stored analysis; projected once
    a = (a.withColumn("_tag_str", F.when(~stored, topic_tag_string("content")))
         .withColumn("_tags", F.when(~stored, tags_from_string("_tag_str"))))
    level = source_level("source")
    cred = F.when(stored, F.coalesce("_cs", F.lit(S.FALLBACK_SCORE))).otherwise(F.lit(S.FALLBACK_SCORE))
    topics = F.when(stored, F.coalesce("_tp", S.fallback_topics())).otherwise(F.col("_tags"))
    bias = F.when(stored, F.col("_bs"))
    a = a.withColumn("_topics", topics)
    idx = S.index_breakdown(level, cred, bias)
    return a.select(
        "id",
        level.alias("source_credibility"),
        stored.alias("from_history"),
        cred.alias("credibility_score"),
        idx["score"].alias("credibility_index"),
        idx["source_contribution"].alias("source_contribution"),
        idx["content_contribution"].alias("content_contribution"),
        short_summary("content").alias("short_summary"),
        topic_query("_topics").alias("similar_query"),
    )


def latest_documents(documents: DataFrame) -> DataFrame:
    """The newest stored document (id, article_id, created_at, analysis_data) of every
    article, highest id on ties: article_id, topics (normalised, E9), key_points,
    potential_biases and query (the stored one, else the topics, else "general news")."""
    lat = documents.groupBy("article_id").agg(F.max_by("analysis_data", F.struct("created_at", "id")).alias("_d"))
    d = lat.withColumn("_f", S.fold_analysis("_d")).select(
        "article_id", F.coalesce("_f.topics", S.fallback_topics()).alias("topics"),
        F.col("_f.key_arguments").alias("key_points"),
        F.try_variant_get(F.try_parse_json("_d"), "$.potential_biases", "array<string>").alias("potential_biases"),
        F.col("_f.similar_articles_query").alias("_q"))
    return d.withColumn("query", topic_query("topics", "_q")).drop("_q")


def similar_by_analysis(articles: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """Q4 by each article's own stored analysis (``similar_for_all`` with its queries)."""
    return similar_for_all(articles, k, queries=latest_documents(documents).select("article_id", "query"))


def analyze_with_documents(articles: DataFrame, history: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """E13 whole: ``analyze_articles`` with the topics, key points and potential biases of
    the stored document (of the keyword fallback where there is none), the query that Q4
    takes, and the ids of its similar articles in order."""
    docs = latest_documents(documents)
    own = articles.select("id", "content").join(docs, F.col("id") == F.col("article_id"), "left")
    none = F.col("article_id").isNull()
    own = own.withColumn("_fb", F.when(none, S.text_fallback(F.col("content")))).select(
        "id", *[F.when(none, F.col(f"_fb.{c}")).otherwise(F.col(c)).alias(c)
                for c in ("topics", "key_points", "potential_biases")], F.col("query").alias("_q"))
    own = own.withColumn("similar_query", topic_query("topics", "_q")).drop("_q")
    found = (similar_for_all(articles, k, queries=docs.select("article_id", "query")).groupBy("id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "similar_id"))).alias("_s"))
             .select("id", F.col("_s.similar_id").alias("similar_ids")))      # at most k of an article
    return (analyze_articles(articles, history).drop("similar_query").join(own, "id").join(found, "id", "left")
            .withColumn("similar_ids", F.coalesce("similar_ids", F.array().cast("array<bigint>"))))


def decode_responses(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """E8 over a table of stored responses: one decoded document per row."""
    keys = [c for c in responses.columns if c != text_col]
    return responses.select(*keys, S.decode_response(text_col).alias("analysis")).select(*keys, "analysis.*")


def score_history(history: DataFrame, articles: DataFrame) -> DataFrame:
    """E2/E4 for every stored analysis, with its article's source level."""
    a = articles.select(F.col("id").alias("article_id"), "source")
    j = history.select(F.col("id").alias("analysis_id"), "article_id", "credibility_score", "bias_score") \
        .join(a, "article_id", "inner")
    level = source_level("source")
    idx = S.index_breakdown(level, "credibility_score", "bias_score")
    return j.select("analysis_id", "article_id", level.alias("source_credibility"),
                    idx["score"].alias("credibility_index"),
                    idx["source_contribution"].alias("source_contribution"),
                    idx["content_contribution"].alias("content_contribution"))


def host_counts(pages: DataFrame) -> DataFrame:
    """Pages per bare host (partial aggregation)."""
    return pages.select(bare_host("url").alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def topic_counts(articles: DataFrame) -> DataFrame:
    """Articles per keyword topic."""
    return (with_tags(articles.select("content"), "content")
            .select(F.explode_outer("tags").alias("topic"))  # never empty; no inferred filter
            .groupBy("topic").agg(F.count(F.lit(1)).alias("articles")))
