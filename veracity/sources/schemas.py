"""Explicit schemas of the article store."""

from __future__ import annotations

from pyspark.sql import types as T

PERSPECTIVE = T.StructType([
    T.StructField("credibility", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("key_points", T.ArrayType(T.StringType())),
])

CREDIBILITY_INDEX = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("source_contribution", T.DoubleType()),
    T.StructField("content_contribution", T.DoubleType()),
])

# The canonical analysis document: one flat struct that the three document
# shapes (model response, featured seed, metric reader) are folded into.
ANALYSIS = T.StructType([
    T.StructField("credibility_score", T.DoubleType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("bias_score", T.DoubleType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("key_arguments", T.ArrayType(T.StringType())),
    T.StructField("perspectives", T.MapType(T.StringType(), PERSPECTIVE)),
    T.StructField("summary", T.StringType()),
    T.StructField("similar_articles_query", T.StringType()),
    T.StructField("news_integrity", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

ANALYSIS_FIELDS = [f.name for f in ANALYSIS.fields]

ARTICLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("short_summary", T.StringType()),
    T.StructField("credibility_level", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("is_featured", T.BooleanType()),
])

HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("article_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("analysis", ANALYSIS),
])

SOURCE_STATS = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("high", T.LongType()),
    T.StructField("medium", T.LongType()),
    T.StructField("low", T.LongType()),
    T.StructField("total_analyzed", T.LongType()),
    T.StructField("is_initial", T.BooleanType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

SCORE_FIELDS = ("credibility_score", "sentiment_score", "bias_score")
