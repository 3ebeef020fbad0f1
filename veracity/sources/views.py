"""The article-store views over the driver tables (FIXTURES.md §2).

``articles``  documents, labelled by ``labels`` and addressed by ``pages``
``history``   one analysis per event (``analysis_history``)
``feedback``  feedback submissions from conversation turns

The views are built lazily and only join what the caller asks for: a query
that needs neither the level nor the url never scans ``labels``/``pages``.
Column pruning then keeps the wide ``text`` column out of any plan that does
not project title, content or summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.functions.text import short_summary
from veracity.sources.tables import read_table

# Fixed values of the fixture mapping (FIXTURES.md §2).
ARTICLE_EPOCH = "2024-01-01 00:00:00"
ARTICLE_STEP_MINUTES = 37
ARTICLE_CYCLE = 14_200_000
TITLE_CHARS = 60
TOPIC_BY_K5 = ["politics", "economy", "technology", "science", "health"]
TOPIC_BY_K3 = ["politics", "conflict", "media"]
PERSPECTIVES_BY_K4 = [["western"], ["western", "neutral"], ["neutral"], ["western", "neutral", "eastern"]]
FEEDBACK_TYPES_BY_CONV5 = ["bug", "suggestion", "question", "other", ""]


def _pick(index: Column, values: list) -> Column:
    """``values[index]`` for a small fixed list, as a CASE expression."""
    expr = None
    for i, v in enumerate(values):
        lit = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def article_time(doc_id: Column) -> Column:
    """The article's time: one step of ARTICLE_STEP_MINUTES per id, starting over after
    ARTICLE_CYCLE ids (about a thousand years), so that every BIGINT id has a time."""
    steps = F.pmod(doc_id.cast("long"), F.lit(ARTICLE_CYCLE).cast("long"))
    return F.timestamp_add("MINUTE", steps * ARTICLE_STEP_MINUTES, F.lit(ARTICLE_EPOCH).cast("timestamp_ntz"))


def article_level() -> Column:
    """The level of an article by its label (quality, toxic)."""
    return (F.when(F.col("quality") == 0, "Low")
            .when((F.col("quality") == 1) & (F.col("toxic") == 0), "High").otherwise("Medium"))


def articles(spark: SparkSession, sf_dir: str, *, level: bool = True,
             url: bool = True) -> DataFrame:
    """Article table: id, title, source, url, lang, content, short_summary,
    credibility_level, created_at, updated_at, is_featured.

    ``level=False`` / ``url=False`` skip the join that feeds that column
    (the column is then NULL); both joins are on the documents' key and are
    planned by Catalyst/AQE (sort-merge, or broadcast when the measured side
    is under the broadcast threshold).
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    df = docs
    if level:
        labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        df = df.join(labels, "doc_id", "left")
    if url:
        pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
        df = df.join(pages, "doc_id", "left")
    lvl = article_level() if level else F.lit(None).cast("string")
    created = article_time(F.col("doc_id"))
    return df.select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, TITLE_CHARS).alias("title"),
        F.col("source"),
        (F.col("url") if url else F.lit(None).cast("string")).alias("url"),
        F.col("lang"),
        F.col("text").alias("content"),
        short_summary("text").alias("short_summary"),
        lvl.alias("credibility_level"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (F.col("doc_id") == 0).alias("is_featured"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis history in the canonical flat shape:
    id, article_id, created_at, credibility_score, sentiment_score,
    bias_score, topics, key_arguments, perspectives, summary, k.

    ``perspectives`` is a map key -> {credibility, summary, key_points}; the
    credibility of a perspective is the FAQ band of the analysis' score.
    """
    return history_from_events(read_table(spark, sf_dir, "events"))


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _case(index: str, values: list) -> str:
    """SQL ``CASE index WHEN 0 THEN values[0] ...`` for a small fixed list."""
    def lit(v):
        return "array(" + ", ".join(_sql_str(x) for x in v) + ")" if isinstance(v, list) else _sql_str(v)
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def history_from_events(events: DataFrame) -> DataFrame:
    """The history projection of an events DataFrame (batch or stream).

    Written as SQL expression text: the fixed lookup tables become CASE
    expressions and the whole projection is two JVM calls to build.
    """
    e = events.selectExpr("event_id", "ts", "user_id", "event_type AS et",
                          "try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k")
    cred = "CAST(k AS DOUBLE) / 100"
    band = (f"CASE WHEN {cred} >= 0.8D THEN 'High' WHEN {cred} >= 0.6D THEN 'Medium' "
            f"WHEN {cred} IS NOT NULL THEN 'Low' END")
    keys = f"CASE WHEN et <> 'click' THEN {_case('k % 4', PERSPECTIVES_BY_K4)} END"
    persp = (f"map_from_arrays({keys}, transform({keys}, key -> named_struct("
             f"'credibility', CASE WHEN et <> 'error' THEN {band} END, "
             f"'summary', concat(key, ':', CAST(k % 3 AS STRING)), "
             f"'key_points', CAST(array() AS ARRAY<STRING>))))")
    return e.selectExpr(
        "event_id AS id",
        "CASE WHEN k >= 97 THEN event_id ELSE user_id END AS article_id",
        "make_timestamp_ntz(year(ts), month(ts), dayofmonth(ts), hour(ts), 0, 0) AS created_at",
        f"CASE WHEN et <> 'error' THEN {cred} END AS credibility_score",
        "CASE WHEN et <> 'signup' THEN CAST((k * 7) % 100 AS DOUBLE) / 100 END AS sentiment_score",
        "CASE WHEN et <> 'view' THEN CAST((k * 13) % 100 AS DOUBLE) / 100 END AS bias_score",
        f"CASE WHEN et <> 'error' THEN array({_case('k % 5', TOPIC_BY_K5)}, {_case('k % 3', TOPIC_BY_K3)}) END AS topics",
        "CASE WHEN et <> 'purchase' THEN array(concat('arg', CAST(k % 6 AS STRING)), "
        "concat('arg', CAST(k % 4 AS STRING))) END AS key_arguments",
        f"CASE WHEN {keys} IS NOT NULL THEN {persp} END AS perspectives",
        "CAST(NULL AS STRING) AS summary",
        "k",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback submissions: conv_id, turn, name, email, type, message."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = F.concat(F.lit("user"), F.col("conv_id").cast("string"))
    return c.select(
        "conv_id", "turn",
        F.col("role").alias("name"),
        F.when(F.col("turn") % 3 == 2, F.concat(user, F.lit(" at example.com")))
         .otherwise(F.concat(user, F.lit("@example.com"))).alias("email"),
        _pick(F.col("conv_id") % 5, FEEDBACK_TYPES_BY_CONV5).alias("type"),
        F.col("text").alias("message"),
    )


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses kept for re-decoding: the assistant turns."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return (c.filter(F.col("role") == "assistant")
             .select("conv_id", "turn", F.col("text").alias("response_text")))


def analysis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analysis documents as JSON text: id, article_id, created_at, analysis_data.
    The shape is that of the model response, the featured seed or the flat document,
    by id mod 3."""
    h = history(spark, sf_dir)
    model = ("to_json(struct(struct(credibility_score AS score, 'stored' AS explanation) AS credibility, "
             "transform(topics, t -> struct(t AS name, 0.8D AS relevance)) AS topics, key_arguments AS key_points, "
             "array() AS potential_biases, struct(bias_score AS level) AS bias, "
             "array_join(slice(topics, 1, 3), ' OR ') AS similar_articles_query))")
    seed = ("to_json(struct(0.85D AS news_integrity, credibility_score AS index_of_credibility, sentiment_score, bias_score, "
            "topics, key_arguments, perspectives['western'] AS western_perspective, "
            "perspectives['neutral'] AS neutral_perspective, perspectives['eastern'] AS eastern_perspective))")
    flat = ("to_json(struct(credibility_score, sentiment_score, bias_score, topics, key_arguments, perspectives))")
    return h.selectExpr("id", "article_id", "created_at",
                        f"CASE id % 3 WHEN 0 THEN {model} WHEN 1 THEN {seed} ELSE {flat} END AS analysis_data")
