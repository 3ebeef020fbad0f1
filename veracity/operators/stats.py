"""Source counters and corpus aggregates.

``source_stats`` is a small table (one row per source) maintained by an
additive merge: per-batch counts are computed with one partial aggregation
(map-side combine, so a source holding a third of all articles costs no more
than any other) and summed into the previous table version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.functions.text import round_dec
from veracity.sources.schemas import SOURCE_STATS

# Initial counters (source, high, medium, low).
SEED_SOURCES = [
    ("BBC News", 5, 1, 0),
    ("Reuters", 5, 1, 0),
    ("The New York Times", 4, 2, 0),
    ("The Guardian", 4, 2, 0),
    ("CNN", 3, 3, 0),
    ("Fox News", 2, 3, 1),
    ("Al Jazeera", 3, 2, 1),
    ("RT", 1, 2, 3),
    ("Breitbart", 1, 1, 4),
    ("Daily Mail", 2, 2, 2),
]

def empty_source_stats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SOURCE_STATS)


def seed_rows(spark: SparkSession) -> DataFrame:
    rows = [(s, h, m, lo, h + m + lo, True, None) for s, h, m, lo in SEED_SOURCES]
    return spark.createDataFrame(rows, SOURCE_STATS)


def seed_source_stats(stats: DataFrame) -> DataFrame:
    """The seed counters when ``stats`` is empty, else ``stats`` itself.

    One plan for both: the seed rows stand behind a scalar subquery that counts at
    most one row of the table.
    """
    held = stats.limit(1).agg(F.count(F.lit(1))).scalar()
    seeds = seed_rows(stats.sparkSession).withColumn("_held", held).filter("_held = 0").drop("_held")
    return stats.select(*SOURCE_STATS.fieldNames()).unionByName(seeds)


def batch_counts(batch: DataFrame) -> DataFrame:
    """Per-source counter increments of a batch of saved articles.

    Anything that is not High or Medium (also NULL) counts as low.
    """
    lv = F.col("credibility_level")
    ts = F.col("updated_at") if "updated_at" in batch.columns else F.lit(None).cast("timestamp_ntz")
    return batch.groupBy("source").agg(
        F.count_if(lv == "High").alias("high"),
        F.count_if(lv == "Medium").alias("medium"),
        F.count_if(~F.coalesce(lv.isin("High", "Medium"), F.lit(False))).alias("low"),
        F.count(F.lit(1)).alias("total_analyzed"),
        F.lit(False).alias("is_initial"),
        F.max(ts).alias("last_updated"),
    )


def merge_counts(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Additive merge of counter rows keyed by source."""
    both = stats.select(*SOURCE_STATS.fieldNames()).unionByName(
        deltas.select(*SOURCE_STATS.fieldNames()))
    return both.groupBy("source").agg(
        F.sum("high").alias("high"),
        F.sum("medium").alias("medium"),
        F.sum("low").alias("low"),
        F.sum("total_analyzed").alias("total_analyzed"),
        F.bool_and("is_initial").alias("is_initial"),
        F.max("last_updated").alias("last_updated"),
    )


def update_source_stats(stats: DataFrame, batch: DataFrame) -> DataFrame:
    """Add one to the level counter and to the total per saved article."""
    return merge_counts(stats, batch_counts(batch))


def restate_source_stats(stats: DataFrame, before: DataFrame, after: DataFrame,
                         compat: bool = False) -> DataFrame:
    """Move counters when an article's source or level changed.

    ``before``/``after`` hold ``id, source, credibility_level`` of the
    articles before and after an update.  The new (source, level) is counted
    like a save (High, Medium, anything else low; total +1; clears
    is_initial).  The old one is taken back from an existing counter row
    only: high/medium/low by exact level, total -1, is_initial untouched.
    Intended semantics take back on any change; ``compat=True`` keeps the
    observed rule (only a source change takes back).
    """
    b = before.select("id", F.col("source").alias("old_source"),
                      F.col("credibility_level").alias("old_level"))
    a = after.select("id", F.col("source").alias("new_source"),
                     F.col("credibility_level").alias("new_level"))
    moved = ~F.col("old_source").eqNullSafe(F.col("new_source"))
    ch = b.join(a, "id").filter(moved | ~F.col("old_level").eqNullSafe(F.col("new_level")))
    lv = F.col("credibility_level")
    minus = (ch.filter(moved if compat else F.lit(True))
             .select(F.col("old_source").alias("source"), F.col("old_level").alias("credibility_level"))
             .join(stats.select("source"), "source", "left_semi")
             .groupBy("source").agg(
                 (-F.count_if(lv == "High")).alias("high"),
                 (-F.count_if(lv == "Medium")).alias("medium"),
                 (-F.count_if(lv == "Low")).alias("low"),
                 (-F.count(F.lit(1))).alias("total_analyzed"),
                 F.lit(True).alias("is_initial"),
                 F.lit(None).cast("timestamp_ntz").alias("last_updated")))
    plus = batch_counts(ch.select(F.col("new_source").alias("source"),
                                  F.col("new_level").alias("credibility_level")))
    return merge_counts(merge_counts(stats, minus), plus)


def source_stats_from(articles: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Counters after saving every article of ``articles`` into ``stats``
    (seeded when empty or not given)."""
    base = seed_rows(articles.sparkSession) if stats is None else seed_source_stats(stats)
    return update_source_stats(base, articles)


def _score() -> F.Column:
    total = F.col("total_analyzed")
    raw = (F.col("high") * 1.0 + F.col("medium") * 0.5) / F.nullif(total, F.lit(0))
    return round_dec(raw, 2)


def source_credibility_chart(stats: DataFrame) -> DataFrame:
    """A1: score per source with at least one analysed article, best first."""
    return (stats.filter(F.col("total_analyzed") > 0)
            .select("source", "high", "medium", "low", "total_analyzed",
                    _score().alias("credibility_score"))
            .orderBy(F.desc("credibility_score"), "source"))


def source_statistics(stats: DataFrame) -> DataFrame:
    """A2: A1 plus every counter and the last update time."""
    return (stats.filter(F.col("total_analyzed") > 0)
            .select("source", "high", "medium", "low",
                    F.col("total_analyzed").alias("total"),
                    _score().alias("score"), "last_updated", "is_initial")
            .orderBy(F.desc("score"), "source"))


def total_sources(stats: DataFrame) -> DataFrame:
    """Number of sources with at least one analysed article (one row)."""
    return stats.filter(F.col("total_analyzed") > 0).agg(F.count(F.lit(1)).alias("total_sources"))


def credibility_distribution(articles: DataFrame) -> DataFrame:
    """A4: articles per level (NULL is a group) and their percentage.

    The grand total is the sum of the groups' counts: a window over the few
    rows that the levels leave, so the articles are read once.
    """
    per = articles.groupBy("credibility_level").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    pct = F.round((F.col("count") / total * 100).cast("decimal(18,6)"), 1).cast("double")
    return per.select("credibility_level", "count", pct.alias("percentage"))


def corpus_totals(articles: DataFrame, approximate: bool = False) -> DataFrame:
    """A5: number of articles and of distinct sources (one row)."""
    distinct = (F.approx_count_distinct("source") if approximate
                else F.count_distinct("source"))
    return articles.agg(F.count(F.lit(1)).alias("total_articles"), distinct.alias("total_sources"))
