"""Write paths of the article store as batch DataFrame jobs.

Every operator is a pure function from table versions (and a batch) to new
table versions; ``versions`` keeps a store on disk and saves batches into it.

Row-by-row upserts become set operations:
* the batch is reduced per url with ``max_by(row, seq)`` (last row wins,
  partial aggregation, so a url repeated a million times is one row after
  the map side);
* existing urls are resolved with one equi join;
* new ids are ``max(id) + dense_index`` over the inserting rows, numbered
  in batch order without a global window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import short_summary
from veracity.plans.ordered import dense_index
from veracity.session import ensure_checkpoint_dir
from veracity.sources.schemas import ANALYSIS

# The eight columns a partial update may change.
UPDATABLE = ["title", "source", "url", "content", "short_summary", "analysis_data",
             "credibility_level", "is_featured"]
LEVELS = ["High", "Medium", "Low"]
ARTICLE_COLUMNS = ["id", "title", "source", "url", "content", "short_summary",
                   "credibility_level", "created_at", "updated_at", "is_featured", "analysis_data"]


def _now(now: str | Column) -> Column:
    return F.to_timestamp_ntz(F.lit(now)) if isinstance(now, str) else now


# --------------------------------------------------------------- JSON

def encode_analysis(df: DataFrame, fields: list[str] | None = None, out: str = "analysis_data") -> DataFrame:
    """S3: the analysis columns as one JSON text column (NULL fields omitted)."""
    fields = fields or [f for f in ANALYSIS.fieldNames() if f in df.columns]
    return df.withColumn(out, F.to_json(F.struct(*fields))).drop(*fields)


def decode_analysis(df: DataFrame, col: str = "analysis_data") -> DataFrame:
    """JSON text -> the canonical analysis columns.  NULL, empty or
    malformed text gives an empty document (every field NULL)."""
    parsed = F.from_json(F.when(F.trim(F.col(col)) != "", F.col(col)), ANALYSIS, {"mode": "PERMISSIVE"})
    return df.withColumn("_doc", parsed).select(
        *[c for c in df.columns if c != col],
        *[F.col(f"_doc.{f}").alias(f) for f in ANALYSIS.fieldNames()])


# ---------------------------------------------------------- integrity

def validate_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined).  Rules: title, source, content NOT NULL;
    level one of High/Medium/Low or NULL (a NULL passes a CHECK); id
    unique.  Quarantined rows carry every failed rule in ``reasons``.

    Duplicate ids are found with a per-id count (an aggregation
    with map-side combine), not a window that would gather a hot id; only the ids
    that do repeat are joined back.
    """
    dup = articles.groupBy("id").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
    checked = articles.join(dup, "id", "left")
    rules = [
        (F.col("title").isNull(), "title is null"),
        (F.col("source").isNull(), "source is null"),
        (F.col("content").isNull(), "content is null"),
        (F.col("credibility_level").isNotNull() & ~F.col("credibility_level").isin(*LEVELS),
         "unknown credibility level"),
        (F.col("_copies") > 1, "duplicate id"),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]))
    checked = checked.withColumn("reasons", reasons).drop("_copies")
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    bad = checked.filter(F.size("reasons") > 0)
    return good, bad


def orphan_history(history: DataFrame, articles: DataFrame) -> DataFrame:
    """Analyses whose article does not exist (FK check)."""
    return history.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def cascade_delete(articles: DataFrame, history: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete the articles in ``ids.id`` and, by cascade, their history."""
    gone = ids.select("id").distinct()
    return (articles.join(gone, "id", "left_anti"),
            history.join(gone.select(F.col("id").alias("article_id")), "article_id", "left_anti"))


# ------------------------------------------------------------------ seeds

def seed_featured(articles: DataFrame, featured: DataFrame) -> DataFrame:
    """Add the featured article(s) whose title is not in the table yet,
    with ids after the current maximum."""
    new = featured.join(articles.select("title").filter(F.col("title").isNotNull()), "title", "left_anti")
    start = F.coalesce(articles.agg(F.max("id")).scalar(), F.lit(0)) + 1
    new = dense_index(new.withColumn("_seq", F.xxhash64("title")), ["_seq", "title"], "id", start) \
        .drop("_seq")
    return articles.unionByName(new.select(*[F.col(c) for c in articles.columns]), allowMissingColumns=False)


# ------------------------------------------------------------ upsert

def _url_key(c: str = "url") -> Column:
    return F.when(F.col(c) != "", F.col(c))


def resolve_batch(articles: DataFrame, batch: DataFrame, next_id: int | None = None) -> DataFrame:
    """Give every batch row the id it is saved under, as the sequential
    reference would: an existing url keeps its article (lowest id when the
    table repeats the url); a new url gets one new id at its first
    occurrence in the batch; a blank url always gets a new id.

    ``articles`` need only hold the rows whose url the batch has when ``next_id``, the
    first free id, is given.  ``batch`` needs a unique ordering column ``seq``.  Output: the batch
    with ``article_id``, ``is_new_article`` (the row that creates it),
    ``is_last_for_url`` (the row whose values survive) and
    ``created_in_batch`` (its article did not exist before the batch).
    """
    from pyspark.storagelevel import StorageLevel
    # the batch feeds four branches (per-url summary, creators, blank ids,
    # the rows themselves): compute it once
    b = batch.withColumn("_key", _url_key()).persist(StorageLevel.MEMORY_AND_DISK)
    asked = (b.filter(F.col("_key").isNotNull())
             .groupBy("_key").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last")))
    existing = (articles.select(F.col("url").alias("_key"), "id")
                .join(asked.select("_key"), "_key", "left_semi")
                .groupBy("_key").agg(F.min("id").alias("_existing")))
    per_url = asked.join(existing, "_key", "left")
    # rows that create an article: first row of a new url, every blank-url row
    creators = (per_url.filter(F.col("_existing").isNull()).select("_key", F.col("_first").alias("seq"))
                .unionByName(b.filter(F.col("_key").isNull()).select("_key", "seq")))
    start = F.coalesce(articles.agg(F.max("id")).scalar(), F.lit(0)) + 1 if next_id is None else next_id
    new_ids = dense_index(creators, ["seq"], "_new_id", start)
    url_ids = (per_url.join(new_ids.filter(F.col("_key").isNotNull()).select("_key", "_new_id"), "_key", "left")
               .select("_key", F.coalesce("_existing", "_new_id").alias("_url_id"), "_first", "_last",
                       F.col("_existing").isNull().alias("_url_new")))
    blank_ids = new_ids.filter(F.col("_key").isNull()).select("seq", "_new_id")
    out = (b.join(url_ids, "_key", "left").join(blank_ids, "seq", "left"))
    return out.select(
        *batch.columns,
        F.coalesce("_url_id", "_new_id").alias("article_id"),
        F.when(F.col("_key").isNull(), F.lit(True)).otherwise(
            F.col("_url_new") & (F.col("seq") == F.col("_first"))).alias("is_new_article"),
        F.when(F.col("_key").isNull(), F.lit(True)).otherwise(F.col("seq") == F.col("_last"))
        .alias("is_last_for_url"),
        F.when(F.col("_key").isNull(), F.lit(True)).otherwise(F.col("_url_new")).alias("created_in_batch"),
    )


def upsert_articles(articles: DataFrame, batch: DataFrame, now: str | Column) -> DataFrame:
    """The article table after saving every batch row in ``seq`` order.

    Batch columns: seq, title, source, url, content, credibility_level,
    is_featured (short_summary derived when absent).  Updates keep id, url
    and created_at and take the last batch row of that url; inserts get
    created_at = updated_at = ``now``.
    """
    if "short_summary" not in batch.columns:
        batch = batch.withColumn("short_summary", short_summary("content"))
    from pyspark.storagelevel import StorageLevel
    r = resolve_batch(articles, batch).filter("is_last_for_url").persist(StorageLevel.MEMORY_AND_DISK)
    return apply_resolved(articles, r, now)


def apply_resolved(articles: DataFrame, r: DataFrame, now: str | Column) -> DataFrame:
    """``articles`` with the surviving rows of a resolved batch (one for each article)."""
    ts = _now(now)
    fields = ["title", "source", "content", "short_summary", "credibility_level", "is_featured"]
    if "analysis_data" in r.columns:
        fields.append("analysis_data")
        if "analysis_data" not in articles.columns:
            articles = articles.withColumn("analysis_data", F.lit(None).cast("string"))
    upd = r.filter(~F.col("created_in_batch")).select(F.col("article_id").alias("id"),
                                                      *[F.col(c).alias(f"_n_{c}") for c in fields])
    # one join: an article keeps its fields or takes the batch row's
    hit = F.col("_hit").isNotNull()
    after = articles.join(upd.withColumn("_hit", F.lit(True)), "id", "left").select(
        "id", *[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields], "url", "created_at",
        F.when(hit, ts).otherwise(F.col("updated_at")).alias("updated_at"))
    # a url created by the batch may repeat later in it: the id comes from
    # its first row, the values from its last row
    inserted = (r.filter("created_in_batch")
                .select(F.col("article_id").alias("id"), "title", "source", F.col("url"), "content",
                        "short_summary", "credibility_level", ts.alias("created_at"),
                        ts.alias("updated_at"), "is_featured",
                        (F.col("analysis_data") if "analysis_data" in r.columns else F.lit(None).cast("string"))
                        .alias("analysis_data")))
    cols = [c for c in ARTICLE_COLUMNS if c in articles.columns]
    return after.select(*cols).unionByName(inserted.select(*cols))


def append_history(history: DataFrame, articles: DataFrame, batch: DataFrame, now: str | Column,
                   analysis_cols: list[str] | None = None) -> DataFrame:
    """One new analysis row per saved batch row (repeated urls too),
    ids after the current maximum, in batch order."""
    if analysis_cols is None:
        analysis_cols = [c for c in (*ANALYSIS.fieldNames(), "analysis_data") if c in batch.columns]
    return history_rows(history, resolve_batch(articles, batch), now, analysis_cols)


def history_rows(history: DataFrame, resolved: DataFrame, now: str | Column, analysis_cols: list[str],
                 next_id: int | None = None) -> DataFrame:
    """The analysis rows of a resolved batch; ``history`` need not be read when ``next_id``,
    its first free id, is given."""
    start = F.coalesce(history.agg(F.max("id")).scalar(), F.lit(0)) + 1 if next_id is None else next_id
    rows = dense_index(resolved, ["seq"], "id", start)
    return rows.select("id", "article_id", _now(now).alias("created_at"), *analysis_cols)


# -------------------------------------------------------- partial update

def update_articles(articles: DataFrame, patch: DataFrame, now: str | Column) -> DataFrame:
    """Apply partial updates by id.  Only the eight updatable columns,
    NULL means "leave alone", several patches of one id apply in ``seq``
    order, unknown ids and all-NULL patches change nothing; an applied
    patch sets updated_at = ``now``.  Adds ``was_updated``."""
    fields = [c for c in UPDATABLE if c in patch.columns and c in articles.columns]
    agg = patch.groupBy("id").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_p_{c}") for c in fields])
    any_set = reduce(lambda a, b: a | b, [F.col(f"_p_{c}").isNotNull() for c in fields])
    j = articles.join(agg, "id", "left")
    out = [F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
           for c in articles.columns if c != "updated_at"]
    applied = F.coalesce(any_set, F.lit(False))
    return j.select(*out, F.when(applied, _now(now)).otherwise(F.col("updated_at")).alias("updated_at"),
                    applied.alias("was_updated"))


def history_from_update(history: DataFrame, articles: DataFrame, patch: DataFrame, now: str | Column,
                        analysis_cols: list[str]) -> DataFrame:
    """One history row per patch row that carries an analysis and
    targets an existing article."""
    has = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in analysis_cols])
    p = patch.filter(has).join(articles.select("id"), "id", "left_semi")
    start = F.coalesce(history.agg(F.max("id")).scalar(), F.lit(0)) + 1
    rows = dense_index(p.withColumnRenamed("id", "article_id"), ["seq"], "id", start)
    return rows.select("id", "article_id", _now(now).alias("created_at"), *analysis_cols)


# --------------------------------------------------------------- versions

def write_version(df: DataFrame, base: str, version: int | str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as version ``version`` of a table under ``base``.

    The folder is written whole, so a retried job rewrites it.  ``versions`` holds the
    store that is saved in part and read by version.
    """
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# ------------------------------------------------------------ the save job

def save_articles(articles: DataFrame, history: DataFrame, stats: DataFrame, batch: DataFrame,
                  now: str | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The reference's ``save_article`` for a whole batch, as three new
    table versions: articles after the upsert, history with one new row per
    batch row, source counters with one count per batch row."""
    from veracity.operators import stats as st
    if "short_summary" not in batch.columns:
        batch = batch.withColumn("short_summary", short_summary("content"))
    ensure_checkpoint_dir(articles.sparkSession)
    resolved = resolve_batch(articles, batch).checkpoint()      # once, for articles and history
    new_articles = apply_resolved(articles, resolved.filter("is_last_for_url"), now)
    new_rows = history_rows(history, resolved, now, [c for c in history.columns
                                                     if c not in ("id", "article_id", "created_at") and c in batch.columns])
    new_history = history.unionByName(new_rows, allowMissingColumns=True)
    counted = batch.withColumn("updated_at", _now(now))
    return new_articles, new_history, st.update_source_stats(stats, counted)


def commit_save(base: str, version: int | str, articles: DataFrame, history: DataFrame,
                stats: DataFrame) -> dict[str, str]:
    """Write the three tables of one save as version ``version`` under
    ``base`` (``articles/``, ``history/``, ``source_stats/``).  Each table is
    written whole into its own version folder, so a retry of the same version
    rewrites it.  A version is whole when all three have their ``_SUCCESS`` marker;
    for a reader and saves that cost only what changes see ``versions``."""
    return {name: write_version(df, f"{base.rstrip('/')}/{name}", version)
            for name, df in (("articles", articles), ("history", history), ("source_stats", stats))}
