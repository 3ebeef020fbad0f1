"""The store on disk (S9-S11): bucketed tables, saved by copying only what changes.

    <base>/<table>/v=<n>/bucket=<k>/   the rows that version n wrote to a bucket
    <base>/commits/v=<n>/              which folders make up version n; written last

Articles are bucketed by url (those without one by id), history by article id.  A save
reads the buckets that its urls fall into and rewrites those with an updated article;
new articles and analyses are added beside what a bucket has, so a save costs the buckets
it updates plus its own rows, whatever the store holds.  Until the commit is written
readers see the version before; a save that died is repeated under the same number and
overwrites what it left.  One writer at a time; nothing is deleted.

The commit is a table of (table, bucket, version) rows, at most the buckets times the
saves since a bucket was last rewritten, and a row a table with its next free id and schema.  It is the only thing
that passes the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veracity.operators import stats as st
from veracity.operators import store
from veracity.session import ensure_checkpoint_dir

BUCKETS = 256
COMMIT = "table string, bucket int, version long, buckets int, next_id long, schema string"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def article_bucket(url: str, id_: str, buckets: int) -> Column:
    """A url's rows share a bucket; a row without one goes by its id."""
    return F.when(F.col(url) != "", bucket_of(F.col(url), buckets)).otherwise(bucket_of(F.col(id_), buckets))


@dataclass
class Version:
    """One whole version: its number, and per table the (bucket, version) folders."""

    spark: SparkSession
    base: str
    number: int
    buckets: int
    folders: dict[str, list[tuple[int, int]]]
    next_id: dict[str, int]
    schemas: dict[str, StructType]

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or the rows of some buckets: the other folders are not even listed."""
        schema = self.schemas[name]
        paths = [f"{self.base}/{name}/v={v}/bucket={b}" for b, v in self.folders[name] if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def history_of(self, ids: list[int]) -> DataFrame:
        """The analyses of a few articles, from their buckets alone."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "article_id long")
        at = {r["b"] for r in asked.select(bucket_of(F.col("article_id"), self.buckets).alias("b")).take(len(ids))}
        return self.table("history", at).join(asked.distinct(), "article_id", "left_semi")


def _write(df: DataFrame, base: str, name: str, version: int, bucket: Column) -> None:
    # a bucket's rows meet in few files, and a large bucket is split over several tasks
    (df.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{base}/{name}/v={version}"))


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """The last folder names of the paths that match; only names are listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().getName() if s.isDirectory() else s.getPath().getParent().getName() for s in found or []]


def _written(spark: SparkSession, base: str, name: str, version: int) -> list[int]:
    """The buckets that a version wrote."""
    return sorted(int(f.split("=")[1]) for f in _folders(spark, f"{base}/{name}/v={version}/bucket=*"))


def _commit(v: Version) -> Version:
    rows = [(t, None, None, v.buckets, v.next_id.get(t), schema.json()) for t, schema in v.schemas.items()]
    rows += [(t, b, n, v.buckets, None, None) for t, held in v.folders.items() for b, n in held]
    v.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{v.base}/commits/v={v.number}")
    return v


def versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the whole versions, oldest first."""
    return sorted(int(f.split("=")[1]) for f in _folders(spark, f"{base.rstrip('/')}/commits/v=*/_SUCCESS"))


def read_version(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The newest whole version, or the one with ``number``."""
    base, whole = base.rstrip("/"), versions(spark, base)
    if not whole or (number is not None and number not in whole):
        raise ValueError(f"no version {'' if number is None else number} under {base}")
    number = whole[-1] if number is None else number
    v = Version(spark, base, number, 0, {}, {}, {})
    rows = spark.read.schema(COMMIT).parquet(f"{base}/commits/v={number}")
    for r in rows.orderBy("bucket").take(rows.count()):
        held = v.folders.setdefault(r["table"], [])
        v.buckets = r["buckets"]
        if r["bucket"] is not None:
            held.append((r["bucket"], r["version"]))
            continue
        v.schemas[r["table"]] = StructType.fromJson(json.loads(r["schema"]))
        if r["next_id"] is not None:
            v.next_id[r["table"]] = r["next_id"]
    return v


def create_store(spark: SparkSession, base: str, articles: DataFrame, history: DataFrame, stats: DataFrame,
                 buckets: int = BUCKETS) -> Version:
    """Version 0 of a store: articles (with ``analysis_data``), history (id, article_id,
    created_at, analysis_data), source counters."""
    base = base.rstrip("/")
    v = Version(spark, base, 0, buckets, {}, {}, {})
    for name, df, bucket in (("articles", articles, article_bucket("url", "id", buckets)),
                             ("history", history, bucket_of(F.col("article_id"), buckets)),
                             ("source_stats", stats, F.lit(0))):
        _write(df, base, name, 0, bucket)
        v.schemas[name] = StructType([StructField(f.name, f.dataType) for f in df.schema])
        v.folders[name] = [(b, 0) for b in _written(spark, base, name, 0)]
        if name != "source_stats":
            v.next_id[name] = (df.agg(F.max("id")).first()[0] or 0) + 1
    return _commit(v)


def save_batch(spark: SparkSession, base: str, batch: DataFrame, now: str) -> Version:
    """Save every row of ``batch`` (as ``store.upsert_articles`` takes it, with
    ``analysis_data``) as the next version: articles, history and counters together.
    The batch is resolved once; its rows, never the store's, are written twice."""
    ensure_checkpoint_dir(spark)
    old = read_version(spark, base)
    n, buckets = old.number + 1, old.buckets
    if "short_summary" not in batch.columns:
        batch = batch.withColumn("short_summary", store.short_summary("content"))
    urls = batch.where(F.col("url") != "").select(bucket_of(F.col("url"), buckets).alias("b")).distinct()
    touched = {r["b"] for r in urls.take(buckets)}
    near = old.table("articles", touched)
    rows = store.resolve_batch(near, batch, old.next_id["articles"]).checkpoint()
    last = rows.where("is_last_for_url")

    # buckets with an updated article are written anew, with the batch's new articles of theirs
    by_url = bucket_of(F.col("url"), buckets)
    updated = {r["b"] for r in last.where("not created_in_batch").select(by_url.alias("b")).distinct().take(buckets)}
    after = store.apply_resolved(old.table("articles", updated), last, now)
    _write(after, old.base, "articles", n, article_bucket("url", "id", buckets))
    written = _written(spark, old.base, "articles", n)
    articles = [x for x in old.folders["articles"] if x[0] not in updated] + [(b, n) for b in written]

    new_rows = store.history_rows(old.table("history", set()), rows, now, ["analysis_data"], old.next_id["history"])
    _write(new_rows, old.base, "history", n, bucket_of(F.col("article_id"), buckets))
    history = old.folders["history"] + [(b, n) for b in _written(spark, old.base, "history", n)]

    counted = rows.withColumn("updated_at", F.to_timestamp_ntz(F.lit(now)))
    _write(st.update_source_stats(old.table("source_stats"), counted), old.base, "source_stats", n, F.lit(0))
    made, saved = rows.agg(F.count_if("is_new_article"), F.count(F.lit(1))).first()
    return _commit(Version(spark, old.base, n, buckets,
                           {"articles": articles, "history": history,
                            "source_stats": [(b, n) for b in _written(spark, old.base, "source_stats", n)]},
                           {"articles": old.next_id["articles"] + made, "history": old.next_id["history"] + saved}, old.schemas))
