"""Structured Streaming twins of the stateful operators.

Every stream reads a table folder of the store with the file source (new
files = new micro-batches), keeps its state in Spark's state store, and
writes through ``foreachBatch`` into a change log: each micro-batch's
updated rows go to ``<base>/changes/batch_id=<n>`` (overwritten on retry, so
a replayed batch is idempotent) and the current table is the newest row per
key (``read_changelog``: one ``max_by`` aggregation).  ``<base>`` lives under
the cluster's ``spark.checkpoint.dir`` unless given.

Each stream has a batch twin that defines its answer; after the stream has
consumed all files, ``read_changelog`` equals the twin, in whatever order the
files arrive; T2 as long as no row is older than its watermark allows.  Rows that
are older and that Spark therefore drops are counted (``dropped_rows``).
A table may be one file, several files beside each other, or a folder of part files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from veracity.operators import reuse, stats
from veracity.plans.ordered import with_previous
from veracity.session import ensure_checkpoint_dir
from veracity.sources.tables import read_table
from veracity.sources.views import article_level, history_from_events
from veracity.streaming import keyed


def stream_base(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint dir."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/veracity-streams/{name}-{uuid.uuid4().hex[:12]}"


def read_stream_table(spark: SparkSession, folder: str, name: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of table ``name`` in ``folder`` (schema from
    the current files; new files arriving there become new micro-batches).
    ``<name>*.parquet`` may be files or folders of part files."""
    path = f"{folder.rstrip('/')}/{name}*.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def changelog_writer(base: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/changes/batch_id={batch_id}")
    return write


class _Dropped(StreamingQueryListener):
    """Rows that the watermark dropped, by run and micro-batch: every progress report
    comes by here, while ``recentProgress`` holds only the last hundred."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = (str(p.runId), p.batchId)
        self.rows[at] = max(self.rows.get(at, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, run: str, wait_s: int = 60) -> int:
        """The count of a run that has ended; its last report may be still on its way."""
        until = time.monotonic() + wait_s
        while run not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no report of the end of stream run {run}")
            time.sleep(0.02)
        return sum(n for (r, _), n in self.rows.items() if r == run)


def run_available(sdf: DataFrame, base: str, mode: str = "update",
                  writer: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a streaming DataFrame over everything available, then stop, and keep the
    number of rows that the watermark dropped beside the change log."""
    spark, reports = sdf.sparkSession, _Dropped()
    spark.streams.addListener(reports)
    try:
        q = (sdf.writeStream.outputMode(mode)
             .foreachBatch(writer or changelog_writer(base))
             .option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True)
             .start())
        q.awaitTermination()
        dropped = reports.of(str(q.runId))
    finally:
        spark.streams.removeListener(reports)
    spark.range(1).selectExpr(f"{dropped}L as dropped").write.mode("append").parquet(f"{base}/dropped")


def dropped_rows(spark: SparkSession, base: str) -> int:
    """Rows that arrived behind the watermark and are not in the change log."""
    return spark.read.parquet(f"{base}/dropped").agg(F.sum("dropped")).first()[0] or 0


def read_changelog(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """The current table: the row of the newest batch per key."""
    ch = spark.read.parquet(f"{base}/changes")
    cols = [c for c in ch.columns if c not in (*keys, "batch_id")]
    return (ch.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_v"))
            .select(*keys, "_v.*"))


def compact_changelog(spark: SparkSession, base: str, keys: list[str]) -> None:
    """Merge the change log of a stopped stream into one folder of its newest rows
    (``batch_id`` of the newest batch merged) and drop the older folders.  The merged
    rows are written before anything is removed, so a failure leaves a log that reads
    the same."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/changes")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    batches = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))
    read_changelog(spark, base, keys).write.mode("overwrite").parquet(f"{base}/merged")
    # the newest batch takes the merged rows, then what they replace goes
    spark.read.parquet(f"{base}/merged").write.mode("overwrite").parquet(f"{base}/changes/batch_id={batches[-1]}")
    for n in batches[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, f"batch_id={n}"), True)


# ---------------------------------------------------------------- T1

def source_counts_stream(articles_stream: DataFrame) -> DataFrame:
    """Running per-source counters (update mode, one state row per source)."""
    return stats.batch_counts(articles_stream).drop("is_initial")


def source_stats_stream(spark: SparkSession, sf_dir: str, base: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """T1 end to end: stream the documents, label them against the static
    labels table, count per source, then add the seed counters."""
    base = base or stream_base(spark, "source_stats")
    docs = read_stream_table(spark, sf_dir, "documents", max_files_per_trigger).select("doc_id", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    arts = docs.join(labels, "doc_id", "left").select("source", article_level().alias("credibility_level"))
    run_available(source_counts_stream(arts), base)
    counts = read_changelog(spark, base, ["source"]).withColumn("is_initial", F.lit(False))
    return stats.merge_counts(stats.seed_rows(spark), counts)


def restated_stats_stream(spark: SparkSession, sf_dir: str, base: str | None = None,
                          max_files_per_trigger: int | None = 64) -> DataFrame:
    """T1 with S13 end to end: the documents come as inserts, the labels as patches (toxic:
    level Low), in files of any order; each change of an article takes back what it counted
    for before.  Equal to ``stats.restate_source_stats`` for levels High, Medium and Low."""
    base = base or stream_base(spark, "restated_stats")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    inserts = (read_stream_table(spark, sf_dir, "documents", max_files_per_trigger).select("doc_id", "source")
               .join(labels, "doc_id", "left")
               .select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("inserts"),
                       "source", article_level().alias("credibility_level")))
    patches = read_stream_table(spark, sf_dir, "labels", max_files_per_trigger).select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("long").alias("seq"), F.lit(False).alias("inserts"),
        F.lit(None).cast("string").alias("source"), F.when(F.col("toxic") == 1, F.lit("Low")).alias("credibility_level"))
    write = changelog_writer(base)
    with keyed.rocksdb_state(spark):
        run_available(keyed.change_stream(inserts.unionByName(patches)), base, "append",
                      lambda batch, n: write(keyed.counted_changes(batch), n))
    counts = spark.read.parquet(f"{base}/changes").drop("batch_id")
    counts = counts.withColumns({"is_initial": F.lit(False), "last_updated": F.lit(None).cast("timestamp_ntz")})
    return stats.merge_counts(stats.seed_rows(spark), counts)


# ---------------------------------------------------------------- T2

def quota_windows(events: DataFrame, per: str = "1 minute", n: int = 10) -> DataFrame:
    """T2 batch: requests per (client, fixed window) and how many the limit
    admits (epoch-aligned tumbling windows)."""
    w = events.groupBy("user_id", F.window("ts", per).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return w.select("user_id", F.col("w.start").alias("window_start"), "requests",
                    F.least(F.col("requests"), F.lit(n)).alias("admitted"),
                    F.greatest(F.col("requests") - n, F.lit(0)).alias("rejected"))


def quota_admissions(events: DataFrame, per: str = "1 minute", n: int = 10) -> DataFrame:
    """T2 batch, per request: its position within its client's window and
    whether the fixed-window limit admits it (the first ``n`` do).

    A flooding client's window may hold any share of the rows, so positions come
    from the skew-safe sequence, not from a window on one task.
    """
    e = events.select("event_id", "user_id", "ts", F.window("ts", per)["start"].alias("window_start"))
    seq = with_previous(e, ["user_id", "window_start"], "ts", "event_id", [])
    return seq.select("event_id", "user_id", "window_start", F.col("seq").cast("long").alias("position"),
                      (F.col("seq") <= n).alias("admitted"))


def quota_windows_stream(spark: SparkSession, sf_dir: str, per: str = "1 minute", n: int = 10,
                         watermark: str = "1 day", base: str | None = None,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """T2 stream: the same counts with a watermark (late events beyond it are
    dropped, windows older than it leave the state store)."""
    base = base or stream_base(spark, "quota_windows")
    ev = read_stream_table(spark, sf_dir, "events", max_files_per_trigger).select(
        "user_id", F.col("ts").cast("timestamp").alias("ets"))
    counts = (ev.withWatermark("ets", watermark)
              .groupBy("user_id", F.window("ets", per).alias("w"))
              .agg(F.count(F.lit(1)).alias("requests"))
              .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests"))
    run_available(counts, base)
    cur = read_changelog(spark, base, ["user_id", "window_start"])
    return cur.select("user_id", "window_start", "requests",
                      F.least(F.col("requests"), F.lit(n)).alias("admitted"),
                      F.greatest(F.col("requests") - n, F.lit(0)).alias("rejected"))


def quota_admissions_combined(events: DataFrame, limits: list[tuple[int, int]] | None = None,
                              client: str = "user_id") -> DataFrame:
    """T2 batch with several limits (seconds, requests) at once: event_id, client, admitted,
    refused_by (seconds of the smallest full window).

    A request is admitted if all its windows have room; a refused one uses up none of them,
    so positions alone don't decide.  Windows that divide each other compose: of a smallest
    window's requests the first ones are admitted, as many as every wider window has left, so
    the admitted numbers of the smallest windows are running sums cut off at each wider
    window's limit in turn.  These tables hold a row per client and smallest window; a wider
    window has a bounded number of them, however many requests a client makes.  Positions
    inside the smallest window come from the skew-safe sequence; once a request is refused,
    so are the others of its smallest window, and by the same limit."""
    limits = keyed.check_nested(limits or keyed.REQUEST_LIMITS)
    starts = [f"_start{i}" for i in range(len(limits))]
    t = keyed.micros("ts")
    rows = events.select("event_id", F.col(client).cast("string").alias("client"), "ts", *[
        (t - F.pmod(t, F.lit(w * 1_000_000))).alias(s) for s, (w, _) in zip(starts, limits)])
    bins = rows.groupBy("client", *starts).agg(F.least(F.count(F.lit(1)), F.lit(limits[0][1])).alias("_room0"))
    for i, (_, n) in enumerate(limits[1:], 1):
        before = Window.partitionBy("client", starts[i]).orderBy(starts[0]).rowsBetween(Window.unboundedPreceding, -1)
        left = F.lit(n) - F.coalesce(F.sum(f"_room{i - 1}").over(before), F.lit(0))
        bins = bins.withColumn(f"_room{i}", F.greatest(F.least(f"_room{i - 1}", left), F.lit(0)))
    room = f"_room{len(limits) - 1}"
    used = [F.coalesce(F.sum(room).over(Window.partitionBy("client", s).orderBy(starts[0])
                                        .rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for s in starts]
    full = F.coalesce(*[F.when(u >= n, F.lit(w)) for u, (w, n) in zip(used, limits)]).cast("long")
    bins = bins.select("client", starts[0], F.col(room).alias("_room"), full.alias("_full"))
    placed = with_previous(rows.select("event_id", "client", "ts", starts[0]), ["client", starts[0]], "ts", "event_id", [])
    return placed.join(bins, ["client", starts[0]]).select(
        "event_id", "client", (F.col("seq") <= F.col("_room")).alias("admitted"),
        F.when(F.col("seq") > F.col("_room"), F.col("_full")).alias("refused_by"))


def quota_admissions_stream(spark: SparkSession, sf_dir: str, limits: list[tuple[int, int]] | None = None,
                            client: str = "user_id", watermark: str = "1 day", base: str | None = None,
                            max_files_per_trigger: int | None = 64) -> DataFrame:
    """T2 stream, per request: decided on arrival by one row of counters a client
    (``keyed.LimitMachine``).  Equal to the batch twin for files in order; requests that come
    after their windows have closed are put out as late (``late``, neither admitted nor
    refused) and count in no window."""
    base = base or stream_base(spark, "quota_admissions")
    ev = read_stream_table(spark, sf_dir, "events", max_files_per_trigger).select(
        "event_id", F.col(client).alias("client"), "ts")
    with keyed.rocksdb_state(spark):
        run_available(keyed.limit_stream(ev, limits or keyed.REQUEST_LIMITS, watermark), base, "append")
    return spark.read.parquet(f"{base}/changes").drop("batch_id")


# ---------------------------------------------------------------- T3

def submissions_from_events(events: DataFrame) -> DataFrame:
    """Scoring requests derived from the events: the event type plays the
    source and the properties text the content; key = sha2(source || content)."""
    return events.select("event_id", "ts", F.sha2(F.concat_ws("\u0001", "event_type", "props"), 256).alias("key"))


reusable_results = reuse.reusable_results


def settled_reuse(spark: SparkSession, base: str, ttl_seconds: int = 3600) -> DataFrame:
    """The answers that the stream under ``base`` has given so far; keys with a late row are
    answered anew from all their logged rows by the batch plan."""
    log = spark.read.parquet(f"{base}/changes").drop("batch_id")
    cols = ["event_id", "key", "ts", "hit", "cached_at"]
    late = log.where("late").select("key").distinct()
    if not late.take(1):
        return log.select(*cols)
    late = late.checkpoint()
    again = reuse.reusable_results(log.join(late, "key", "left_semi").select("event_id", "key", "ts"), ttl_seconds)
    return log.join(late, "key", "left_anti").select(*cols).unionByName(again.select(*cols))


def reusable_results_stream(spark: SparkSession, sf_dir: str, ttl_seconds: int = 3600, base: str | None = None,
                            max_files_per_trigger: int | None = 64, watermark: str = "1 day") -> DataFrame:
    """T3 stream: one anchor a key as state (``keyed.ReuseMachine``).  A trigger reads its
    files and the state of their keys, nothing that came before.  Rows that come out of
    order within their key go to the log as late and ``settled_reuse`` answers their keys by
    the batch plan, so any number and order of files gives the batch twin's answers."""
    base = base or stream_base(spark, "reusable_results")
    ensure_checkpoint_dir(spark)
    ev = read_stream_table(spark, sf_dir, "events", max_files_per_trigger)
    with keyed.rocksdb_state(spark):
        run_available(keyed.reuse_stream(submissions_from_events(ev), ttl_seconds, watermark), base, "append")
    return settled_reuse(spark, base, ttl_seconds)


# ---------------------------------------------------------------- T4

def latest_per_article(history: DataFrame) -> DataFrame:
    """T4 aggregation: newest analysis per article, ties to the highest id
    (usable on a batch or a streaming history)."""
    cols = [c for c in history.columns if c != "article_id"]
    return (history.groupBy("article_id")
            .agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("_l"))
            .select("article_id", "_l.*"))


def latest_analysis_stream(spark: SparkSession, sf_dir: str, base: str | None = None,
                           max_files_per_trigger: int | None = None) -> DataFrame:
    """T4: J1 kept as running state (update mode, one state row per article)."""
    base = base or stream_base(spark, "latest_analysis")
    h = history_from_events(read_stream_table(spark, sf_dir, "events", max_files_per_trigger))
    h = h.select("id", "article_id", "created_at", "credibility_score", "sentiment_score", "bias_score")
    run_available(latest_per_article(h), base)
    return read_changelog(spark, base, ["article_id"])


# ---------------------------------------------------------------- T5

# Whitespace of JavaScript's trim() and \s, as explicit code points.
JS_SPACE = "[\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
FEEDBACK_TYPES = ["bug", "suggestion", "question", "other"]
# The form's messages.
MISSING_FIELDS = "Please fill in all required fields."
BAD_EMAIL = "Please enter a valid email address."
BAD_TYPE = "Please choose a feedback type."


def feedback_check(df: DataFrame) -> DataFrame:
    """T5: trimmed fields, the first failing check as ``reason`` (required
    fields, then e-mail shape, then type), ``valid`` when none fails."""
    def trim(c):
        return F.regexp_replace(F.col(c), f"^{JS_SPACE}+|{JS_SPACE}+$", "")
    t = df.select("*", *[trim(c).alias(f"_{c}") for c in ("name", "email", "message")])
    missing = (F.coalesce(F.col("_name"), F.lit("")) == "") | (F.coalesce(F.col("_email"), F.lit("")) == "") \
        | (F.coalesce(F.col("type"), F.lit("")) == "") | (F.coalesce(F.col("_message"), F.lit("")) == "")
    nsp = f"[^@\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
    email_ok = F.col("_email").rlike(f"^{nsp}+@{nsp}+\\.{nsp}+$")
    reason = (F.when(missing, F.lit(MISSING_FIELDS))
              .when(~email_ok, F.lit(BAD_EMAIL))
              .when(~F.col("type").isin(*FEEDBACK_TYPES), F.lit(BAD_TYPE)))
    return t.select(*df.columns, reason.alias("reason"), reason.isNull().alias("valid"))
