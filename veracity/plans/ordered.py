"""Ordered per-group sequences without sending a whole group to one task.

A plain ``Window.partitionBy(group).orderBy(ts)`` puts every row of a group in
one task; with one article holding a third of all analyses that task is the
job.  ``with_previous`` instead range-partitions the rows on
(group, ts, tiebreak): the partitioner samples that key, so a hot group is cut
into several balanced partitions, each a contiguous piece of the group's
order.  Then:

1. rows:    ``lag`` / ``row_number`` over (group, piece)
2. pieces:  one aggregation per (group, piece): row count and the last row's
            (or last known) values
3. offsets: a window over a group's pieces (at most one row per partition,
            so bounded by the partition count, not by the group's rows) gives
            the previous piece's values and the running row offset
4. join the offsets back on (group, piece): rows and pieces are already
            distributed by that, so no shuffle is added.

Result: every row gets ``seq`` (1-based position in its group),
``group_size`` and ``prev_<c>`` for each requested column; ``has_prev`` marks
rows with a predecessor (a predecessor's value may itself be NULL).  The
order (ts, tiebreak) must be unique within a group.

The number of partitions is left to the session (``spark.sql.shuffle.partitions``
and adaptive coalescing).  Rows and pieces must see one and the same cut, and
two evaluations of a sampled range partitioning need not agree, so the cut is
materialised with ``checkpoint()``: pass only the columns that are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.session import ensure_checkpoint_dir


def _cut(df: DataFrame, order: list[str], name: str, partitions: int | None) -> DataFrame:
    """``df`` range-partitioned on ``order``, with the partition's number, materialised."""
    ensure_checkpoint_dir(df.sparkSession)
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return ranged.withColumn(name, F.spark_partition_id()).checkpoint()


def with_previous(df: DataFrame, keys: list[str], ts: str, tiebreak: str, cols: list[str],
                  partitions: int | None = None, known: bool = False) -> DataFrame:
    """``seq``, ``group_size``, ``has_prev`` and ``prev_<c>``; with ``known`` the previous
    value that is not NULL instead of the previous row's value."""
    ranged = _cut(df, [*keys, ts, tiebreak], "_piece", partitions)
    part, place = [*keys, "_piece"], F.struct(ts, tiebreak)
    w_row = Window.partitionBy(*part).orderBy(ts, tiebreak)
    w_before = w_row.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select(
        "*", F.row_number().over(w_row).alias("_rn"),
        *[(F.last(c, ignorenulls=True).over(w_before) if known else F.lag(c).over(w_row)).alias(f"_lag_{c}") for c in cols])
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place) if known else place).alias(f"_last_{c}") for c in cols]
    pieces = ranged.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *last)
    w_piece = Window.partitionBy(*keys).orderBy("_piece")
    w_pieces = w_piece.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *part, F.coalesce(F.sum("_n").over(w_pieces), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_size"),
        *[(F.last(f"_last_{c}", ignorenulls=True).over(w_pieces) if known else F.lag(f"_last_{c}").over(w_piece))
          .alias(f"_plast_{c}") for c in cols])
    outside = {c: F.col(f"_lag_{c}").isNull() if known else F.col("_rn") == 1 for c in cols}
    return (rows.join(offsets, part)
            .withColumns({f"prev_{c}": F.when(outside[c], F.col(f"_plast_{c}")).otherwise(F.col(f"_lag_{c}")) for c in cols})
            .withColumn("seq", F.col("_off") + F.col("_rn"))
            .withColumn("has_prev", F.col("seq") > 1)
            .drop("_piece", "_rn", "_off", *[f"_lag_{c}" for c in cols], *[f"_plast_{c}" for c in cols]))


def first_last(order_ts: str, order_id: str, value: Column | str, name: str) -> list[Column]:
    """Aggregates: first and last non-NULL ``value`` in (ts, id) order and
    the count of non-NULL values — partial aggregation, skew-safe."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.when(v.isNotNull(), F.struct(F.col(order_ts), F.col(order_id)))
    return [
        F.min_by(v, o).alias(f"{name}_first"),
        F.max_by(v, o).alias(f"{name}_last"),
        F.count(v).alias(f"{name}_n"),
    ]


def dense_index(df: DataFrame, order: list[str], name: str = "idx", start: Column | int = 1,
                partitions: int | None = None) -> DataFrame:
    """Number the rows 1..n (plus ``start`` - 1) in ``order`` without a
    global window on one task (zipWithIndex, in DataFrame form).

    The rows are range-partitioned on ``order`` (which must be unique) and
    numbered inside their partition; per-partition counts — one row per
    partition — give the running offsets.
    """
    ranged = _cut(df, order, "_pid", partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    first = start if isinstance(start, Column) else F.lit(start)
    place = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return (ranged.withColumn("_rn", place).join(offsets, "_pid")
            .withColumn(name, (first + F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_pid", "_rn", "_off"))
