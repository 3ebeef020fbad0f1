"""Helpers shared by the operators: splits, materialised tables, hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.session import ensure_checkpoint_dir, ship_package

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def session_of(df: DataFrame) -> SparkSession:
    """The DataFrame's session, with this package shipped to its workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def id_bucket(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, keeps column
    pruning, and every later branch reads the same rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def binary_values(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def as_int64(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str,
                   label_col: str) -> DataFrame:
    """(text, y) of the documents with a label; a document with contradicting labels
    counts as 1, a null label or id is no label."""
    y = (labels.select(F.col(label_id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
         .where("__id is not null and y is not null").groupBy("__id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    # merged at every size: labels grow with the documents
    return rows.join(y.hint("merge"), "__id").select("text", "y")
