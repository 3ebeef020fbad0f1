"""The corpus pipeline: documents to sharded training text.

Language identification, near-duplicate removal, benchmark decontamination, mixing
to target weights, sharding.  Each stage works on all its predecessor kept, returns
the columns of ``documents`` (the last one adds ``v_slot`` and ``shard``), and is
written as Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracity.llm import decontaminate, language_id, mixing, near_dup, sharding
from veracity.llm._shared import id_bucket, materialise
from veracity.sources.tables import read_table

MIX_FRACTION = 0.5
SHARDS = 16


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, ``lang`` as predicted; the classifier learns
    from the documents whose crc32(doc_id) mod 4 is not 2."""
    return language_id.keep_known_languages(docs, training=id_bucket("doc_id", 4) != 2)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those that the benchmark contaminates."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), mode="documents")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to the target shares of sources, languages and topics."""
    return mixing.sample_mix(docs, fraction=MIX_FRACTION)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its virtual slot and shard."""
    return sharding.with_shard(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: the first two stages (a learned classifier, graph components) are not SQL;
#: tests/llm compares every stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with their shards."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
