"""The queries of this subpackage, op<N>_<name>(spark, sf_dir) -> DataFrame, each
over its whole tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from veracity.llm import decontaminate, importance, language_id, line_dedup, lm_score, mixing, near_dup, oracle, quality_cnn, quality_rules, sharding, spelling, token_counts, toxicity
from veracity.llm._shared import id_bucket, labelled_texts
from veracity.session import ensure_checkpoint_dir
from veracity.sources.tables import read_table

QUERIES = {}
ORACLE = oracle.ORACLE


QUALITY_AT, TOXIC_AT = 0.3, 0.5


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fuzzy_lines(spark, d):
    found = line_dedup.line_report(read_table(spark, d, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.array_join(
        F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"))


@query
def op2_string_kernel(spark, d):
    docs = read_table(spark, d, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = language_id.learn(docs.where(~held_out), "text", "lang")
    return language_id.classify(docs, model, "doc_id", "text", held_out.alias("held_out"))


@query
def op3_superminhash(spark, d):
    return near_dup.near_duplicates(read_table(spark, d, "documents"), words=3, percent=85)


@query
def op4_byte_cnn(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    held_out = id_bucket("doc_id", 5) == 0
    net = quality_cnn.learn(labelled_texts(docs.where(~held_out), labels, "doc_id", "text", "doc_id", "quality"))
    return (quality_cnn.score(docs, net, "doc_id", "text", held_out.alias("held_out"))
            .withColumn("predicted", (F.col("score") >= QUALITY_AT).cast("int")))


@query
def op5_decontamination(spark, d):
    found = decontaminate.contamination(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op8_virtual_slots(spark, d):
    rows, _ = sharding.shard_documents(read_table(spark, d, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "v_slot", "map_version")


@query
def op9_raking(spark, d):
    return mixing.mix(read_table(spark, d, "documents"))


@query
def op7_risk_controlled_rules(spark, d):
    return quality_rules.quality_rules(read_table(spark, d, "documents"), read_table(spark, d, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed_rules"))


@query
def op6_nb_ngrams(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    held_out = id_bucket("doc_id", 5) == 0
    model = toxicity.learn(labelled_texts(docs.where(~held_out), labels, "doc_id", "text", "doc_id", "toxic"))
    return (toxicity.score(docs, model, "doc_id", "text", held_out.alias("held_out"))
            .withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int")))


@query
def op10_deleted_interpolation(spark, d):
    held_out = id_bucket("doc_id", 7) == 2
    scored = lm_score.lm_scores(read_table(spark, d, "documents"), training=~held_out)
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_spelling_chunks(spark, d):
    return spelling.spelling_variants(read_table(spark, d, "documents"))


@query
def op12_importance_resampling(spark, d):
    return importance.importance_scores(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


#: names the folder of stored token counts; unset, a run starts with an empty cache
TOKEN_CACHE = "spark.veracity.token.cache"


@query
def op13_digest_cache(spark, d):
    cache = spark.conf.get(TOKEN_CACHE, None) or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-token-cache-{uuid.uuid4().hex}"
    return token_counts.token_counts(read_table(spark, d, "documents"), cache, public_tokenizers.path("piece_bpe_32k.model"))
