"""Token counts through a digest cache.

A count depends on the text and the tokenizer alone, so it is stored under both their
digests: SHA-256 of the normalised content (a null text is the empty one; nothing else may
change, since tokenizers tell all other texts apart) and a digest of the tokenizer's file
with its library's name and version.  A run digests every text, joins the distinct digests
to the stored counts, encodes one text of each digest that misses, and appends those
counts.  A text that was ever counted is not encoded again, copies are encoded once, and
another tokenizer or library version misses by itself.

The cache is a folder of Parquet: each run appends a folder of its own, so runs do not
disturb each other, what a lost run leaves is either nothing or right rows, and the same
digest in two folders holds the same count.  Only digests are shuffled to be joined; texts
travel once, when so many miss that their digests can't be broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm._shared import materialise, session_of

LIMIT = 4096
BATCH_BYTES = 1 << 20    # text encoded in one call
STORED = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str, model: bytes) -> str:
    """Digest of the tokenizer's file, its library and that library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    elif path.endswith(".json"):
        import tokenizers as library
    else:
        raise ValueError(f"neither .model nor .json: {path}")
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + model).hexdigest()


def counter(path: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """Texts -> token counts, without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        pieces = SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
    from tokenizers import Tokenizer
    words = Tokenizer.from_str(model.decode())
    words.no_truncation()
    words.no_padding()
    return lambda texts: [len(x.ids) for x in words.encode_batch(texts, add_special_tokens=False)]


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a cache that is not there yet is empty."""
    try:
        found = spark.read.schema(STORED).parquet(f"{cache.rstrip('/')}/{version}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], STORED)
    return found.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(texts: DataFrame, path: str, model: bytes, version: str) -> DataFrame:
    """(digest, text) -> stored rows; a digest that comes again in a task is not encoded again."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = None, None
        for batch in batches:
            count = count or counter(path, shared.value)
            digests, column = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(digests):
                ids, group, size = [], [], 0
                while at < len(digests) and (not group or size < BATCH_BYTES):
                    if digests[at] != last:
                        last, text = digests[at], column[at].as_py()
                        ids.append(last)
                        group.append(text)
                        size += len(text)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(ids), pa.string()), pa.array(ids, pa.binary()), pa.array(count(group), pa.int64())],
                    names=["tokenizer", "digest", "n_tokens"])

    return texts.mapInArrow(run, STORED)


def token_counts(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *,
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache``: the folder of stored counts, created when missing and appended to.
    ``tokenizer``: the path of a .json or .model file on the driver; its bytes go to the tasks.
    A null text counts as empty.  Ids may be null or repeat: every row gets the count of
    its own text.  An empty table gives no rows and appends nothing.  Extra columns of any
    name are ignored."""
    spark = session_of(docs)
    with open(tokenizer, "rb") as f:
        model = f.read()
    version = tokenizer_version(tokenizer, model)
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digest: Column = F.unhex(F.sha2(text, 256)).alias("digest")
    pick: Column = F.xxhash64(id_).alias("pick")      # which of a digest's rows is encoded
    rows = materialise(docs.select(id_.alias("id"), digest, pick, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    needed = rows.groupBy("digest").agg(F.min("pick").alias("pick"))
    known = materialise(needed.join(stored_counts(spark, cache, version), "digest", "left"), "known-counts")
    misses = known.where("n_tokens is null").select("digest", "pick")
    counts = known.where("n_tokens is not null").select("digest", "n_tokens")
    if misses.take(1):
        texts = docs.select(digest, pick, text.alias("text")).join(misses, ["digest", "pick"], "left_semi").select("digest", "text")
        path = f"{cache.rstrip('/')}/{version}/{uuid.uuid4().hex}"
        # rows that repeat both id and text are one digest
        new = _encode(texts, tokenizer, model, version).groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
        new.write.parquet(path)
        counts = counts.unionByName(spark.read.schema(STORED).parquet(path).select("digest", "n_tokens"))
    return rows.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                                              (F.col("n_tokens") > limit).alias("over_limit"))
