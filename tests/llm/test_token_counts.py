"""Token counts against the libraries, and what is encoded, stored and reused."""

from __future__ import annotations

import uuid

import public_tokenizers
import pytest

from veracity.llm import token_counts as tc
from veracity.session import ensure_checkpoint_dir

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SPECIAL = ["<s> a </s> <unk>", "<|endoftext|> x", "a\x00b", "  two  blanks ", "日本語 🙂", "\n\n"]


@pytest.fixture
def cache(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-cache-{uuid.uuid4().hex}"


def plain(path, texts):
    if path == PIECES:
        import sentencepiece
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    import tokenizers
    t = tokenizers.Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def stored(spark, cache, path):
    with open(path, "rb") as f:
        version = tc.tokenizer_version(path, f.read())
    return spark.read.parquet(f"{cache}/{version}/*")


@pytest.mark.parametrize("path", [PIECES, WORDS, public_tokenizers.path("byte_bpe_50k.json")])
def test_equals_the_library(spark, edge_docs, cache, path):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(extra)
    rows = docs.collect()
    n = plain(path, [r["text"] or "" for r in rows])
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), k, k > 4096) for r, k in zip(rows, n)), key=str)
    for _ in range(2):      # counted, then found
        got = tc.token_counts(docs, cache, path)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    digests = [r["digest"] for r in stored(spark, cache, path).collect()]
    assert len(digests) == len(set(digests)) == len({r["text"] or "" for r in rows})


def test_only_distinct_misses_are_encoded(spark, cache):
    def docs(ids):
        return spark.createDataFrame([(i, f"text {i % 7}") for i in ids], "id long, body string").repartition(4)
    tc.token_counts(docs(range(50)), cache, PIECES, "id", "body").collect()
    assert stored(spark, cache, PIECES).count() == 7
    more = docs(range(20)).unionByName(spark.createDataFrame([(99, "new"), (99, "new"), (None, "new")], "id long, body string"))
    assert tc.token_counts(more, cache, PIECES, "id", "body").count() == 23
    assert stored(spark, cache, PIECES).count() == 8
    # another tokenizer shares nothing, and what is stored is what is answered
    assert tc.token_counts(docs(range(7)), cache, WORDS, "id", "body").count() == 7
    assert stored(spark, cache, WORDS).count() == 7 and stored(spark, cache, PIECES).count() == 8


def test_stored_counts_are_used(spark, cache):
    with open(PIECES, "rb") as f:
        version = tc.tokenizer_version(PIECES, f.read())
    planted = spark.sql(f"select '{version}' as tokenizer, unhex(sha2('known', 256)) as digest, 5000L as n_tokens")
    planted.write.parquet(f"{cache}/{version}/a")
    planted.write.parquet(f"{cache}/{version}/b")      # two runs may store the same text
    docs = spark.createDataFrame([(1, "known"), (2, "known"), (3, "other")], "doc_id int, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in tc.token_counts(docs, cache, PIECES).collect()}
    assert got == {1: (5000, True), 2: (5000, True), 3: (plain(PIECES, ["other"])[0], False)}


def test_versions_and_empty_tables(spark, empty_docs, cache):
    assert tc.tokenizer_version("x.model", b"a") != tc.tokenizer_version("x.model", b"b") != tc.tokenizer_version("x.json", b"b")
    with pytest.raises(ValueError):
        tc.tokenizer_version("x.bin", b"a")
    assert tc.token_counts(empty_docs, cache, PIECES).count() == 0
    odd = spark.createDataFrame([(1, "a b", 3)], "`x.y` int, `t.x` string, digest int")
    assert tc.token_counts(odd, cache, PIECES, "x.y", "t.x").columns == ["x.y", "n_bytes", "n_tokens", "over_limit"]
