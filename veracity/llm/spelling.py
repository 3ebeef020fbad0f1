"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

A word of m code points is cut into two disjoint chunks, its halves.  One inserted,
deleted or replaced code point touches one of them only, so of two words that are one
edit apart the shorter (of equal ones, the smaller) has a chunk that the other holds
unchanged, at its place or shifted by one.  So every word sends its two chunks, and,
as the other word of a pair, its positional grams of the lengths that a partner's chunks
can have; grams at places that no chunk within shift one can reach are never sent.  An
equi join on (chunk length, which chunk, text) meets exactly the pairs that share a chunk
within shift one, and the edit distance verifies them inside the join.

The rest of a bucket is cut by the same rule once more: what follows (or precedes) a
shared chunk is again one edit apart and keeps one of its own halves, which is part of
the key.  So a common beginning or ending doesn't compare all words that have it.

Words are counted over the whole corpus: tasks add up the words of many documents before
anything is shuffled, and counts combine map-side, so a word of any frequency is one row
a task.  Words are numbered by (n descending, word), so "the near word of largest n" is
the smallest number, an aggregate of longs.  Forms are followed by pointer jumping.

Every join is merged, at any size: all sides grow with the vocabulary, and a side of
several keys a word is judged by the small file of words it is made of, so it would be
gathered and broadcast by the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import binary_values, materialise, session_of
from veracity.plans.ordered import dense_index

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2           # a form occurs at least so many times as often
TYPO_EVERY = 97
HELD_WORDS = 200_000   # words a task adds up before it sends them on
RUNS_AT_ONCE = 1 << 18   # code points of a text, and runs of a longer one, in one go



def altered(run: str, h: int) -> str:
    """The run without its code point h % length."""
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _text_words(key: str | None, text: bytes | None, runs: re.Pattern[str], min_length: int, every: int) -> Iterator[Counter[str]]:
    """Words of one text with their counts, a bounded number of runs at a time."""
    seed, crc32 = zlib.crc32(f"{key or ''}:".encode()), zlib.crc32
    folded = (text or b"").lower().decode("utf-8", "replace")     # bytes: only A-Z are lower-cased
    long = len(folded) > RUNS_AT_ONCE
    found = (m.group() for m in runs.finditer(folded)) if long else None
    while part := Counter(islice(found, RUNS_AT_ONCE) if long else runs.findall(folded)):
        hashed = [(run, h) for run in part if not (h := crc32(run.encode(), seed)) % every]
        for word, n in [(altered(run, h), part.pop(run)) for run, h in hashed]:
            if len(word) >= min_length:
                part[word] += n
        yield part
        if not long:
            return


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_length`` code points and
    ``min_count`` occurrences.  A null text has none, a null id counts as the empty string."""
    session_of(docs)

    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")     # whole runs, if they are long enough

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                for words in _text_words(key, text, runs, min_length, every):
                    held.update(words)
                    if len(held) >= HELD_WORDS:
                        yield sent()
        yield sent()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# The four keys of a partner length m, as (length of the beginning, length of the end)
# that must agree: a half (m div 2, or the rest) and one half of what is left.
_KEPT = {
    "half and a quarter after it": ("m div 2 + (m - m div 2) div 2", "0"),
    "first half, last quarter": ("m div 2", "m - m div 2 - (m - m div 2) div 2"),
    "first quarter, second half": ("m div 2 div 2", "m - m div 2"),
    "a quarter and the half after it": ("0", "m - m div 2 div 2"),
}


def _chunk_keys(words: DataFrame) -> DataFrame:
    """A row for each key of each word: its hash and its number, with the word."""
    keys = [f"named_struct('kind', {k}, 'key', xxhash64(m, {k}, left(word, {a}), right(word, {b})))"
            for k, (a, b) in enumerate(_KEPT.values())]
    return words.select("*", F.expr(f"inline(array({', '.join(keys)}))"))


def near_pairs(words: DataFrame) -> DataFrame:
    """words (id long, word) with unique words -> (a, b): every pair of words that differ
    by exactly one inserted, deleted or replaced code point, once."""
    size = F.char_length("word")
    chunks = _chunk_keys(words.select("id", "word", size.alias("m"))).select(
        "key", "kind", "m", F.col("id").alias("a"), F.col("word").alias("x"))
    grams = _chunk_keys(words.select("id", "word", F.explode(F.array(size, size - 1)).alias("m"))).select(
        "key", F.col("id").alias("b"), F.col("word").alias("y"))
    near = chunks.join(grams.hint("merge"), "key").where("(char_length(y) > m or x < y) and levenshtein(x, y, 1) = 1")
    # a pair that agrees in several keys counts at the first
    first = " ".join(f"when left(x, {a}) = left(y, {a}) and right(x, {b}) = right(y, {b}) then {k}"
                     for k, (a, b) in enumerate(_KEPT.values()))
    return near.where(f"kind = case {first} end").select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, form) -> (id, root): forms followed to the last, which has none.  Numbers fall
    along a chain, so there is no circle; each round doubles the step."""
    jumps = forms.select("id", F.col("form").alias("root"))
    while True:
        ahead = jumps.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = materialise(jumps.join(ahead.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"),
                                                                   F.col("next").isNotNull().alias("moved")), "roots")
        jumps = step.select("id", "root")
        if not step.where("moved").take(1):
            return jumps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = TYPO_EVERY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin letters (A-Z lower-cased) of at least ``min_length``
    code points that occur ``min_count`` times or more; an occurrence whose crc32 of
    ``<id>:<run>`` is divisible by ``every`` has lost a code point first.  ``form`` is the
    near word (one edit away) of largest n, the smallest on a tie, if it occurs at least
    ``ratio`` times as often; ``root`` is the last of the forms' chain, or the word itself.

    A null text has no words, a null id counts as the empty string; rows that repeat an id
    count each; an empty table, or one without words, gives no rows.  Extra columns of any
    name are ignored."""
    counted = materialise(word_counts(docs, id_col, text_col, min_length=min_length, min_count=min_count, every=every), "words")
    order = counted.withColumn("rank", -F.col("n"))
    words = materialise(dense_index(order, ["rank", "word"], "id").select("id", "word", "n"), "numbered-words")
    return grouped_words(words, ratio)


def grouped_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (id, word, n), numbered by (n descending, word) -> as ``spelling_variants``;
    ``words`` is read more than once: pass a table."""
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")),
                                         F.struct(F.col("b").alias("id"), F.col("a").alias("near")))))
    best = materialise(both.groupBy("id").agg(F.count("*").alias("n_near"), F.min("near").alias("best")), "near-words")
    named = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = words.join(best.hint("merge"), "id", "left").join(named.hint("merge"), "best", "left")
    big = F.col("form_n") >= ratio * F.col("n")
    facts = materialise(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                      *[F.when(big, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms")
    roots = _roots(facts.where("best is not null").select("id", F.col("best").alias("form")))
    named = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    ends = roots.join(named.hint("merge"), "root").select("id", "root_word")
    return (facts.join(ends.hint("merge"), "id", "left")
            .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))
