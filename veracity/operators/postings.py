"""Q4 by free text: similar articles whose text holds a term of an article's query.

An article's query is terms joined by `` OR ``; a term matches where it stands in title,
summary or content, in whatever case of ASCII letters (``%`` and ``_`` stand for themselves).
The answer of an article is the ``k`` newest others that match.

No pair of an article and a query is ever tried.  The distinct terms of all queries become
one Aho-Corasick automaton, and one pass over the texts finds all of them at once.  Of a
term only its k + 1 newest articles can be in an answer, so a task keeps just those (its
postings), and they are cut to k + 1 a term again after the shuffle.  Joining every query's
terms to their postings then gives at most (k + 1) rows a term of a query, and the k newest
of those are exact: what is among the newest of the union is among the newest of its term.

The automaton is broadcast in blocks of a measured size (``block_bytes`` of terms, one pass
over the texts for each block), so the terms may be any number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.text import ascii_lower
from veracity.session import ship_package

BLOCK_BYTES = 2 << 20    # of distinct terms in one automaton
POSTINGS = "term string, similar_id long, t long"
_OLDEST = -(1 << 63)


def query_terms(queries: DataFrame) -> DataFrame:
    """(id, query) -> (id, term): the distinct folded terms of each query; blank ones are none."""
    terms = F.transform(F.split("query", " OR "), lambda t: ascii_lower(F.trim(t)))
    return (queries.select("id", F.explode(F.array_distinct(terms)).alias("term")).where("term <> ''"))


def _block(articles: DataFrame, terms: list[str], k: int) -> DataFrame:
    """term, similar_id, t: for each task the newest k articles that hold each term."""
    import ahocorasick
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, term in enumerate(terms):
        automaton.add_word(term, i)
    automaton.make_automaton()
    shared = articles.sparkSession.sparkContext.broadcast((automaton, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = shared.value
        newest: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for id_, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = (_OLDEST if t is None else t, -id_)      # newer first, then the smaller id
                for term in {i for _, i in find.iter(text or "")}:
                    heap = newest.setdefault(term, [])
                    if len(heap) < k:
                        heapq.heappush(heap, place)
                    elif place > heap[0]:
                        heapq.heapreplace(heap, place)
        rows = [(names[i], -n, t) for i, heap in newest.items() for t, n in heap]
        for i in range(0, len(rows), 1 << 16):
            part = list(zip(*rows[i:i + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()),
                                              pa.array(part[2], pa.int64())], names=["term", "similar_id", "t"])

    return articles.mapInArrow(run, POSTINGS)


def postings(articles: DataFrame, terms: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """term, similar_id, t: the newest k articles that hold each of the distinct ``terms``."""
    ship_package(articles.sparkSession)
    text = F.concat_ws("\n", *[ascii_lower(c) for c in ("title", "short_summary", "content")])
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    rows = articles.where("id is not null").select(F.col("id").cast("long").alias("id"), micros.alias("t"), text.alias("text"))
    size = terms.agg(F.sum(F.octet_length("term")).alias("s")).first()["s"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = []
    for b in range(blocks):
        part = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        if names := part.toArrow().column("term").to_pylist():      # a block's terms, by measure
            found.append(_block(rows, names, k))
    if not found:
        return terms.sparkSession.createDataFrame([], POSTINGS)
    per_term = Window.partitionBy("term").orderBy(F.desc("t"), "similar_id")
    return (reduce(DataFrame.unionByName, found).withColumn("_r", F.row_number().over(per_term))
            .where(F.col("_r") <= k).drop("_r"))


def similar_by_text(articles: DataFrame, queries: DataFrame, k: int = 3, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, rank, similar_id, matched_terms: for every query (id, query) the ``k`` newest
    articles other than ``id`` that hold one of its terms, ties to the smaller id, with the
    number of terms among whose newest they are.  ``articles``: id, title, short_summary,
    content, created_at (NULL counts as oldest); ids unique.  A query without terms, or
    whose terms no article holds, has no rows."""
    asked = query_terms(queries)
    best = postings(articles, asked.select("term").distinct(), k + 1, block_bytes)
    pairs = (asked.join(best, "term").where("similar_id <> id")
             .groupBy("id", "similar_id").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("matched_terms")))
    place = Window.partitionBy("id").orderBy(F.desc("t"), "similar_id")
    return (pairs.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= k)
            .select("id", "rank", "similar_id", "matched_terms"))
