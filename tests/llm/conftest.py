from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, score string, id string,"
          " row string, node string, shard string, v_slot string, rate string, component string, h string, y string")
WORDS_EN = "the quick brown fox jumps over a lazy dog while many small birds sing in old trees near this quiet river".split()
WORDS_DE = "der schnelle braune fuchs springt über den faulen hund während viele kleine vögel in alten bäumen singen".split()
EXTRA = ("x",) * 10


def prose(words, n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeats."""
    long = prose(WORDS_EN, 60_000)
    rows = [
        (1, prose(WORDS_EN, 60), "en", "a", 1), (2, prose(WORDS_EN, 60), "en", "a", 1),
        (2, prose(WORDS_EN, 60), "en", "a", 1), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, " \n\t ", "de", "b", 3), (None, prose(WORDS_DE, 50), "de", "b", 5), (None, None, None, None, None),
        (6, long, "en", "a", len(long)), (7, prose(WORDS_DE, 80, 1), "de", "b", 9), (8, "one", "en", "c", 3),
        (9, prose(WORDS_DE, 70, 2), "de", "b", 9), (10, prose(WORDS_EN, 90, 3), "en", "c", 9),
        (10, prose(WORDS_EN, 90, 4), "en", "c", 9), (11, "12345 !!! ###", "en", "c", 9),
        (12, "a\nb\na\nb\n\n", "en", "c", 9), (13, "x " * 3000, "de", "a", 9),
    ]
    return [r + EXTRA + (None,) for r in rows]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (7, 1, 0), (99, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
