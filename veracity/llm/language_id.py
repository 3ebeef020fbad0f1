"""Language identification with a blended-spectrum string kernel.

A text's spectrum is the set of its byte n-grams of lengths 1 to 3 (letters
lower-cased, other ASCII as blanks); the kernel of two texts is the number of
n-grams both have, over the geometric mean of their numbers.  A bounded sample of
texts of every language is drawn by hash; some of them are the Nystroem landmarks.
In the landmark feature space one ridge regression per language is fitted against
the rest (+1 / -1).  Scoring is two matrix products a batch: presence x landmark
presence gives the kernel rows, kernel rows x coefficients the languages' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm._shared import session_of

UND = "und"
PER_LANGUAGE = 400       # texts of a language in the fit, at most
SAMPLE_MAX = 20_000      # texts in the fit, at most
LANDMARKS = 40           # landmarks of a language, at most
LANGUAGES_MAX = 500
RIDGE = 1e-2
MIN_KNOWN = 0.1          # least share of a text's n-grams that any landmark has, for a document to be kept
TRIGRAM_BITS = 17
SPACE = 256 + (1 << 16) + (1 << TRIGRAM_BITS)
BATCH_DOCS, BATCH_BYTES = 64, 1 << 20
_BLANK = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")      # as in learn(): no number signs, no marks


def prepared(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode().translate(_BLANK), np.uint8)


def spectrum_ids(b: np.ndarray) -> list[np.ndarray]:
    """n-gram numbers in [0, SPACE) at every place, for each length."""
    wide = b.astype(np.uint32)
    two = (wide[:-1] << 8) | wide[1:]
    three = (two[:-1] << 8) | wide[2:]
    hashed = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS)
    return [wide, two + 256, hashed + np.uint32(256 + (1 << 16))]


def presence(texts: list[str], buffer: np.ndarray) -> np.ndarray:
    """Mark the n-grams of each text in a row of ``buffer`` (texts x SPACE, zeroed here)."""
    rows = buffer[:len(texts)]
    rows[:] = False
    for row, t in zip(rows, texts, strict=True):
        for ids in spectrum_ids(prepared(t)):
            row[ids] = True
    return rows


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and stop - start < BATCH_DOCS and (stop == start or size < BATCH_BYTES):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


@dataclass
class Model:
    """``features``: the n-grams any landmark has; ``landmarks``: their presence,
    scaled by the root of the landmark's number of n-grams; ``coef``: per language."""

    languages: list[str]
    features: np.ndarray
    landmarks: np.ndarray
    coef: np.ndarray

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each language, share of the n-grams that a landmark has) of each text."""
        own = np.maximum(np.count_nonzero(rows, axis=1), 1)
        known = rows[:, self.features].astype(np.float32)
        kernel = (known @ self.landmarks) / np.sqrt(own).astype(np.float32)[:, None]
        return kernel @ self.coef, known.sum(axis=1) / own


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on (language, n-gram numbers); the order of the sample decides the landmarks."""
    if not sample:
        return None
    languages = sorted({x[0] for x in sample})
    seen: dict[str, int] = {}
    marks = []
    for lang, ids in sample:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            marks.append(ids)
    features = np.unique(np.concatenate(marks))
    at = np.full(SPACE, -1, np.int64)
    at[features] = np.arange(len(features))

    def dense(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(features)), np.float32)
        for row, ids in zip(out, sets, strict=True):
            known = at[ids]
            row[known[known >= 0]] = 1 / np.sqrt(max(len(ids), 1))
        return out

    z = dense(marks)
    x = np.concatenate([dense([ids for _, ids in sample[i:i + 256]]) @ z.T for i in range(0, len(sample), 256)])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = x.astype(np.float64) @ root
    y = np.array([[1.0 if lang == name else -1.0 for name in languages] for lang, _ in sample])
    beta = np.linalg.solve(phi.T @ phi + ridge * len(sample) * np.eye(phi.shape[1]) / 100, phi.T @ y)
    return Model(languages, features, np.ascontiguousarray(z.T), (root @ beta).astype(np.float32))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, text) -> (h, lang, ids): the distinct n-gram numbers."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        ids = [np.unique(np.concatenate(spectrum_ids(prepared(t)))).astype(np.int32) for t in texts]
        ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))],
            names=["h", "lang", "ids"])


def learn(training: DataFrame, text_col: str, lang_col: str, *, per_language: int = PER_LANGUAGE,
          sample_max: int = SAMPLE_MAX) -> Model | None:
    """Fit on at most ``per_language`` texts of each language and ``sample_max`` in
    all: those with the smallest hashes of their text."""
    session_of(training)
    rows = training.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).take(LANGUAGES_MAX + 1)
    if len(counts) > LANGUAGES_MAX:
        raise ValueError(f"more than {LANGUAGES_MAX} languages")
    if not counts:
        return None
    each = max(2, min(per_language, sample_max // len(counts)))
    unit = (F.xxhash64("text") / F.lit(2.0 ** 64)) + F.lit(0.5)
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.3 * each / r["n"]))).otherwise(share)
    drawn = (rows.withColumn("h", unit).where(F.col("h") <= share).select("h", "lang", "text")
             .mapInArrow(_spectra, "h double, lang string, ids array<int>"))
    found = drawn.orderBy("h").take(2 * each * len(counts))
    taken: dict[str, int] = {}
    sample = []
    for r in found:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            sample.append((r["lang"], np.array(r["ids"], np.int64)))
    return fit(sample)


def classify(docs: DataFrame, model: Model | None, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """id, the extra columns, lang_pred, score, known; one row per input row.

    ``und`` with score and known 0 for a null text, a text without a letter, or without a
    model; else the language with the largest score s, first in alphabetical order
    on a tie, and min(1, max(0, (1 + s) / 2)).  ``known``: the share of the text's
    n-grams that any landmark has.
    """
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias(id_col), *extra, F.col(text_col).cast("string").alias("__text"))
    keep = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buffer = np.zeros((BATCH_DOCS, SPACE), bool) if m else None
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            names, scores, known = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if m and t is not None and _LETTER.search(t)]
            picked = [texts[i] for i in todo]
            for a, b in batches_of(picked):
                s, share = m.decide(presence(picked[a:b], buffer))
                best = s.argmax(axis=1)
                known[todo[a:b]] = share
                for k, i in enumerate(todo[a:b]):
                    names[i] = m.languages[best[k]]
                    scores[i] = min(1.0, max(0.0, (1.0 + float(s[k, best[k]])) / 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(names), pa.array(scores), pa.array(known)],
                names=[*keep, "lang_pred", "score", "known"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{ddl}, lang_pred string, score double, known double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                       training: Column | None = None) -> DataFrame:
    """One row per input row: id, lang_pred, score, known.  Learns from the rows where
    ``training`` holds (all by default) that have a text with a letter and a
    language; the language, id and other columns are never inputs of a prediction.
    Rows that repeat an id are judged alone.  An empty table gives no rows; without
    labelled rows everything is ``und``."""
    model = learn(docs if training is None else docs.where(training), text_col, lang_col)
    return classify(docs, model, id_col, text_col)


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
                         training: Column | None = None, min_known: float = MIN_KNOWN) -> DataFrame:
    """The documents with a predicted language and all their columns; ``lang_col`` becomes
    the prediction.  Rejected are ``und`` and texts whose n-grams the landmarks hardly have
    (``known`` < ``min_known``): other scripts, symbols.  A text in an unlearned language of
    the same script shares most n-grams and passes under the nearest learned one.  Each row
    is judged alone and nothing is joined, so extra columns and repeated ids pass."""
    model = learn(docs if training is None else docs.where(training), text_col, lang_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(f"`{text_col}`").alias("text"))
    judged = classify(packed, model, "row", "text").where((F.col("lang_pred") != UND) & (F.col("known") >= min_known))
    return judged.select(*[(F.col("lang_pred") if c == lang_col else F.col(f"row.`{c}`")).alias(c)
                           for c in docs.columns])
