"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells (source, language, topic): one aggregation,
combined map-side, after which all fitting works on the cell table alone.  Each
round scales the cells' weights to the target tokens of every source, then of
every language, then of every topic.  A cell can give no more than all its tokens:
its scaled weight may exceed them, what counts is the smaller of the two, so that
later rounds move what it can't give to the other cells of the same values.  Rounds
end when every marginal that can still move is met.  A cell's weight over its tokens
is the rate, at most 1, at which its documents are sampled by a hash of the id;
``marginals`` tells for every value what was wanted, what the rates give, and the
shortfall where the wanted tokens do not exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm._shared import materialise

DIMENSIONS = ("source", "lang", "topic")
#: target share of a value: its share of the tokens to this power, normalised
SHARPNESS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
FRACTION = 0.5
#: rounds end at this relative error of the largest marginal, or after MAX_ROUNDS
TOLERANCE, MAX_ROUNDS, CHECK_EVERY = 1e-12, 36, 3
#: how far a cell's scaled weight may pass its tokens: values that can't be met scale their cells for ever
REACH = 1e6
#: significant digits of a rate: sums of doubles depend on their order, decisions must not
DIGITS = 6
NONE = "(none)"
#: topics by what a text contains, first match wins; everything else is "prose"
TOPICS = (("licence", ("Licensed under", "All rights reserved")), ("table", (" | ",)),
          ("symbols", ("%%%", "&&&", "$$$", "***", "###")), ("shouting", ("!!",)))
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        test = text.contains(marks[0])
        for m in marks[1:]:
            test = test | text.contains(m)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def unit_hash(id_col: str) -> Column:
    """A hash of the id as text, uniform in [0, 1)."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(dim: str, given: dict[str, float] | None) -> Column:
    """The target of a cell's value of ``dim``, up to a factor that all values share."""
    if given is not None:
        out = F.lit(0.0)
        for value, weight in given.items():
            out = F.when(F.col(dim) == value, F.lit(float(weight))).otherwise(out)
        return out
    return F.pow(F.sum("tokens").over(Window.partitionBy(dim)).cast("double"), F.lit(float(SHARPNESS[dim])))


def taken() -> Column:
    """The tokens that a cell gives: its scaled weight, or all it has."""
    return F.least(F.col("scaled"), F.col("tokens").cast("double"))


def step(dim: str) -> Column:
    """What a cell's scaled weight is multiplied by to meet the target of its value of ``dim``: cells
    that give all they have stay as they are, if the others can make up the rest."""
    value, full = Window.partitionBy(dim), F.col("scaled") >= F.col("tokens")
    fixed = F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(F.lit(0.0))).over(value)
    free = F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("scaled"))).over(value)
    target = F.col(f"t_{dim}")
    return (F.when((free > 0) & (target > fixed), (target - fixed) / free)
            .when(fixed + free > 0, target / (fixed + free)).otherwise(F.lit(0.0)))


def marginal_error(cells: DataFrame) -> float:
    """The largest relative distance of a marginal from its target, over the values with a cell that can give more."""
    values = F.explode(F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(dim).alias("value"), F.col(f"t_{dim}").alias("t"))
                                 for dim in DIMENSIONS])).alias("v")
    sums = (cells.select(values, taken().alias("w"), (F.col("scaled") < F.col("tokens")).alias("more"))
            .groupBy("v.dim", "v.value").agg(F.sum("w").alias("s"), F.first("v.t").alias("t"), F.bool_or("more").alias("free")))
    return sums.where("free and t > 0").agg(F.max(F.abs(F.col("s") - F.col("t")) / F.col("t")).alias("e")).first()["e"] or 0.0


def rake(cells: DataFrame, given: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION,
         rounds: int = MAX_ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) -> the same with the target tokens of its
    values (t_source, t_lang, t_topic) and the tokens to take (weight, at most tokens)."""
    given = given or {}
    for dim in DIMENSIONS:
        cells = cells.withColumn(f"t_{dim}", targets(dim, given.get(dim)))
    cells = materialise(cells.withColumn("scaled", F.col("tokens") * F.lit(float(fraction)))
                        .withColumns({f"n_{dim}": F.count(F.lit(1)).over(Window.partitionBy(dim)) for dim in DIMENSIONS}),
                        "cells")
    sums = cells.agg(F.sum("tokens").alias("tokens"),
                     *[F.sum(F.col(f"t_{dim}") / F.col(f"n_{dim}")).alias(dim) for dim in DIMENSIONS]).first()
    wanted = float(fraction) * (sums["tokens"] or 0)
    cells = cells.select(*DIMENSIONS, "tokens", "scaled", *[
        (F.col(f"t_{dim}") * F.lit(wanted / sums[dim] if sums[dim] else 0.0)).alias(f"t_{dim}") for dim in DIMENSIONS])
    for turn in range(rounds):
        for dim in DIMENSIONS:
            cells = cells.withColumn("scaled", F.least(F.col("scaled") * step(dim), F.col("tokens") * F.lit(REACH)))
        if turn % CHECK_EVERY == CHECK_EVERY - 1 or turn + 1 == rounds:
            cells = materialise(cells, "cells")
            if marginal_error(cells) <= TOLERANCE:
                break
    return cells.select(*DIMENSIONS, "tokens", taken().alias("weight"), *[f"t_{dim}" for dim in DIMENSIONS])


def significant(x: Column) -> Column:
    """x to DIGITS significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(DIGITS - 1) - F.floor(F.log10(x)))
    return F.when(x > 0, F.round(x * scale) / scale).otherwise(F.lit(0.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, *more: Column) -> DataFrame:
    """id, source, lang, topic, n_tokens and ``more`` of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)).alias("lang"), topic_of(text).alias("topic"),
        F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("n_tokens"), *more)


def cell_rates(rows: DataFrame, fraction: float = FRACTION, rounds: int = MAX_ROUNDS,
               given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, tokens, rate (how often a cell's documents are wanted) and the
    targets t_source, t_lang, t_topic, for keyed rows."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "sums")
    return rake(cells, given, fraction, rounds).select(
        *DIMENSIONS, "tokens", significant(F.col("weight") / F.col("tokens")).alias("rate"), *[f"t_{d}" for d in DIMENSIONS])


def marginals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              lang_col: str = "lang", **options) -> DataFrame:
    """One row per value of a dimension: dimension, value, tokens, wanted, expected (tokens
    that the rates give), shortfall (wanted - expected; negative where other dimensions
    leave a value more than its target)."""
    cells = cell_rates(_keyed(docs, id_col, text_col, source_col, lang_col), **options)
    out = [cells.groupBy(F.lit(dim).alias("dimension"), F.col(dim).alias("value")).agg(
        F.sum("tokens").alias("tokens"), F.first(f"t_{dim}").alias("wanted"),
        F.sum(F.col("rate") * F.col("tokens")).alias("expected")) for dim in DIMENSIONS]
    return (out[0].unionByName(out[1]).unionByName(out[2])
            .withColumn("shortfall", F.col("wanted") - F.col("expected")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang", *, fraction: float = FRACTION, rounds: int = MAX_ROUNDS,
        given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per input row: id, source, lang, topic, n_tokens, rate (the probability of
    being sampled, 6 significant digits), sampled.

    Tokens are words between ASCII white space, at least 1 a document, so empty
    and null texts are sampled like others.  Null sources and languages form the
    value "(none)".  ``fraction`` is the share of all tokens wanted in the mix
    (more than 1 can't be met: every document is taken once at most);
    ``given`` may name target weights by dimension and value (values not named
    get 0).  Rows that repeat an id share their draw.  An empty table gives no rows.
    """
    rows = materialise(_keyed(docs, id_col, text_col, source_col, lang_col), "tokens")
    rates = cell_rates(rows, fraction, rounds, given).select(*DIMENSIONS, "rate")
    return rows.join(rates, list(DIMENSIONS)).select(
        F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", "rate",
        (unit_hash("id") < F.col("rate")).alias("sampled"))


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               lang_col: str = "lang", **options) -> DataFrame:
    """The sampled documents with all their columns.  Documents meet only the rates of
    their cells, never each other."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = _keyed(docs, id_col, text_col, source_col, lang_col)
    rates = cell_rates(keyed, **options).select(*DIMENSIONS, "rate")
    return (_keyed(docs, id_col, text_col, source_col, lang_col, row).drop("n_tokens")
            .join(rates, list(DIMENSIONS)).where(unit_hash("id") < F.col("rate")).select("row.*"))
