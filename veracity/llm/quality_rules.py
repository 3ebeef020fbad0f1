"""Quality rules whose cutoffs control the risk of rejecting good documents.

Each rule measures a share between 0 and 1 that is high in bad text.  The
labelled good documents are the holdout: for every stratum, rule and cutoff the
rejected ones among them are counted, and the exact binomial tail gives the
probability of so few rejections if the true rate were the allowed one.  Cutoffs
of a rule are tested from the loosest to the strictest, stopping at the first that
fails (fixed-sequence testing needs no correction inside the sequence); the level
is divided by the number of strata and rules (Bonferroni).  A stratum's allowed
rate is split evenly over the rules, so with confidence 1 - delta no stratum loses
more than alpha of its good documents to the rules.  A rule without a certified
cutoff rejects nothing in that stratum.

Everything is DataFrame expressions: word counts and repeated windows are found
inside a row with higher-order functions, so texts are never shuffled, and only
bin counts (strata x rules x cutoffs) are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm._shared import materialise

ALPHA = 0.05
DELTA = 0.05
CUTOFFS = tuple(round(0.01 * i, 2) for i in range(1, 10)) + tuple(round(0.05 * i, 2) for i in range(2, 20))
RULES = ("symbols", "capitals", "exclamations", "dup_lines", "repeats")
NONE = "(none)"

_SPACE = r"\\x20\\x09-\\x0D"
_WORDS = f"filter(split(t, '[{_SPACE}]+'), w -> w <> '')"
_LINES = f"filter(split(t, '\\n'), l -> l rlike '[^{_SPACE}]')"
#: hashes of the 5-word windows -> words covered by windows that occur twice or more
_COVERED = """
transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as p)))), s ->
  aggregate(
    array_sort(transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h or get(s, i + 1).h <=> x.h), x -> x.p)),
    struct(-5 as last, 0L as n),
    (a, p) -> struct(p as last, a.n + least(5, p - a.last) as n)).n)[0]
"""
_REPEATS = f"""
case when size(ws) < 5 then 0L else
  transform(array(transform(sequence(1, size(ws) - 4), i -> xxhash64(slice(ws, i, 5)))), h ->
    case when size(array_distinct(h)) = size(h) then 0L else {_COVERED} end)[0]
end
"""


def _removed(chars: str) -> str:
    """Characters of t that are one of ``chars``."""
    return f"cast(length(t) - length(translate(t, '{chars}', '')) as bigint)"


def measures(docs: DataFrame, id_col: str, text_col: str, stratum_col: str | None) -> DataFrame:
    """id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_capitals, n_exclamations, one row per input row."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(NONE)) if stratum_col else F.lit(NONE)
    rows = docs.select(F.col(id_col).alias("id"), stratum.alias("stratum"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select(
        "id", "stratum",
        F.expr(f"transform(array({_WORDS}), ws -> struct(cast(size(ws) as bigint) as n_words,"
               f" {_REPEATS} as n_repeat_words))[0]").alias("w"),
        F.expr(f"transform(array({_LINES}), ls -> struct(cast(size(ls) as bigint) as n_lines,"
               " cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines))[0]").alias("l"),
        F.expr("cast(length(translate(t, ' \\t\\n\\x0b\\f\\r', '')) as bigint)"
               .replace("\\x0b", "\\u000B").replace("\\f", "\\u000C")).alias("word_chars"),
        F.expr(_removed("#*$%&|<>")).alias("n_symbols"),
        F.expr(_removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        F.expr(_removed("!")).alias("n_exclamations"))
    return rows.select("id", "stratum", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                       "l.n_lines", "n_capitals", "n_exclamations")


def rule_values() -> dict[str, Column]:
    """Rule -> share; 0 where there is nothing to divide by."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "capitals": share("n_capitals", "word_chars"),
            "exclamations": share("n_exclamations", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words")}


def binomial_tail(n: str, k: str, rate: float) -> Column:
    """P(Binomial(n, rate) <= k), exact, summed in logarithms; 1 where k is at or
    above the mean (such a count never certifies anything)."""
    odds = rate / (1 - rate)
    return F.expr(f"""
case when {k} >= {n} * {rate}D then 1D else
  exp(aggregate(if({k} > 0, sequence(1L, {k}), cast(array() as array<bigint>)),
    struct({n} * ln({1 - rate}D) as term, {n} * ln({1 - rate}D) as total),
    (a, i) -> transform(array(a.term + ln(({n} - i + 1) / i * {odds}D)), t ->
      struct(t as term, greatest(a.total, t) + ln(1D + exp(least(a.total, t) - greatest(a.total, t))) as total))[0]
  ).total) end""")


def certified_cutoffs(table: DataFrame, good: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff (the strictest certified one; rules without any are absent).

    ``table``: measures; ``good``: the ids labelled good (column id)."""
    values = rule_values()
    grid = F.array(*[F.lit(float(c)) for c in CUTOFFS])

    def exceeded(value: Column) -> Column:
        return F.size(F.filter(grid, lambda cutoff: value > cutoff))

    held = table.join(good, "id", "left_semi").select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), exceeded(v).alias("bin"))
        for r, v in values.items()])).alias("x"))
    bins = held.groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("c"))
    # rejected at cutoff j: documents whose value exceeds more than j cutoffs
    per = bins.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.collect_list(F.struct("bin", "c")).alias("bins"))
    tests = per.select("stratum", "rule", "n", "bins", F.posexplode(grid).alias("j", "cutoff")).select(
        "stratum", "rule", "n", "j", "cutoff",
        F.expr("aggregate(filter(bins, b -> b.bin > j), 0L, (a, b) -> a + b.c)").alias("k"))
    strata = max(1, bins.agg(F.countDistinct("stratum").alias("s")).first()["s"])
    level = delta / (strata * len(values))
    passed = F.col("p") <= F.lit(level)
    loosest_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("j"))
    return (tests.withColumn("p", binomial_tail("n", "k", alpha / len(values)))
            .withColumn("ok", F.min(passed.cast("int")).over(loosest_first))
            .where("ok = 1").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str | None = "lang", label_id_col: str = "doc_id", label_col: str = "quality", *,
                  alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per input row: id, stratum, the measures, base_failed, failed (names
    of the rules that reject it, sorted), kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated
    5-word windows.  A null text has no words.  A null stratum is a stratum of its
    own; a null id is measured and judged but is no holdout.  A document is a good
    holdout when all its labels are 1; ties and repeated labels change nothing.
    Without labels only the base rules act.  An empty table gives no rows.
    """
    table = materialise(measures(docs, id_col, text_col, stratum_col), "measures")
    good = (labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
            .where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y")).where("y = 1"))
    cutoffs = certified_cutoffs(table, good.select("id"), alpha=alpha, delta=delta)
    wide = cutoffs.groupBy("stratum").agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    judged = table.join(wide, "stratum", "left")
    failed = F.filter(F.array(*[F.when(v > F.col(f"cut_{r}"), F.lit(r)) for r, v in sorted(rule_values().items())]),
                      lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (judged.withColumn("base_failed", base).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
            .select(F.col("id").alias(id_col), "stratum", *[c for c in table.columns if c not in ("id", "stratum")],
                    "base_failed", "failed", "kept"))
