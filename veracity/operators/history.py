"""History analytics: J1-J3, A3 and H1-H17.

Inputs are the article table and the canonical flat history (see
``sources.views.history``).  Every metric is computed for all articles with
more than one analysis unless ``limit`` is given; with a limit the top-k
candidates (ordered by analysis count, then id) are picked first and the
history is narrowed by a broadcast semi join whose size is the limit.

Order of analyses is (created_at, id) everywhere.

Skew: per-article results come from partial aggregations (``count``,
``min``/``max``, ``min_by``/``max_by``) that combine map-side, and the
consecutive-pair metrics use ``plans.ordered.with_previous``, which splits a
long history over balanced range partitions.  No article's history is ever gathered into
one task or one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import fmt2, score_band
from veracity.plans.ordered import first_last, with_previous
from veracity.sources.schemas import SCORE_FIELDS



def _order() -> Column:
    """Analysis order: (created_at, id)."""
    return F.struct("created_at", "id")

DOC_FIELDS = ["credibility_score", "sentiment_score", "bias_score", "topics",
              "key_arguments", "perspectives", "summary"]
SCORE_NAMES = {"credibility_score": "credibility", "sentiment_score": "sentiment",
               "bias_score": "bias"}

# Trend labels per score (rising, falling) and sentence texts.
TREND_LABELS = {
    "credibility_score": ("increasing", "decreasing"),
    "sentiment_score": ("more_positive", "more_negative"),
    "bias_score": ("increasing", "decreasing"),
}
TREND_THRESHOLD = 0.1
NO_CHANGES = "No significant changes detected between analyses."
COMPARISON_PREFIX = "Analysis comparison summary: "
QUALITY_PREFIX = "Analysis quality summary: "
QUALITY_SENTENCES = {
    "consistency": ("The analysis shows high consistency between different evaluations",
                    "The analysis shows moderate consistency between different evaluations",
                    "The analysis shows low consistency between different evaluations"),
    "depth": ("The analysis demonstrates comprehensive depth",
              "The analysis shows moderate depth",
              "The analysis appears relatively shallow"),
    "completeness": ("The analysis is highly complete with all expected components",
                     "The analysis is moderately complete",
                     "The analysis is incomplete with missing components"),
    "timeliness": ("The analysis shows excellent timeliness with frequent updates",
                   "The analysis shows moderate timeliness",
                   "The analysis shows poor timeliness with infrequent updates"),
    "overall_rating": ("Overall, this represents a high-quality analysis",
                       "Overall, this represents a moderate-quality analysis",
                       "Overall, this represents a low-quality analysis"),
}
EVOLUTION_PREFIX = "Analysis evolution summary: "
# (rising sentence, falling sentence, stable sentence); {f}/{l} = first/last value.
# The credibility and rising-sentiment texts are the reference's; the others
# follow them by symmetry (the reference file ends before them).
EVOLUTION_SENTENCES = {
    "credibility_score": ("The credibility score has increased from {f} to {l}, showing improved credibility",
                          "The credibility score has decreased from {f} to {l}, showing reduced credibility",
                          "The credibility score has remained stable around {f}"),
    "sentiment_score": ("The sentiment score has improved from {f} to {l}, showing more positive sentiment",
                        "The sentiment score has declined from {f} to {l}, showing more negative sentiment",
                        "The sentiment score has remained stable around {f}"),
    "bias_score": ("The bias score has increased from {f} to {l}, showing increased bias",
                   "The bias score has decreased from {f} to {l}, showing reduced bias",
                   "The bias score has remained stable around {f}"),
}
TOPIC_CHANGED = "Topics changed {n} times across analyses"
TOPIC_STABLE = "Topics remained consistent across analyses"
PERSPECTIVE_CHANGED = "Perspectives changed {n} times across analyses"
PERSPECTIVE_STABLE = "Perspectives remained consistent across analyses"


# ---------------------------------------------------------------- basics (J*, A3)

def analysis_counts(history: DataFrame) -> DataFrame:
    """Per article: analysis_count, first/last analysis time (partial agg)."""
    return history.groupBy("article_id").agg(
        F.count("id").alias("analysis_count"),
        F.min("created_at").alias("first_analysis_date"),
        F.max("created_at").alias("last_analysis_date"),
    )


def with_analysis_counts(articles: DataFrame, history: DataFrame) -> DataFrame:
    """Every article with its number of analyses (0 when none)."""
    c = history.groupBy("article_id").agg(F.count("id").alias("analysis_count"))
    return (articles.join(c, articles["id"] == c["article_id"], "left")
            .drop("article_id")
            .withColumn("analysis_count", F.coalesce("analysis_count", F.lit(0).cast("long"))))


def latest_analysis(history: DataFrame, dedup: bool = False) -> DataFrame:
    """The latest analysis row(s) per article.

    Default keeps every row at the latest time (the reference's row-value
    IN semantics): a max per article (partial agg) joined back on
    (article_id, created_at).  ``dedup=True`` keeps one row, the highest id,
    with a single ``max_by`` aggregation.
    """
    if dedup:
        cols = [c for c in history.columns if c != "article_id"]
        return (history.groupBy("article_id")
                .agg(F.max_by(F.struct(*cols), _order()).alias("_l"))
                .select("article_id", "_l.*"))
    top = history.groupBy("article_id").agg(F.max("created_at").alias("created_at"))
    return history.join(top, ["article_id", "created_at"], "inner")


def articles_with_latest(articles: DataFrame, history: DataFrame, dedup: bool = False,
                         prefix: str = "analysis_") -> DataFrame:
    """Articles LEFT JOIN their latest analysis (ties multiply rows)."""
    lat = latest_analysis(history, dedup)
    lat = lat.select(*[F.col(c).alias(prefix + c) if c != "article_id" else F.col(c)
                       for c in lat.columns])
    return articles.join(lat, articles["id"] == lat["article_id"], "left").drop("article_id")


def article_with_history(articles: DataFrame, history: DataFrame, newest_first: bool = True,
                         columns: list[str] | None = None) -> DataFrame:
    """One row per (article, analysis) with its position in the history and the
    history's ``columns`` (all by default; name few, they are carried through a shuffle).

    Long format instead of a nested list: a history of any length stays
    spread over tasks.  ``position`` counts from the newest analysis when
    ``newest_first`` (the reference's order), else from the oldest.
    """
    if columns is not None:
        history = history.select(*dict.fromkeys(["article_id", "created_at", "id", *columns]))
    seq = with_previous(history, ["article_id"], "created_at", "id", [])
    pos = (F.col("group_size") - F.col("seq") + 1) if newest_first else F.col("seq")
    h = seq.withColumn("position", pos).drop("seq", "has_prev", "group_size")
    h = h.select(*[F.col(c).alias("analysis_" + c) if c not in ("article_id", "position") else F.col(c)
                   for c in h.columns])
    return articles.join(h, articles["id"] == h["article_id"], "inner").drop("article_id")


def multi_analysis_articles(articles: DataFrame, history: DataFrame, limit: int | None = None,
                            recent_from: Column | None = None,
                            extra: tuple[str, ...] = ()) -> DataFrame:
    """A3: articles with more than one analysis, most analysed first.

    ``recent_from`` (a date Column) keeps articles created on or after that
    date (F7 semantics); ``extra`` adds article columns to the output.
    """
    a = articles
    if recent_from is not None:
        a = a.filter(F.to_date("created_at") >= recent_from)
    a = a.select("id", "title", "source", *extra)
    c = analysis_counts(history).filter(F.col("analysis_count") > 1)
    res = a.join(c, a["id"] == c["article_id"], "inner").drop("article_id")
    if limit is not None:
        res = res.orderBy(F.desc("analysis_count"), "id").limit(limit)
    return res


def _scope(history: DataFrame, cands: DataFrame, limit: int | None) -> DataFrame:
    """Narrow the history to the candidates when they are a bounded top-k."""
    if limit is None:
        return history
    ids = cands.select(F.col("id").alias("article_id"))
    return history.join(ids, "article_id", "left_semi")


# --------------------------------------------------------------- per-article aggs

def _doc_scalars() -> list[Column]:
    """Fixed-width facts of one analysis (keeps hash aggregation usable)."""
    return [
        F.size("perspectives").alias("n_perspectives"),
        F.size("key_arguments").alias("n_arguments"),
        F.size("topics").alias("n_topics"),
        *[F.col(c).isNotNull().alias(f"has_{c}") for c in DOC_FIELDS],
    ]


def _oldest_facts(history: DataFrame) -> DataFrame:
    facts = history.select("article_id", "created_at", "id", *_doc_scalars())
    cols = [c for c in facts.columns if c not in ("article_id", "created_at", "id")]
    return (facts.groupBy("article_id")
            .agg(F.count("id").alias("analysis_count"),
                 F.min("created_at").alias("first_analysis_date"),
                 F.max("created_at").alias("last_analysis_date"),
                 F.min_by(F.struct(*cols), _order()).alias("oldest")))


def _depth(o: str = "oldest") -> Column:
    def term(n: str, cap: int) -> Column:
        return F.coalesce(F.least(F.lit(1.0), F.col(f"{o}.{n}") / cap), F.lit(0.0))
    total = term("n_perspectives", 4) + term("n_arguments", 5) + term("n_topics", 5)
    for s in SCORE_FIELDS:
        total = total + F.when(F.col(f"{o}.has_{s}"), F.lit(0.3)).otherwise(F.lit(0.0))
    return total / 5


def _completeness(o: str = "oldest") -> Column:
    n = None
    for c in DOC_FIELDS:
        t = F.col(f"{o}.has_{c}").cast("int")
        n = t if n is None else n + t
    return n / 8


def _timeliness() -> Column:
    secs = F.timestamp_diff("MICROSECOND", F.col("first_analysis_date"),
                            F.col("last_analysis_date")) / 1e6
    avg_hours = secs / 3600 / (F.col("analysis_count") - 1)
    t = 1.0 / (1.0 + avg_hours / 24)
    return F.when(F.col("analysis_count") < 2, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def score_changes(history: DataFrame) -> DataFrame:
    """Consecutive changes of each score over its present values.

    Rows: article_id, field, created_at, id, value, prev_value, change.
    """
    long = (history.select("article_id", "created_at", "id", *SCORE_FIELDS)
            .unpivot(["article_id", "created_at", "id"], list(SCORE_FIELDS), "field", "value")
            .filter(F.col("value").isNotNull()))
    seq = with_previous(long, ["article_id", "field"], "created_at", "id", ["value"])
    return (seq.filter("has_prev")
            .select("article_id", "field", "created_at", "id", "value",
                    F.col("prev_value"), F.abs(F.col("value") - F.col("prev_value")).alias("change")))


def _consistency(history: DataFrame) -> DataFrame:
    """article_id, consistency: one pass over the history that carries the last known
    value of each score, then a partial aggregation of the largest changes."""
    seq = with_previous(history.select("article_id", "created_at", "id", *SCORE_FIELDS), ["article_id"],
                        "created_at", "id", list(SCORE_FIELDS), known=True)
    per = seq.groupBy("article_id").agg(*[
        F.max(F.abs(F.col(f) - F.col(f"prev_{f}"))).alias(f"_mx_{f}") for f in SCORE_FIELDS])
    total, n = None, None
    for f in SCORE_FIELDS:
        v, has = F.coalesce(F.col(f"_mx_{f}"), F.lit(0.0)), F.col(f"_mx_{f}").isNotNull().cast("int")
        total = v if total is None else total + v
        n = has if n is None else n + has
    cons = F.when(n == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total / n)))
    return per.select("article_id", cons.alias("consistency"))


def consistency(articles: DataFrame, history: DataFrame) -> DataFrame:
    """H7 alone: id, consistency of the articles with more than one analysis."""
    counts = history.groupBy("article_id").agg(F.count("id").alias("n")).filter(F.col("n") > 1).select("article_id")
    ids = articles.select(F.col("id").alias("article_id")).join(counts, "article_id")
    return (ids.join(_consistency(history), "article_id", "left")
            .select(F.col("article_id").alias("id"), F.coalesce("consistency", F.lit(1.0)).alias("consistency")))


def oldest_metrics(articles: DataFrame, history: DataFrame) -> DataFrame:
    """H8-H10 alone: id, depth, completeness, timeliness of the articles with more than
    one analysis, from one aggregation of the history."""
    facts = _oldest_facts(history).filter(F.col("analysis_count") > 1)
    return (articles.select(F.col("id").alias("article_id")).join(facts, "article_id")
            .select(F.col("article_id").alias("id"), _depth().alias("depth"),
                    _completeness().alias("completeness"), _timeliness().alias("timeliness")))


def analysis_quality(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """Consistency, depth, completeness, timeliness and their mean.

    Without a limit the analysis count, first/last time and the oldest
    analysis' facts come from one aggregation; the consecutive changes
    (consistency) from a second, chunked pass.
    """
    if limit is None:
        h = history
        facts = _oldest_facts(h).filter(F.col("analysis_count") > 1)
        a = articles.select("id", "title", "source")
        base = a.join(facts, a["id"] == facts["article_id"], "inner").drop("article_id")
    else:
        cands = multi_analysis_articles(articles, history, limit)
        h = _scope(history, cands, limit)
        facts = _oldest_facts(h).select("article_id", "oldest")
        base = cands.join(facts, cands["id"] == facts["article_id"], "inner").drop("article_id")
    base = base.select("id", "title", "source", "analysis_count", "first_analysis_date",
                       "last_analysis_date", _depth().alias("depth"),
                       _completeness().alias("completeness"), _timeliness().alias("timeliness"))
    cons = _consistency(h)
    res = (base.join(cons, base["id"] == cons["article_id"], "left").drop("article_id")
           .withColumn("consistency", F.coalesce("consistency", F.lit(1.0))))
    overall = (((F.col("consistency") + F.col("depth")) + F.col("completeness")) + F.col("timeliness")) / 4
    res = res.withColumn("overall_rating", overall)
    return res.select("id", "title", "source", "analysis_count", "first_analysis_date",
                      "last_analysis_date", "consistency", "depth", "completeness",
                      "timeliness", "overall_rating")


def _band_sentence(x: Column, texts: tuple[str, str, str]) -> Column:
    return F.when(x > 0.8, texts[0]).when(x > 0.5, texts[1]).otherwise(texts[2])


def quality_summary(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """The five quality sentences per article."""
    q = analysis_quality(articles, history, limit)
    parts = [_band_sentence(F.col(k), t) for k, t in QUALITY_SENTENCES.items()]
    text = F.concat(F.lit(QUALITY_PREFIX), F.concat_ws(". ", *parts), F.lit("."))
    return q.select("id", "title", "source", "analysis_count", "overall_rating",
                    text.alias("quality_summary"))


# ------------------------------------------------------------------ trends (H13+)

def _trend_aggs(history: DataFrame) -> DataFrame:
    aggs = [F.count("id").alias("analysis_count")]
    for f in SCORE_FIELDS:
        aggs += first_last("created_at", "id", f, f)
    return history.groupBy("article_id").agg(*aggs)


def _trend_cols(f: str) -> dict[str, Column]:
    n, first, last = F.col(f"{f}_n"), F.col(f"{f}_first"), F.col(f"{f}_last")
    ok = n >= 2
    change = F.when(ok, last - first).otherwise(F.lit(0.0))
    up, down = TREND_LABELS[f]
    trend = (F.when(ok & (change > TREND_THRESHOLD), up)
             .when(ok & (change < -TREND_THRESHOLD), down).otherwise("stable"))
    name = SCORE_NAMES[f]
    return {f"{name}_trend": trend, f"{name}_change": change,
            f"{name}_first": F.when(ok, first), f"{name}_last": F.when(ok, last)}


def score_trend(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H13 (all three scores, long format): id, field, n_values, trend,
    change, first_value, last_value."""
    cands = multi_analysis_articles(articles, history, limit)
    t = _trend_aggs(_scope(history, cands, limit))
    rows = []
    for f in SCORE_FIELDS:
        c = _trend_cols(f)
        name = SCORE_NAMES[f]
        rows.append(t.select(
            "article_id", F.lit(name).alias("field"), F.col(f"{f}_n").alias("n_values"),
            c[f"{name}_trend"].alias("trend"), c[f"{name}_change"].alias("change"),
            c[f"{name}_first"].alias("first_value"), c[f"{name}_last"].alias("last_value")))
    long = rows[0].unionByName(rows[1]).unionByName(rows[2])
    ids = cands.select("id")
    return ids.join(long, ids["id"] == long["article_id"], "inner").drop("article_id")


KINDS = ("topic", "perspective")


def _value_sets() -> dict[str, Column]:
    empty = F.array().cast("array<string>")
    return {"topic": F.array_sort(F.array_distinct(F.coalesce("topics", empty))),
            "perspective": F.array_sort(F.coalesce(F.map_keys("perspectives"), empty))}


def evolution_steps(history: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """H14/H15 step rows: the sets (of the asked kinds) of each analysis next to
    the previous analysis' sets (absent = empty set), with added/removed."""
    sets = history.select("article_id", "created_at", "id",
                          *[_value_sets()[k].alias(f"{k}_set") for k in kinds])
    out = with_previous(sets, ["article_id"], "created_at", "id", [f"{k}_set" for k in kinds])
    for kind in kinds:
        cur, prev = F.col(f"{kind}_set"), F.col(f"prev_{kind}_set")
        added = F.when(F.col("has_prev"), F.array_sort(F.array_except(cur, prev)))
        removed = F.when(F.col("has_prev"), F.array_sort(F.array_except(prev, cur)))
        out = out.withColumns({f"{kind}s_added": added, f"{kind}s_removed": removed})
        out = out.withColumn(f"{kind}_changed", F.col("has_prev") & (
            (F.size(f"{kind}s_added") > 0) | (F.size(f"{kind}s_removed") > 0)))
    return out


def change_steps(articles: DataFrame, history: DataFrame, kind: str = "topic", limit: int | None = None) -> DataFrame:
    """H14/H15 step list, one row per change: the analysis (id, date) whose
    topic (or perspective) set differs from the previous analysis, with the
    values added and removed (sorted).  Articles with >1 analysis only."""
    cands = multi_analysis_articles(articles, history, limit)
    steps = (evolution_steps(_scope(history, cands, limit), (kind,)).filter(F.col(f"{kind}_changed"))
             .select("article_id", F.col("id").alias("analysis_id"), F.col("created_at").alias("date"),
                     F.col(f"{kind}s_added").alias("added"), F.col(f"{kind}s_removed").alias("removed")))
    ids = cands.select(F.col("id").alias("article_id"))
    return ids.join(steps, "article_id", "inner").withColumnRenamed("article_id", "id")


def _all_values(history: DataFrame, kind: str) -> DataFrame:
    """article_id, all_<kind>s: every value seen, sorted.  Distinct (article, value) rows
    first, so only an article's distinct values ever meet."""
    return (history.select("article_id", F.explode_outer(_value_sets()[kind]).alias("v")).distinct()
            .groupBy("article_id").agg(F.array_sort(F.collect_list("v")).alias(f"all_{kind}s")))


def _evolution_aggs(history: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    out = evolution_steps(history, kinds).groupBy("article_id").agg(
        *[F.count_if(f"{k}_changed").alias(f"{k}_changes") for k in kinds])
    for kind in kinds:
        out = out.join(_all_values(history, kind), "article_id")
    return out


def topic_evolution(articles: DataFrame, history: DataFrame, limit: int | None = None, kind: str = "topic") -> DataFrame:
    """H14 (kind='topic') / H15 (kind='perspective'): number of steps whose
    set differs from the previous analysis, and every value seen."""
    cands = multi_analysis_articles(articles, history, limit)
    ev = _evolution_aggs(_scope(history, cands, limit), (kind,))
    return (cands.join(ev, cands["id"] == ev["article_id"], "inner")
            .select("id", "title", "source", "analysis_count",
                    F.col(f"{kind}_changes").alias("changes"),
                    F.col(f"all_{kind}s").alias(f"all_{kind}s")))


def analysis_evolution(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """The three score trends plus topic and perspective evolution."""
    cands = multi_analysis_articles(articles, history, limit)
    h = _scope(history, cands, limit)
    t = _trend_aggs(h).drop("analysis_count")
    cols = {}
    for f in SCORE_FIELDS:
        cols.update(_trend_cols(f))
    t = t.select("article_id", *[c.alias(k) for k, c in cols.items()])
    ev = _evolution_aggs(h)
    res = (cands.join(t, cands["id"] == t["article_id"], "inner").drop("article_id")
           .join(ev, cands["id"] == ev["article_id"], "inner").drop("article_id"))
    return res


def _fmt_sentence(template: str, first: Column, last: Column) -> Column:
    parts: list[Column] = []
    rest = template
    while rest:
        i = min([p for p in (rest.find("{f}"), rest.find("{l}")) if p >= 0], default=-1)
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i > 0:
            parts.append(F.lit(rest[:i]))
        parts.append(fmt2(first) if rest[i:i + 3] == "{f}" else fmt2(last))
        rest = rest[i + 3:]
    return F.concat(*parts)


def evolution_summary(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """One sentence per score trend (skipped when the score has fewer
    than two values) and one each for topics and perspectives."""
    ev = analysis_evolution(articles, history, limit)
    parts = []
    for f in SCORE_FIELDS:
        name = SCORE_NAMES[f]
        up_label, down_label = TREND_LABELS[f]
        up, down, stable = EVOLUTION_SENTENCES[f]
        first, last, trend = F.col(f"{name}_first"), F.col(f"{name}_last"), F.col(f"{name}_trend")
        parts.append(F.when(first.isNull(), F.lit(None).cast("string"))
                     .when(trend == up_label, _fmt_sentence(up, first, last))
                     .when(trend == down_label, _fmt_sentence(down, first, last))
                     .otherwise(_fmt_sentence(stable, first, last)))
    for kind, changed, stable in (("topic", TOPIC_CHANGED, TOPIC_STABLE),
                                  ("perspective", PERSPECTIVE_CHANGED, PERSPECTIVE_STABLE)):
        n = F.col(f"{kind}_changes")
        pre, post = changed.split("{n}")
        parts.append(F.when(n > 0, F.concat(F.lit(pre), n.cast("string"), F.lit(post)))
                     .otherwise(F.lit(stable)))
    text = F.concat(F.lit(EVOLUTION_PREFIX), F.concat_ws(". ", *parts), F.lit("."))
    return ev.select("id", "title", "source", "analysis_count", text.alias("evolution_summary"))


# ------------------------------------------------------------ first vs last (H5/H6)

def _first_last_docs(history: DataFrame) -> DataFrame:
    doc = F.struct(*DOC_FIELDS)
    return history.groupBy("article_id").agg(
        F.min_by(doc, _order()).alias("old"), F.max_by(doc, _order()).alias("new"))


def _comparison_base(articles, history, limit):
    cands = multi_analysis_articles(articles, history, limit)
    d = _first_last_docs(_scope(history, cands, limit))
    return cands.join(d, cands["id"] == d["article_id"], "inner").drop("article_id")


def analysis_comparison(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H5 scores: old, new and new-old for each score present in both the
    first and the last analysis."""
    b = _comparison_base(articles, history, limit)
    cols = []
    for f in SCORE_FIELDS:
        o, n = F.col(f"old.{f}"), F.col(f"new.{f}")
        both = o.isNotNull() & n.isNotNull()
        name = SCORE_NAMES[f]
        cols += [F.when(both, o).alias(f"{name}_old"), F.when(both, n).alias(f"{name}_new"),
                 F.when(both, n - o).alias(f"{name}_change")]
    return b.select("id", "title", "source", "analysis_count", *cols)


def _set_diff(old: Column, new: Column) -> tuple[Column, Column, Column]:
    both = old.isNotNull() & new.isNotNull()
    return (F.when(both, F.array_sort(F.array_except(new, old))),
            F.when(both, F.array_sort(F.array_except(old, new))),
            F.when(both, F.array_sort(F.array_intersect(old, new))))


def topic_diff(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H5 topics: added, removed and common topics between first and last."""
    b = _comparison_base(articles, history, limit)
    added, removed, common = _set_diff(F.col("old.topics"), F.col("new.topics"))
    return b.select("id", added.alias("topics_added"), removed.alias("topics_removed"),
                    common.alias("topics_common"))


def perspective_diff(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H5 perspectives: one row per perspective in either analysis (when both
    have perspectives) with old/new credibility and whether the summary moved."""
    b = _comparison_base(articles, history, limit).filter(
        F.col("old.perspectives").isNotNull() & F.col("new.perspectives").isNotNull())
    keys = F.array_union(F.map_keys("old.perspectives"), F.map_keys("new.perspectives"))
    e = b.select("id", "old", "new", F.explode(keys).alias("perspective"))
    o = F.col("old.perspectives")[F.col("perspective")]
    n = F.col("new.perspectives")[F.col("perspective")]
    return e.select("id", "perspective",
                    o["credibility"].alias("old_credibility"),
                    n["credibility"].alias("new_credibility"),
                    (~o["summary"].eqNullSafe(n["summary"])).alias("summary_changed"))


def comparison_summary(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H6: sentences for moved scores and added/removed topics, perspectives
    and key arguments (lists sorted)."""
    b = _comparison_base(articles, history, limit)
    parts = []
    for f in SCORE_FIELDS:
        o, n = F.col(f"old.{f}"), F.col(f"new.{f}")
        ch = n - o
        direction = F.when(ch > 0, "increased").otherwise("decreased")
        parts.append(F.when(o.isNotNull() & n.isNotNull() & (F.abs(ch) > TREND_THRESHOLD), F.concat(
            F.lit(f"The {SCORE_NAMES[f]} score "), direction, F.lit(" from "), fmt2(o),
            F.lit(" to "), fmt2(n))))
    for label, fld in (("topics", "topics"), ("perspectives", "perspectives"),
                       ("key arguments", "key_arguments")):
        o, n = F.col(f"old.{fld}"), F.col(f"new.{fld}")
        if fld == "perspectives":
            o, n = F.when(o.isNotNull(), F.map_keys(o)), F.when(n.isNotNull(), F.map_keys(n))
        added, removed, _ = _set_diff(o, n)
        parts.append(F.when(F.size(added) > 0, F.concat(F.lit(f"Added {label}: "), F.array_join(added, ", "))))
        parts.append(F.when(F.size(removed) > 0, F.concat(F.lit(f"Removed {label}: "), F.array_join(removed, ", "))))
    arr = F.array_compact(F.array(*parts))
    text = F.when(F.size(arr) == 0, F.lit(NO_CHANGES)).otherwise(
        F.concat(F.lit(COMPARISON_PREFIX), F.array_join(arr, ". "), F.lit(".")))
    return b.select("id", "title", "source", "analysis_count", text.alias("comparison_summary"))


# ------------------------------------------------------------------- H1 / H2 / H3

def credibility_changes(articles: DataFrame, history: DataFrame, limit: int | None = None) -> DataFrame:
    """H1: articles whose analyses at two different times carry different
    levels (level = FAQ band of the credibility score).

    Equivalent to the quadratic self join: over rows with a level, there are
    >1 distinct levels and >1 distinct times.  min<max tests replace
    distinct counts so the whole check is one partial aggregation.
    """
    lv = score_band("credibility_score")
    r = (history.select("article_id", "created_at", lv.alias("level"))
         .filter(F.col("level").isNotNull())
         .groupBy("article_id")
         .agg(F.min("level").alias("_l0"), F.max("level").alias("_l1"),
              F.min("created_at").alias("_t0"), F.max("created_at").alias("_t1"))
         .filter((F.col("_l0") < F.col("_l1")) & (F.col("_t0") < F.col("_t1"))))
    a = articles.select("id", "title", "source")
    res = a.join(r, a["id"] == r["article_id"], "inner").select("id", "title", "source")
    if limit is not None:
        res = res.orderBy("id").limit(limit)
    return res


def credibility_trend(articles: DataFrame, history: DataFrame, days: int = 30, as_of: str = "2024-01-26",
                      limit: int | None = None) -> DataFrame:
    """H2: multi-analysis articles created in the last ``days`` days before
    ``as_of`` with their current level (the reference repeats it per entry)."""
    since = F.date_sub(F.to_date(F.lit(as_of)), days)
    return multi_analysis_articles(articles, history, limit, recent_from=since,
                                   extra=("credibility_level", "created_at")).withColumnRenamed(
        "credibility_level", "current_credibility")


def credibility_history(articles: DataFrame, history: DataFrame, days: int = 30, as_of: str = "2024-01-26",
                        limit: int | None = None) -> DataFrame:
    """H2 list: for each article of ``credibility_trend`` one row per
    analysis with its date and the article's current level (the reference
    repeats that level on every entry), oldest first (``position``)."""
    cands = credibility_trend(articles, history, days, as_of, limit)
    ids = cands.select(F.col("id").alias("article_id"), F.col("current_credibility").alias("credibility"))
    h = history.join(ids.select("article_id"), "article_id", "left_semi") if limit is None \
        else _scope(history, cands, limit)
    seq = with_previous(h.select("article_id", "id", "created_at"), ["article_id"], "created_at", "id", [])
    return (ids.join(seq, "article_id", "inner")
            .select(F.col("article_id").alias("id"), F.col("id").alias("analysis_id"),
                    F.col("created_at").alias("date"), "credibility", F.col("seq").alias("position")))


def multiple_analyses(articles: DataFrame, history: DataFrame, limit: int | None = None,
                      days: int | None = None, as_of: str = "2024-01-26") -> DataFrame:
    """H3/H4: multi-analysis articles (optionally recent) with their full
    history as rows (newest first ``position``)."""
    since = F.date_sub(F.to_date(F.lit(as_of)), days) if days is not None else None
    cands = multi_analysis_articles(articles, history, limit, recent_from=since)
    h = history.join(cands.select(F.col("id").alias("article_id")), "article_id", "left_semi") \
        if limit is None else _scope(history, cands, limit)
    h = h.select("article_id", "created_at", "id", "credibility_score", "sentiment_score", "bias_score")
    seq = with_previous(h, ["article_id"], "created_at", "id", [])
    seq = seq.select("article_id", F.col("id").alias("analysis_id"),
                     F.col("created_at").alias("analysis_created_at"),
                     (F.col("group_size") - F.col("seq") + 1).alias("position"),
                     "credibility_score", "sentiment_score", "bias_score")
    return (cands.join(seq, cands["id"] == seq["article_id"], "inner")
            .select("id", "title", "source", "analysis_count", "analysis_id",
                    "analysis_created_at", "position", "credibility_score",
                    "sentiment_score", "bias_score"))
