"""Column expressions for text, bands and tags (all JVM-side, no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# ---------------------------------------------------------------------------
# Source name fragments, checked in this order (High, then Medium, then Low).
HIGH_SOURCES = ["bbc", "reuters", "nytimes", "theguardian"]
MEDIUM_SOURCES = ["cnn", "fox", "washingtonpost"]
LOW_SOURCES = ["dailymail", "breitbart"]
# Topic keywords, topics checked in this order; a keyword matches anywhere.
TOPIC_KEYWORDS = {
    "politics": ["politic", "government", "election", "law", "policy"],
    "economy": ["economy", "market", "finance", "trade", "tax"],
    "technology": ["tech", "software", "ai", "computer", "internet"],
    "science": ["science", "research", "study", "experiment"],
    "health": ["health", "medical", "disease", "vaccine"],
}
# Topics used when no keyword matches (names and relevances).
FALLBACK_TOPICS = [("General News", 0.8), ("Politics", 0.7), ("Economy", 0.6)]
KEYWORD_RELEVANCE = 0.8
SUMMARY_LIMIT = 200
PREVIEW_MAX = 5000
PREVIEW_EDGE = 200
PREVIEW_MARKER = "\n\n[CONTENT TRIMMED FOR ANALYSIS]\n\n"
PREVIEW_DOTS = "\n\n..."
DEFAULT_TOPIC_QUERY = "general news"
# ---------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Candidate LIKE escape characters; the first one absent from a term is used so
# that the term itself has no escapes (SQLite LIKE has no escape character).
_ESCAPES = ["\u0001", "\u0002", "\u0003", "~", "^", "!"]


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Fold A-Z only, as SQLite's LIKE does (É and é stay different)."""
    return F.translate(col_of(c), _UPPER, _LOWER)


def like_pattern(term: str) -> str:
    """``%term%`` with the term's own ``%``/``_`` kept as wildcards (SQLite has
    no escape character by default) and ASCII letters folded."""
    return "%" + term.translate(str.maketrans(_UPPER, _LOWER)) + "%"


def like_ci(c: Column | str, term: str) -> Column:
    """SQLite ``c LIKE '%term%'``; NULL never matches."""
    esc = next(e for e in _ESCAPES if e not in term)
    return F.like(ascii_lower(c), F.lit(like_pattern(term)), F.lit(esc))


def like_regex(terms: list[str]) -> str:
    """One Java regex that finds any of the ``%term%`` LIKE patterns.

    ``%`` -> ``.*``, ``_`` -> ``.``, everything else literal; ``(?i)`` without
    the Unicode flag folds ASCII letters only (SQLite's LIKE), ``(?s)`` lets
    the wildcards cross newlines.
    """
    import re as _re

    def one(t: str) -> str:
        return "".join(".*" if ch == "%" else "." if ch == "_" else _re.escape(ch) for ch in t)
    return "(?is)(?:" + "|".join(one(t) for t in terms) + ")"


def any_like_ci(cols: list[Column | str], terms: list[str]) -> Column:
    """OR-fold of ``like_ci`` over every (column, term) pair: one regex scan
    per column (NULL columns do not match)."""
    if not terms:
        return F.lit(False)
    rx = like_regex(terms)
    preds = [F.coalesce(col_of(c).rlike(rx), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def bare_host(url: Column | str) -> Column:
    """Network part of a URL with every ``www.`` removed."""
    return F.replace(url_authority(url), F.lit("www."), F.lit(""))


def url_authority(url: Column | str) -> Column:
    """Network location including the port, like ``urlparse(...).netloc``."""
    return F.try_parse_url(col_of(url), F.lit("AUTHORITY"))


def source_level(source: Column | str) -> Column:
    """Credibility level of a source name or URL."""
    if isinstance(source, str):   # one SQL expression: a single JVM call to build
        low, net = f"lower(`{source}`)", f"lower(try_parse_url(`{source}`, 'AUTHORITY'))"

        def anyof(xs):
            return "(" + " OR ".join(f"contains({low}, '{x}')" for x in xs) + ")"
        return F.expr(
            f"CASE WHEN {low} IS NULL OR {low} = '' THEN 'Medium' WHEN {anyof(HIGH_SOURCES)} THEN 'High' "
            f"WHEN {anyof(MEDIUM_SOURCES)} THEN 'Medium' WHEN {anyof(LOW_SOURCES)} THEN 'Low' "
            f"WHEN (startswith({low}, 'http://') OR startswith({low}, 'https://')) "
            f"AND coalesce(endswith({net}, '.gov') OR endswith({net}, '.edu'), false) THEN 'High' "
            f"ELSE 'Medium' END")
    s = F.lower(col_of(source))
    net = F.lower(url_authority(col_of(source)))
    is_url = s.startswith("http://") | s.startswith("https://")
    return (
        F.when(s.isNull() | (s == ""), "Medium")
        .when(contains_any(s, HIGH_SOURCES), "High")
        .when(contains_any(s, MEDIUM_SOURCES), "Medium")
        .when(contains_any(s, LOW_SOURCES), "Low")
        .when(is_url & F.coalesce(net.endswith(".gov") | net.endswith(".edu"), F.lit(False)), "High")
        .otherwise("Medium")
    )


def score_band(score: Column | str) -> Column:
    """E3 (FAQ): >=0.8 High, >=0.6 Medium, else Low; NULL stays NULL."""
    s = col_of(score)
    return F.when(s >= 0.8, "High").when(s >= 0.6, "Medium").when(s.isNotNull(), "Low")


def chart_band(score: Column | str) -> Column:
    """E3 (chart colours): >0.8 High, >0.6 Medium, else Low."""
    s = col_of(score)
    return F.when(s > 0.8, "High").when(s > 0.6, "Medium").when(s.isNotNull(), "Low")


def short_summary(content: Column | str) -> Column:
    """E5: first 200 characters plus '...' when longer."""
    c = col_of(content)
    return F.when(F.length(c) > SUMMARY_LIMIT,
                  F.concat(F.substring(c, 1, SUMMARY_LIMIT), F.lit("..."))).otherwise(c)


def content_preview(content: Column | str) -> Column:
    """Text fed to scoring; a long text keeps its first 200 characters, a
    marker, 4550 characters of the middle, a dotted break and the last 200."""
    c = col_of(content)
    n = F.length(c)
    middle_len = PREVIEW_MAX - 2 * PREVIEW_EDGE - 50
    long_form = F.substring(F.concat(
        F.substring(c, 1, PREVIEW_EDGE), F.lit(PREVIEW_MARKER),
        F.substring(c, PREVIEW_EDGE + 1, middle_len), F.lit(PREVIEW_DOTS),
        F.substring(c, -PREVIEW_EDGE, PREVIEW_EDGE)), 1, PREVIEW_MAX)
    return (F.when(c.isNull() | (c == ""), F.lit("No content available"))
            .when(n <= PREVIEW_MAX, c).otherwise(long_form))


def topic_tag_string(text: Column | str) -> Column:
    """Matching topic names in topic order, comma-joined ('' when none).

    Plain ``contains`` checks under one ``concat_ws``: stays in whole-stage
    codegen (no lambda) and lowercases the text once.
    """
    if isinstance(text, str):   # one SQL expression: a single JVM call to build
        low = f"lower(`{text}`)"
        parts = ", ".join(
            "CASE WHEN " + " OR ".join(f"contains({low}, '{k}')" for k in kws) + f" THEN '{name}' END"
            for name, kws in TOPIC_KEYWORDS.items())
        return F.expr(f"concat_ws(',', {parts})")
    low = F.lower(col_of(text))
    return F.concat_ws(",", *[F.when(contains_any(low, kws), F.lit(name))
                              for name, kws in TOPIC_KEYWORDS.items()])


def tags_from_string(tag_string: Column | str) -> Column:
    """E7 result from ``topic_tag_string``: first three hits, else the two
    fallback topics (also for NULL or empty text)."""
    s = col_of(tag_string)
    fallback = F.array(*[F.lit(n) for n, _ in FALLBACK_TOPICS[:2]])
    return F.when(s == "", fallback).otherwise(F.slice(F.split(s, ","), 1, 3))


def tag_topics(text: Column | str) -> Column:
    """Up to three keyword topics, else the two fallback names."""
    return tags_from_string(topic_tag_string(text))


def with_relevance(tags: Column | str) -> Column:
    """E7 tags as (name, relevance): a fallback topic's own relevance, else that of a keyword hit."""
    known = {n: r for n, r in FALLBACK_TOPICS}

    def relevance(t: Column) -> Column:
        out = F.lit(KEYWORD_RELEVANCE)
        for n, r in known.items():
            out = F.when(t == n, F.lit(r)).otherwise(out)
        return out
    return F.transform(col_of(tags), lambda t: F.struct(t.alias("name"), relevance(t).alias("relevance")))


def with_tags(df, text_col: str, out: str = "tags"):
    """Add the E7 tags of ``text_col`` as column ``out``, scanning the text
    once (the tag string is projected first, so the optimizer does not
    duplicate the scan into every use)."""
    tmp = f"_{out}_str"
    return df.withColumn(tmp, topic_tag_string(text_col)).withColumn(out, tags_from_string(tmp)).drop(tmp)


def topic_query(topics: Column | str, query: Column | str | None = None,
                default: str = DEFAULT_TOPIC_QUERY) -> Column:
    """Stored query, else the first three topic names joined by ' OR ',
    else ``default`` ("general news"; the uncalled second variant used
    "technology")."""
    first3 = F.slice(col_of(topics), 1, 3)
    built = F.when(F.coalesce(F.size(first3), F.lit(0)) > 0, F.array_join(first3, " OR ")).otherwise(
        F.lit(default))
    if query is None:
        return built
    q = col_of(query)
    return F.when(q.isNotNull() & (q != ""), q).otherwise(built)


def level_rank(level: Column | str) -> Column:
    """High 1, Medium 2, anything else 3."""
    lv = col_of(level)
    return F.when(lv == "High", 1).when(lv == "Medium", 2).otherwise(3)


def fmt2(x: Column | str) -> Column:
    """Two-decimal text of a double, rounded half-up on its decimal value
    (identical in Spark and DuckDB; SURVEY §2.13)."""
    return F.round(col_of(x).cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string")


def round_dec(x: Column | str, digits: int) -> Column:
    """Round through DECIMAL(18,6) so both engines agree on ties."""
    return F.round(col_of(x).cast("decimal(18,6)"), digits).cast("double")


def sorted_set(arr: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col_of(arr)))


def join_set(arr: Column | str, sep: str = ",") -> Column:
    """Render an array as its sorted distinct elements joined by ``sep``."""
    return F.array_join(sorted_set(arr), sep)
