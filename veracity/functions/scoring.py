"""Scoring expressions: credibility index, response decoding, normalisation,
fallback documents and the scoring prompt (E2, E4, E8-E11).

All built-in Column expressions; model responses are parsed with
``try_parse_json`` into a VARIANT so the two topic shapes (strings or
``{name, relevance}`` objects) are read without a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.text import (DEFAULT_TOPIC_QUERY, FALLBACK_TOPICS, col_of, content_preview,
                                     tag_topics)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# ---------------------------------------------------------------------------
SOURCE_WEIGHTS = {"high": 0.3, "medium": 0.2, "low": 0.1}
SOURCE_WEIGHT_DEFAULT = 0.15
CONTENT_WEIGHTS = {"evidence": 0.25, "logical_consistency": 0.2, "completeness": 0.15, "bias": 0.1}
DEFAULT_CREDIBILITY = 0.5      # score assumed by the index when the analysis has none
DEFAULT_LOGIC = 0.7
DEFAULT_COMPLETENESS = 0.6
DEFAULT_BIAS = 0.3
FALLBACK_SCORE = 0.6           # credibility of fallback / normalised documents
EMPTY_RESPONSE_ERROR = "Empty response from API"
FALLBACK_EXPLANATION = "Fallback analysis due to error: "
TEXT_EXPLANATION = "Automated credibility assessment based on text content"
NORMALIZED_EXPLANATION = "Normalized credibility score"
TEXT_KEY_POINTS = ["Main points could not be determined"]
TEXT_BIASES = ["No biases identified"]
DEFAULT_ANALYSIS_SCORE = 0.5   # the second fallback document
DEFAULT_ANALYSIS_EXPLANATION = "Default score due to analysis error: "
DEFAULT_ANALYSIS_TOPICS = ["General"]
UNKNOWN_SOURCE = "Unknown source"
NO_CONTENT = "No content provided"
PROMPT_TEMPLATE = """Analyze the following article content with focus on credibility assessment:

Article Source: {source}
Article Content Preview: {preview}

Provide analysis in JSON format with this structure:
{
    "credibility": {
        "score": <number from 0 to 1>,
        "explanation": "<brief explanation of credibility assessment>"
    },
    "topics": [
        {
            "name": "<main topic>",
            "relevance": <number from 0 to 1>
        }
    ],
    "key_points": ["<main points of the article>"],
    "potential_biases": ["<potential biases identified>"],
    "similar_articles_query": "<suggested search query for similar articles>"
}

Consider these factors for credibility assessment:
1. Source reputation and reliability
2. Evidence quality and support for claims
3. Logical consistency of arguments
4. Completeness of coverage
5. Potential conflicts of interest"""
# ---------------------------------------------------------------------------


def source_weight(level: Column | str) -> Column:
    """Base of the index: weight of the source level (case-insensitive)."""
    lv = F.lower(col_of(level))
    expr = F.when(lv == "high", SOURCE_WEIGHTS["high"])
    expr = expr.when(lv == "medium", SOURCE_WEIGHTS["medium"]).when(lv == "low", SOURCE_WEIGHTS["low"])
    return expr.otherwise(F.lit(SOURCE_WEIGHT_DEFAULT))


def credibility_index(level: Column | str, score: Column | str | None = None,
                      bias: Column | str | None = None) -> Column:
    """base(level) + 0.25*score + 0.2*0.7 + 0.15*0.6 + 0.1*(1-bias),
    clamped to [0, 1]; missing score 0.5, missing bias 0.3.  The additions
    run in the reference's order so the doubles are identical."""
    s = F.coalesce(col_of(score), F.lit(DEFAULT_CREDIBILITY)) if score is not None else F.lit(DEFAULT_CREDIBILITY)
    b = F.coalesce(col_of(bias), F.lit(DEFAULT_BIAS)) if bias is not None else F.lit(DEFAULT_BIAS)
    content = s * CONTENT_WEIGHTS["evidence"]
    content = content + F.lit(DEFAULT_LOGIC * CONTENT_WEIGHTS["logical_consistency"])
    content = content + F.lit(DEFAULT_COMPLETENESS * CONTENT_WEIGHTS["completeness"])
    content = content + (1 - b) * CONTENT_WEIGHTS["bias"]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), source_weight(level) + content))


def index_breakdown(level: Column | str, score: Column | str | None = None,
                    bias: Column | str | None = None) -> Column:
    """struct(score, source_contribution, content_contribution)."""
    idx = credibility_index(level, score, bias)
    base = source_weight(level)
    return F.struct(idx.alias("score"), base.alias("source_contribution"),
                    (idx - base).alias("content_contribution"))


def fallback_topics(n: int = 2) -> Column:
    return F.array(*[F.lit(name) for name, _ in FALLBACK_TOPICS[:n]])


def _doc(score: Column, explanation: Column, topics: Column, key_points: Column,
         biases: Column, query: Column, error: Column, outcome: str) -> Column:
    return F.struct(
        score.cast("double").alias("credibility_score"),
        explanation.alias("explanation"),
        topics.alias("topics"),
        key_points.alias("key_points"),
        biases.alias("potential_biases"),
        query.alias("similar_articles_query"),
        error.alias("error"),
        F.lit(outcome).alias("outcome"),
    )


def fallback_analysis(error: Column | str) -> Column:
    """Constant document carrying an error text."""
    e = F.lit(error) if isinstance(error, str) else error
    empty = F.array().cast("array<string>")
    return _doc(F.lit(FALLBACK_SCORE), F.concat(F.lit(FALLBACK_EXPLANATION), e), fallback_topics(),
                empty, empty, F.lit(DEFAULT_TOPIC_QUERY), e, "error_fallback")


def default_analysis(error: Column | str) -> Column:
    """E10, second variant: score 0.5 and the one topic "General"; its query is that topic."""
    e = F.lit(error) if isinstance(error, str) else error
    empty = F.array().cast("array<string>")
    topics = F.array(*[F.lit(t) for t in DEFAULT_ANALYSIS_TOPICS])
    return _doc(F.lit(DEFAULT_ANALYSIS_SCORE), F.concat(F.lit(DEFAULT_ANALYSIS_EXPLANATION), e), topics,
                empty, empty, F.array_join(topics, " OR "), e, "default")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: as the variable of a transform over one
    item.  A plain Column would be written out, and evaluated, wherever ``use`` has it, and
    a struct of such columns once more for each field that is read from it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_PERSPECTIVE = "struct<credibility:string,summary:string,key_points:array<string>>"
_SUFFIX = "_perspective"


def fold_analysis(text: Column | str) -> Column:
    """A stored document of any of the three shapes (model response, featured seed,
    flat) as one canonical struct; a field that the document lacks is NULL.

    credibility: ``credibility_score``, ``credibility.score`` or ``index_of_credibility``;
    bias: ``bias_score`` or ``bias.level``; key arguments: ``key_arguments`` or
    ``key_points``; perspectives: the ``perspectives`` map or the top-level
    ``<name>_perspective`` objects; topics: strings or objects by name, with their
    relevance where given.  Text that is no JSON object folds to all NULL.
    """
    return bound(F.try_parse_json(col_of(text)), _folded)


def _folded(v: Column) -> Column:
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(v, path, kind)
    own = F.map_filter(get("$", "map<string,variant>"), lambda k, _: k.endswith(_SUFFIX))
    own = F.transform_values(F.transform_keys(own, lambda k, _: F.substring(k, F.lit(1), F.length(k) - len(_SUFFIX))),
                             lambda _, x: F.try_variant_get(x, "$", _PERSPECTIVE))
    objects = get("$.topics", "array<variant>")
    return F.struct(
        F.coalesce(get("$.credibility_score", "double"), get("$.credibility.score", "double"),
                   get("$.index_of_credibility", "double")).alias("credibility_score"),
        get("$.sentiment_score", "double").alias("sentiment_score"),
        F.coalesce(get("$.bias_score", "double"), get("$.bias.level", "double")).alias("bias_score"),
        _topic_names(v).alias("topics"),
        F.transform(objects, lambda t: F.try_variant_get(t, "$.relevance", "double")).alias("topic_relevance"),
        F.coalesce(get("$.key_arguments", "array<string>"), get("$.key_points", "array<string>")).alias("key_arguments"),
        F.coalesce(get("$.perspectives", f"map<string,{_PERSPECTIVE}>"), F.when(F.size(own) > 0, own)).alias("perspectives"),
        get("$.summary", "string").alias("summary"),
        get("$.similar_articles_query", "string").alias("similar_articles_query"),
        get("$.news_integrity", "double").alias("news_integrity"),
        get("$.error", "string").alias("error"))


def text_fallback(text: Column) -> Column:
    """Document built from free text: score 0.6 and keyword topics."""
    return _doc(F.lit(FALLBACK_SCORE), F.lit(TEXT_EXPLANATION), tag_topics(text),
                F.array(*[F.lit(x) for x in TEXT_KEY_POINTS]), F.array(*[F.lit(x) for x in TEXT_BIASES]),
                F.lit(DEFAULT_TOPIC_QUERY), F.lit(None).cast("string"), "text_fallback")


def _topic_names(v: Column) -> Column:
    """Topic names of a parsed response: string items as is, object items
    by their ``name``."""
    items = F.try_variant_get(v, "$.topics", "array<variant>")
    return F.transform(items, lambda t: F.coalesce(
        F.try_variant_get(t, "$.name", "string"),
        F.when(F.schema_of_variant(t) == "STRING", F.try_variant_get(t, "$", "string"))))


def parsed_analysis(v: Column) -> Column:
    """E9 over a parsed response: missing credibility -> 0.6 with the
    normalisation note, missing topics -> the two fallback topics."""
    has_cred = F.try_variant_get(v, "$.credibility", "variant").isNotNull()
    has_topics = F.try_variant_get(v, "$.topics", "variant").isNotNull()
    score = F.when(has_cred, F.try_variant_get(v, "$.credibility.score", "double")).otherwise(F.lit(FALLBACK_SCORE))
    expl = F.when(has_cred, F.try_variant_get(v, "$.credibility.explanation", "string")).otherwise(
        F.lit(NORMALIZED_EXPLANATION))
    topics = F.when(has_topics, _topic_names(v)).otherwise(fallback_topics())
    return _doc(score, expl, topics,
                F.try_variant_get(v, "$.key_points", "array<string>"),
                F.try_variant_get(v, "$.potential_biases", "array<string>"),
                F.try_variant_get(v, "$.similar_articles_query", "string"),
                F.try_variant_get(v, "$.error", "string"), "parsed")


def decode_response(text: Column | str) -> Column:
    """Greedy first ``{`` to last ``}``; valid JSON -> normalised
    document; otherwise a document from the text; empty -> error fallback."""
    t = col_of(text)
    v = F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0))      # no braces: no JSON
    return F.when(t.isNull() | (t == ""), fallback_analysis(EMPTY_RESPONSE_ERROR)).otherwise(bound(v, lambda v: (
        F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), parsed_analysis(v)).otherwise(text_fallback(t)))))


def normalize_scores(credibility: Column | str, topics: Column | str) -> tuple[Column, Column]:
    """E9 on the canonical flat shape: (credibility or 0.6, topics or the
    two fallback topics)."""
    return (F.coalesce(col_of(credibility), F.lit(FALLBACK_SCORE)),
            F.coalesce(col_of(topics), fallback_topics()))


def build_prompt(content: Column | str, source: Column | str) -> Column:
    """The scoring prompt for one article (E6 preview inside)."""
    c, s = col_of(content), col_of(source)
    c = F.when(c.isNull() | (c == ""), F.lit(NO_CONTENT)).otherwise(c)
    s = F.when(s.isNull() | (s == ""), F.lit(UNKNOWN_SOURCE)).otherwise(s)
    head, rest = PROMPT_TEMPLATE.split("{source}")
    mid, tail = rest.split("{preview}")
    return F.concat(F.lit(head), s, F.lit(mid), content_preview(c), F.lit(tail))
