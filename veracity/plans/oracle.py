"""DuckDB oracle SQL per registered query (same keys as ``catalog.QUERIES``)."""

from __future__ import annotations

from veracity.plans.oracle_views import with_views as W

ORACLE: dict[str, str] = {}


def sql(name: str, text: str, *views: str) -> None:
    ORACLE[name] = W(text, *views)


_SCORE = "CAST(round(CAST((high * 1.0 + medium * 0.5) / NULLIF(total_analyzed, 0) AS DECIMAL(18,6)), 2) AS DOUBLE)"

sql("source_credibility_chart", f"""
SELECT source, high, medium, low, total_analyzed, {_SCORE} AS credibility_score
FROM source_stats WHERE total_analyzed > 0""", "source_stats")

sql("source_statistics", f"""
SELECT source, high, medium, low, total_analyzed AS total, {_SCORE} AS score, last_updated, is_initial
FROM source_stats WHERE total_analyzed > 0""", "source_stats")

sql("seed_source_stats", """
SELECT source, high, medium, low, total_analyzed, is_initial FROM source_stats""", "source_stats")

sql("total_sources", """
SELECT count(*) AS total_sources FROM source_stats WHERE total_analyzed > 0""", "source_stats")

sql("seed_when_empty", """
SELECT 'empty' AS "case", source, high, medium, low, high + medium + low AS total_analyzed, true AS is_initial FROM seed_stats
UNION ALL
SELECT 'kept', source, count(*) FILTER (WHERE credibility_level = 'High'), count(*) FILTER (WHERE credibility_level = 'Medium'),
  count(*) FILTER (WHERE credibility_level IS NULL OR credibility_level NOT IN ('High', 'Medium')), count(*), false
FROM articles GROUP BY source""", "source_stats")

sql("credibility_distribution", """
SELECT credibility_level, count(*) AS count,
  CAST(round(CAST(count(*) * 1.0 / (SELECT count(*) FROM articles) * 100 AS DECIMAL(18,6)), 1) AS DOUBLE) AS percentage
FROM articles GROUP BY credibility_level""", "articles")

sql("corpus_totals", """
SELECT count(*) AS total_articles, count(DISTINCT source) AS total_sources FROM articles""", "articles")


# ------------------------------------------------------------------ history
_CANDS = """,
cands AS (
  SELECT a.id, a.title, a.source, count(h.id) AS analysis_count,
    min(h.created_at) AS first_analysis_date, max(h.created_at) AS last_analysis_date
  FROM articles a JOIN analysis_history h ON a.id = h.article_id
  GROUP BY a.id, a.title, a.source HAVING count(h.id) > 1
),
ordered AS (
  SELECT h.*, row_number() OVER (PARTITION BY article_id ORDER BY created_at, id) AS rn,
    count(*) OVER (PARTITION BY article_id) AS cnt
  FROM analysis_history h
)"""

_QUALITY = _CANDS + """,
cons AS (
  SELECT article_id,
    max(abs(credibility_score - pc)) AS mc, max(abs(sentiment_score - ps)) AS ms, max(abs(bias_score - pb)) AS mb
  FROM (SELECT article_id, credibility_score, sentiment_score, bias_score,
      lag(credibility_score IGNORE NULLS) OVER w AS pc,
      lag(sentiment_score IGNORE NULLS) OVER w AS ps,
      lag(bias_score IGNORE NULLS) OVER w AS pb
    FROM analysis_history WINDOW w AS (PARTITION BY article_id ORDER BY created_at, id)) x
  GROUP BY article_id
),
first_rows AS (SELECT * FROM ordered WHERE rn = 1),
quality AS (
  SELECT c.*,
    CASE WHEN (s.mc IS NOT NULL)::INT + (s.ms IS NOT NULL)::INT + (s.mb IS NOT NULL)::INT = 0 THEN 1.0::DOUBLE
      ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE -
        ((coalesce(s.mc, 0.0::DOUBLE) + coalesce(s.ms, 0.0::DOUBLE)) + coalesce(s.mb, 0.0::DOUBLE))
        / ((s.mc IS NOT NULL)::INT + (s.ms IS NOT NULL)::INT + (s.mb IS NOT NULL)::INT))) END AS consistency,
    (((((coalesce(least(1.0::DOUBLE, len(f.perspective_keys) / 4), 0.0::DOUBLE)
      + coalesce(least(1.0::DOUBLE, len(f.key_arguments) / 5), 0.0::DOUBLE))
      + coalesce(least(1.0::DOUBLE, len(f.topics) / 5), 0.0::DOUBLE))
      + CASE WHEN f.credibility_score IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN f.sentiment_score IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
      + CASE WHEN f.bias_score IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) / 5 AS depth,
    ((f.credibility_score IS NOT NULL)::INT + (f.sentiment_score IS NOT NULL)::INT + (f.bias_score IS NOT NULL)::INT
      + (f.topics IS NOT NULL)::INT + (f.key_arguments IS NOT NULL)::INT + (f.perspective_keys IS NOT NULL)::INT
      + (f.summary IS NOT NULL)::INT) / 8 AS completeness,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE +
      (date_diff('microsecond', c.first_analysis_date, c.last_analysis_date) / 1000000.0::DOUBLE
        / 3600 / (c.analysis_count - 1)) / 24))) AS timeliness
  FROM cands c JOIN first_rows f ON f.article_id = c.id LEFT JOIN cons s ON s.article_id = c.id
),
quality2 AS (
  SELECT *, (((consistency + depth) + completeness) + timeliness) / 4 AS overall_rating FROM quality
)"""

sql("multi_analysis_articles", _CANDS + """
SELECT id, title, source, analysis_count, first_analysis_date, last_analysis_date FROM cands""",
    "articles", "analysis_history")

sql("latest_analysis", """
SELECT a.id, a.title, a.source, a.credibility_level, a.created_at, h.id AS analysis_id,
  h.created_at AS analysis_created_at, h.credibility_score AS analysis_credibility_score,
  h.sentiment_score AS analysis_sentiment_score, h.bias_score AS analysis_bias_score,
  array_to_string(list_sort(list_distinct(h.topics)), ',') AS analysis_topics
FROM articles a LEFT JOIN (
  SELECT x.* FROM analysis_history x
  JOIN (SELECT article_id, max(created_at) AS mx FROM analysis_history GROUP BY article_id) m
    ON m.article_id = x.article_id AND m.mx = x.created_at) h ON a.id = h.article_id""",
    "articles", "analysis_history")

sql("article_with_history", """
SELECT a.id, a.title, h.id AS analysis_id, h.created_at AS analysis_created_at,
  row_number() OVER (PARTITION BY h.article_id ORDER BY h.created_at DESC, h.id DESC) AS position,
  h.credibility_score AS analysis_credibility_score
FROM articles a JOIN analysis_history h ON a.id = h.article_id""", "articles", "analysis_history")

sql("analysis_counts", """
SELECT a.id, a.title, count(h.id) AS analysis_count
FROM articles a LEFT JOIN analysis_history h ON a.id = h.article_id GROUP BY a.id, a.title""",
    "articles", "analysis_history")

sql("analysis_quality", _QUALITY + """
SELECT id, title, source, analysis_count, first_analysis_date, last_analysis_date,
  consistency, depth, completeness, timeliness, overall_rating FROM quality2""",
    "articles", "analysis_history")

for _m in ("consistency", "depth", "completeness", "timeliness"):
    sql(_m, _QUALITY + f"\nSELECT id, {_m} FROM quality2", "articles", "analysis_history")


def _band(col: str, texts: tuple[str, str, str]) -> str:
    return f"CASE WHEN {col} > 0.8::DOUBLE THEN '{texts[0]}' WHEN {col} > 0.5::DOUBLE THEN '{texts[1]}' ELSE '{texts[2]}' END"


def _quality_summary_sql() -> str:
    from veracity.operators.history import QUALITY_PREFIX, QUALITY_SENTENCES
    parts = ", ".join(_band(k, t) for k, t in QUALITY_SENTENCES.items())
    return _QUALITY + f"""
SELECT id, title, source, analysis_count, overall_rating,
  '{QUALITY_PREFIX}' || concat_ws('. ', {parts}) || '.' AS quality_summary FROM quality2"""


sql("quality_summary", _quality_summary_sql(), "articles", "analysis_history")

_TRENDS = _CANDS + """,
firsts AS (
  SELECT article_id,
    count(credibility_score) AS cn,
    first(credibility_score ORDER BY created_at, id) FILTER (WHERE credibility_score IS NOT NULL) AS cf,
    last(credibility_score ORDER BY created_at, id) FILTER (WHERE credibility_score IS NOT NULL) AS cl,
    count(sentiment_score) AS sn,
    first(sentiment_score ORDER BY created_at, id) FILTER (WHERE sentiment_score IS NOT NULL) AS sf,
    last(sentiment_score ORDER BY created_at, id) FILTER (WHERE sentiment_score IS NOT NULL) AS sl,
    count(bias_score) AS bn,
    first(bias_score ORDER BY created_at, id) FILTER (WHERE bias_score IS NOT NULL) AS bf,
    last(bias_score ORDER BY created_at, id) FILTER (WHERE bias_score IS NOT NULL) AS bl
  FROM analysis_history GROUP BY article_id
),
trends AS (
  SELECT c.id, c.title, c.source, c.analysis_count,
    {cols}
  FROM cands c JOIN firsts f ON f.article_id = c.id
),
steps AS (
  SELECT article_id, rn, tset, pset,
    lag(tset) OVER w AS ptset, lag(pset) OVER w AS ppset
  FROM (SELECT article_id, created_at, id, row_number() OVER (PARTITION BY article_id ORDER BY created_at, id) AS rn,
      list_sort(list_distinct(coalesce(topics, []::VARCHAR[]))) AS tset,
      list_sort(list_distinct(coalesce(perspective_keys, []::VARCHAR[]))) AS pset
    FROM analysis_history) s
  WINDOW w AS (PARTITION BY article_id ORDER BY rn)
),
evo AS (
  SELECT article_id,
    count(*) FILTER (WHERE rn > 1 AND tset <> ptset) AS topic_changes,
    array_to_string(list_sort(list_distinct(flatten(list(tset)))), ',') AS all_topics,
    count(*) FILTER (WHERE rn > 1 AND pset <> ppset) AS perspective_changes,
    array_to_string(list_sort(list_distinct(flatten(list(pset)))), ',') AS all_perspectives
  FROM steps GROUP BY article_id
)"""


def _trend_cols() -> str:
    out = []
    for p, name, up, down in (("c", "credibility", "increasing", "decreasing"),
                              ("s", "sentiment", "more_positive", "more_negative"),
                              ("b", "bias", "increasing", "decreasing")):
        ok = f"f.{p}n >= 2"
        ch = f"CASE WHEN {ok} THEN f.{p}l - f.{p}f ELSE 0.0::DOUBLE END"
        out.append(f"""CASE WHEN {ok} AND f.{p}l - f.{p}f > 0.1::DOUBLE THEN '{up}'
      WHEN {ok} AND f.{p}l - f.{p}f < -0.1::DOUBLE THEN '{down}' ELSE 'stable' END AS {name}_trend,
    {ch} AS {name}_change,
    CASE WHEN {ok} THEN f.{p}f END AS {name}_first, CASE WHEN {ok} THEN f.{p}l END AS {name}_last,
    f.{p}n AS {name}_n""")
    return ",\n    ".join(out)


_TRENDS = _TRENDS.replace("{cols}", _trend_cols())

sql("score_trend", _TRENDS + """
SELECT id, 'credibility' AS field, credibility_n AS n_values, credibility_trend AS trend, credibility_change AS change,
  credibility_first AS first_value, credibility_last AS last_value FROM trends
UNION ALL
SELECT id, 'sentiment', sentiment_n, sentiment_trend, sentiment_change, sentiment_first, sentiment_last FROM trends
UNION ALL
SELECT id, 'bias', bias_n, bias_trend, bias_change, bias_first, bias_last FROM trends""",
    "articles", "analysis_history")

sql("topic_evolution", _TRENDS + """
SELECT c.id, c.title, c.source, c.analysis_count, e.topic_changes AS changes, e.all_topics
FROM cands c JOIN evo e ON e.article_id = c.id""", "articles", "analysis_history")

sql("perspective_evolution", _TRENDS + """
SELECT c.id, c.title, c.source, c.analysis_count, e.perspective_changes AS changes, e.all_perspectives
FROM cands c JOIN evo e ON e.article_id = c.id""", "articles", "analysis_history")

_EVO_COLS = ", ".join(f"t.{n}_{s}" for n in ("credibility", "sentiment", "bias")
                      for s in ("trend", "change", "first", "last"))

sql("analysis_evolution", _TRENDS + f"""
SELECT t.id, t.title, t.source, t.analysis_count, {_EVO_COLS},
  e.topic_changes, e.all_topics, e.perspective_changes, e.all_perspectives
FROM trends t JOIN evo e ON e.article_id = t.id""", "articles", "analysis_history")


def _fmt(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR)"


def _evolution_summary_sql() -> str:
    from veracity.operators.history import (EVOLUTION_PREFIX, EVOLUTION_SENTENCES, PERSPECTIVE_CHANGED,
                                            PERSPECTIVE_STABLE, TOPIC_CHANGED, TOPIC_STABLE, TREND_LABELS)
    parts = []
    for f, name in (("credibility_score", "credibility"), ("sentiment_score", "sentiment"),
                    ("bias_score", "bias")):
        up, down, stable = EVOLUTION_SENTENCES[f]
        lu, ld = TREND_LABELS[f]

        def render(t: str) -> str:
            t = "'" + t.replace("{f}", "' || " + _fmt(f"t.{name}_first") + " || '")
            t = t.replace("{l}", "' || " + _fmt(f"t.{name}_last") + " || '") + "'"
            return t
        parts.append(f"""CASE WHEN t.{name}_first IS NULL THEN NULL
      WHEN t.{name}_trend = '{lu}' THEN {render(up)}
      WHEN t.{name}_trend = '{ld}' THEN {render(down)} ELSE {render(stable)} END""")
    for col, ch, st in (("topic_changes", TOPIC_CHANGED, TOPIC_STABLE),
                        ("perspective_changes", PERSPECTIVE_CHANGED, PERSPECTIVE_STABLE)):
        pre, post = ch.split("{n}")
        parts.append(f"CASE WHEN e.{col} > 0 THEN '{pre}' || CAST(e.{col} AS VARCHAR) || '{post}' ELSE '{st}' END")
    return _TRENDS + f"""
SELECT t.id, t.title, t.source, t.analysis_count,
  '{EVOLUTION_PREFIX}' || concat_ws('. ', {", ".join(parts)}) || '.' AS evolution_summary
FROM trends t JOIN evo e ON e.article_id = t.id"""


sql("evolution_summary", _evolution_summary_sql(), "articles", "analysis_history")

_FIRST_LAST = _CANDS + """,
fl AS (
  SELECT c.id, c.title, c.source, c.analysis_count,
    o.credibility_score AS oc, n.credibility_score AS nc, o.sentiment_score AS os, n.sentiment_score AS ns,
    o.bias_score AS ob, n.bias_score AS nb, o.topics AS ot, n.topics AS nt,
    o.perspective_keys AS op, n.perspective_keys AS np, o.key_arguments AS oa, n.key_arguments AS na,
    o.id AS oid, n.id AS nid
  FROM cands c JOIN ordered o ON o.article_id = c.id AND o.rn = 1
  JOIN ordered n ON n.article_id = c.id AND n.rn = n.cnt
)"""


def _minus(a: str, b: str) -> str:
    return f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"


sql("analysis_comparison", _FIRST_LAST + """
SELECT id, title, source, analysis_count,
  CASE WHEN oc IS NOT NULL AND nc IS NOT NULL THEN oc END AS credibility_old,
  CASE WHEN oc IS NOT NULL AND nc IS NOT NULL THEN nc END AS credibility_new,
  nc - oc AS credibility_change,
  CASE WHEN os IS NOT NULL AND ns IS NOT NULL THEN os END AS sentiment_old,
  CASE WHEN os IS NOT NULL AND ns IS NOT NULL THEN ns END AS sentiment_new,
  ns - os AS sentiment_change,
  CASE WHEN ob IS NOT NULL AND nb IS NOT NULL THEN ob END AS bias_old,
  CASE WHEN ob IS NOT NULL AND nb IS NOT NULL THEN nb END AS bias_new,
  nb - ob AS bias_change
FROM fl""", "articles", "analysis_history")

_BOTH_T = "CASE WHEN ot IS NOT NULL AND nt IS NOT NULL THEN "
_COMMON = "list_sort(list_distinct(list_filter(ot, lambda x: list_contains(nt, x))))"
sql("topic_diff", _FIRST_LAST + f"""
SELECT id,
  {_BOTH_T} array_to_string({_minus('nt', 'ot')}, ',') END AS topics_added,
  {_BOTH_T} array_to_string({_minus('ot', 'nt')}, ',') END AS topics_removed,
  {_BOTH_T} array_to_string({_COMMON}, ',') END AS topics_common
FROM fl""", "articles", "analysis_history")

sql("perspective_diff", _FIRST_LAST + """
SELECT f.id, k.pkey AS perspective, o.pcred AS old_credibility, n.pcred AS new_credibility,
  o.psummary IS DISTINCT FROM n.psummary AS summary_changed
FROM fl f
JOIN (SELECT DISTINCT id, pkey FROM perspective_rows) k ON k.id IN (f.oid, f.nid)
LEFT JOIN perspective_rows o ON o.id = f.oid AND o.pkey = k.pkey
LEFT JOIN perspective_rows n ON n.id = f.nid AND n.pkey = k.pkey
WHERE f.op IS NOT NULL AND f.np IS NOT NULL
GROUP BY ALL""", "articles", "analysis_history", "perspective_rows")


def _comparison_summary_sql() -> str:
    from veracity.operators.history import COMPARISON_PREFIX, NO_CHANGES
    parts = []
    for o, n, name in (("oc", "nc", "credibility"), ("os", "ns", "sentiment"), ("ob", "nb", "bias")):
        parts.append(f"""CASE WHEN {o} IS NOT NULL AND {n} IS NOT NULL AND abs({n} - {o}) > 0.1::DOUBLE THEN
      'The {name} score ' || CASE WHEN {n} - {o} > 0 THEN 'increased' ELSE 'decreased' END
      || ' from ' || {_fmt(o)} || ' to ' || {_fmt(n)} END""")
    for o, n, label in (("ot", "nt", "topics"), ("op", "np", "perspectives"), ("oa", "na", "key arguments")):
        both = f"{o} IS NOT NULL AND {n} IS NOT NULL"
        parts.append(f"CASE WHEN {both} AND len({_minus(n, o)}) > 0 THEN 'Added {label}: ' || array_to_string({_minus(n, o)}, ', ') END")
        parts.append(f"CASE WHEN {both} AND len({_minus(o, n)}) > 0 THEN 'Removed {label}: ' || array_to_string({_minus(o, n)}, ', ') END")
    body = "concat_ws('. ', " + ", ".join(parts) + ")"
    return _FIRST_LAST + f"""
SELECT id, title, source, analysis_count,
  CASE WHEN {body} = '' THEN '{NO_CHANGES}' ELSE '{COMPARISON_PREFIX}' || {body} || '.' END AS comparison_summary
FROM fl"""


sql("comparison_summary", _comparison_summary_sql(), "articles", "analysis_history")

# H1 keeps the reference's self-join shape as an independent check
sql("credibility_changes", """,
lv AS (
  SELECT article_id, created_at,
    CASE WHEN credibility_score >= 0.8 THEN 'High' WHEN credibility_score >= 0.6 THEN 'Medium'
         WHEN credibility_score IS NOT NULL THEN 'Low' END AS level
  FROM analysis_history
)
SELECT DISTINCT a.id, a.title, a.source
FROM articles a JOIN lv h1 ON a.id = h1.article_id JOIN lv h2 ON a.id = h2.article_id
WHERE h1.level <> h2.level AND h1.created_at < h2.created_at""", "articles", "analysis_history")

sql("credibility_trend", """
SELECT a.id, a.title, a.source, a.credibility_level AS current_credibility, a.created_at,
  count(h.id) AS analysis_count, min(h.created_at) AS first_analysis_date, max(h.created_at) AS last_analysis_date
FROM articles a JOIN analysis_history h ON a.id = h.article_id
WHERE CAST(a.created_at AS DATE) >= DATE '2024-01-10' - INTERVAL 7 DAY
GROUP BY a.id, a.title, a.source, a.credibility_level, a.created_at HAVING count(h.id) > 1""",
    "articles", "analysis_history")


sql("credibility_history", """
SELECT a.id, h.id AS analysis_id, h.created_at AS date, a.credibility_level AS credibility,
  row_number() OVER (PARTITION BY h.article_id ORDER BY h.created_at, h.id) AS position
FROM articles a JOIN analysis_history h ON h.article_id = a.id
WHERE CAST(a.created_at AS DATE) >= DATE '2024-01-10' - INTERVAL 7 DAY
  AND a.id IN (SELECT article_id FROM analysis_history GROUP BY article_id HAVING count(*) > 1)""",
    "articles", "analysis_history")


def _multiple_sql(where: str) -> str:
    return _CANDS + f"""
SELECT c.id, c.title, c.source, c.analysis_count, o.id AS analysis_id, o.created_at AS analysis_created_at,
  o.cnt - o.rn + 1 AS position, o.credibility_score, o.sentiment_score, o.bias_score
FROM cands c JOIN ordered o ON o.article_id = c.id
JOIN articles a ON a.id = c.id {where}"""


sql("multiple_analyses", _multiple_sql(""), "articles", "analysis_history")
sql("analysis_complexity", _multiple_sql(""), "articles", "analysis_history")
sql("analysis_trends", _multiple_sql("WHERE CAST(a.created_at AS DATE) >= DATE '2024-01-10' - INTERVAL 7 DAY"),
    "articles", "analysis_history")

for _kind, _col in (("topic", "t"), ("perspective", "p")):
    sql(f"{_kind}_change_steps", _TRENDS + f""",
ids AS (SELECT id AS aid, created_at, article_id FROM analysis_history),
st AS (
  SELECT s.article_id, s.rn, {_col}set AS cur, pt AS prev
  FROM (SELECT *, ptset AS pt FROM steps) s WHERE '{_col}' = 't'
  UNION ALL
  SELECT s.article_id, s.rn, pset, ppset FROM steps s WHERE '{_col}' = 'p'
),
numbered AS (
  SELECT h.id AS analysis_id, h.article_id, h.created_at,
    row_number() OVER (PARTITION BY h.article_id ORDER BY h.created_at, h.id) AS rn
  FROM analysis_history h
)
SELECT c.id, n.analysis_id, n.created_at AS date,
  array_to_string({_minus('st.cur', 'st.prev')}, ',') AS added,
  array_to_string({_minus('st.prev', 'st.cur')}, ',') AS removed
FROM cands c JOIN st ON st.article_id = c.id
JOIN numbered n ON n.article_id = st.article_id AND n.rn = st.rn
WHERE st.rn > 1 AND st.cur <> st.prev""", "articles", "analysis_history")



# ------------------------------------------------------------------ lookups
def _like(col: str, term: str) -> str:
    """SQLite LIKE '%term%': ASCII-only case folding, % and _ wildcards."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = term.translate(str.maketrans(up, low)).replace("'", "''")
    return f"(translate({col}, '{up}', '{low}') LIKE '%{folded}%')"


def _any_like(cols: list[str], terms: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce({_like(c, t)}, false)" for t in terms for c in cols) + ")"


_LATEST = """,
lat AS (
  SELECT x.article_id, x.id AS analysis_id, x.created_at AS analysis_created_at,
    x.credibility_score AS analysis_credibility_score
  FROM analysis_history x JOIN (SELECT article_id, max(created_at) AS mx FROM analysis_history GROUP BY article_id) m
    ON m.article_id = x.article_id AND m.mx = x.created_at
),
cnt AS (SELECT article_id, count(*) AS analysis_count FROM analysis_history GROUP BY article_id)"""

_PAGE_COLS = "c.id, c.title, c.source, c.short_summary, c.credibility_level, c.url, c.created_at, c.updated_at"


def _page_sql(where: str, order: str, limit: int, offset: int = 0, extra: str = "",
              drop_source: bool = False, extra_names: tuple[str, ...] = ()) -> str:
    cols = _PAGE_COLS.replace("c.source, ", "") if drop_source else _PAGE_COLS
    more = "".join(f", c.{n}" for n in extra_names)
    return _LATEST + f""",
cand AS (SELECT *{extra} FROM articles WHERE {where})
SELECT {cols}{more},
  l.analysis_id, l.analysis_created_at, l.analysis_credibility_score,
  coalesce(n.analysis_count, 0) AS analysis_count
FROM cand c LEFT JOIN lat l ON l.article_id = c.id LEFT JOIN cnt n ON n.article_id = c.id
ORDER BY {order}, l.analysis_id NULLS FIRST LIMIT {limit} OFFSET {offset}"""


def _info_sql(where: str, limit: int, offset: int) -> str:
    return f"""
SELECT count(*) AS total, {limit} AS "limit", {offset} AS "offset", {offset + limit} < count(*) AS has_more
FROM articles WHERE {where}"""


_NEWEST = "c.created_at DESC, c.id"


def _lookup_sql():
    from veracity.plans import catalog as C
    out = {}
    out["article_exists"] = """,
keys AS (
  SELECT 'page:' || CAST(page_id AS VARCHAR) AS key_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url FROM pages
  UNION ALL
  SELECT 'bench:' || CAST(item_id AS VARCHAR), substring(text, 1, 60), CAST(NULL AS VARCHAR) FROM benchmark
),
k AS (SELECT key_id, nullif(title, '') AS title, nullif(url, '') AS url FROM keys)
SELECT key_id, title, url,
  EXISTS (SELECT 1 FROM articles a WHERE a.title = k.title) OR EXISTS (SELECT 1 FROM articles a WHERE a.url = k.url) AS "exists"
FROM k"""
    hist_rows = """
SELECT a.id, a.title, h.id AS analysis_id, h.created_at AS analysis_created_at,
  row_number() OVER (PARTITION BY h.article_id ORDER BY h.created_at DESC, h.id DESC) AS position
FROM articles a JOIN analysis_history h ON h.article_id = a.id WHERE {cond}"""
    out["article_by_id"] = hist_rows.format(cond="a.id IN (SELECT doc_id FROM labels)")
    out["article_by_url"] = hist_rows.format(
        cond="a.id IN (SELECT min(id) FROM articles WHERE url IN (SELECT url FROM pages WHERE url <> '') GROUP BY url)")
    out["daily_buzz"] = hist_rows.format(
        cond="a.id = (SELECT id FROM articles WHERE is_featured ORDER BY created_at DESC, id LIMIT 1)")
    out["article_history"] = """
SELECT id, article_id, created_at,
  row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS position, credibility_score
FROM analysis_history WHERE article_id IN (SELECT doc_id FROM labels)"""
    out["articles_by_source"] = _page_sql("source = 'src3'", _NEWEST, 10, drop_source=True)
    recent = f"CAST(created_at AS DATE) >= DATE '{C.AS_OF}' - INTERVAL 7 DAY"
    out["recent_articles"] = _page_sql(recent, _NEWEST, 10)
    fa = C.FILTER_ARGS
    fw = (f"source = '{fa['source']}' AND credibility_level = '{fa['level']}' AND created_at >= TIMESTAMP '{fa['date_from']}'"
          f" AND created_at <= TIMESTAMP '{fa['date_to']}'")
    out["filter_articles"] = _page_sql(fw, _NEWEST, fa["limit"], fa["offset"])
    out["filter_articles_info"] = _info_sql(fw, fa["limit"], fa["offset"])
    ra = C.RANGE_ARGS
    rw = f"created_at BETWEEN TIMESTAMP '{ra['start']}' AND TIMESTAMP '{ra['end']}'"
    out["articles_in_range"] = _page_sql(rw, _NEWEST, ra["limit"], ra["offset"])
    out["articles_in_range_info"] = _info_sql(rw, ra["limit"], ra["offset"])
    out["history_page"] = _page_sql("true", _NEWEST, 10, 20)
    out["page_info"] = _info_sql("true", 10, 20)
    out["article_page"] = "\nSELECT id, title, created_at FROM articles ORDER BY created_at DESC, id LIMIT 10 OFFSET 30"
    half = "(SELECT count(*) // 2 FROM articles)"
    out["article_page_deep"] = out["article_page"].replace("OFFSET 30", f"OFFSET {half}")
    out["history_page_deep"] = _page_sql("true", _NEWEST, 10, half)
    t = C.SEARCH_TERM
    search_where = _any_like(["title", "short_summary", "content"], [t])
    rank = (f", CASE WHEN coalesce({_like('title', t)}, false) THEN 1 WHEN coalesce({_like('short_summary', t)}, false)"
            f" THEN 2 ELSE 3 END AS match_rank, CASE credibility_level WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"
            f" AS level_rank")
    out["search_articles"] = _page_sql(search_where, "c.match_rank, c.level_rank, " + _NEWEST, 10, extra=rank,
                                       extra_names=("match_rank", "level_rank"))
    sim_where = (_any_like(["short_summary", "content"], C.SIMILAR_TOPICS)
                 + " AND credibility_level IN ('High', 'Medium')")
    lrank = ", CASE credibility_level WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS level_rank"
    out["similar_articles"] = _page_sql(sim_where, "c.level_rank, " + _NEWEST, 5, extra=lrank,
                                        extra_names=("level_rank",))
    tw = _any_like(["short_summary", "content"], C.TOPIC_TERMS)
    out["articles_with_topics"] = _page_sql(tw, _NEWEST, 10, 10)
    out["articles_with_topics_info"] = _info_sql(tw, 10, 10)
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out["similar_by_text"] = f""",
txt AS (SELECT id, created_at, {fold.format("concat_ws(chr(10), title, short_summary, content)")} AS t,
  regexp_extract_all({fold.format("title")}, '[a-z]{{6,}}')[1:2] AS q FROM articles),
asked AS (SELECT DISTINCT id, unnest(q) AS term FROM txt),
held AS MATERIALIZED (SELECT term, txt.id, created_at FROM (SELECT DISTINCT term FROM asked) JOIN txt ON contains(t, term)),
hit AS (SELECT DISTINCT asked.id, held.id AS similar_id, held.created_at FROM asked JOIN held USING (term) WHERE held.id <> asked.id),
placed AS (SELECT id, similar_id, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, similar_id) AS rank FROM hit)
SELECT id, rank, similar_id FROM placed WHERE rank <= 3"""
    out["similar_for_all"] = f""",
tagged AS (SELECT id, created_at, {tags_sql('content')} AS tags FROM articles),
q AS (SELECT id, list_distinct(tags[1:3]) AS qt FROM tagged),
pairs AS (
  SELECT q.id, t.id AS similar_id, t.created_at AS similar_created_at,
    len(list_intersect(q.qt, list_distinct(t.tags))) AS shared_topics
  FROM q JOIN tagged t ON t.id <> q.id AND len(list_intersect(q.qt, t.tags)) > 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similar_created_at DESC, similar_id) AS rank FROM pairs)
SELECT id, rank, similar_id, shared_topics FROM ranked WHERE rank <= 3"""
    return out


def tags_sql(col: str) -> str:
    """E7 in SQL: first three keyword topics, else the two fallback names."""
    from veracity.functions.text import FALLBACK_TOPICS, TOPIC_KEYWORDS
    low = f"lower({col})"
    hits = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({low}, '{k}')" for k in kws) + f" THEN '{name}' END"
        for name, kws in TOPIC_KEYWORDS.items())
    fb = "[" + ", ".join(f"'{n}'" for n, _ in FALLBACK_TOPICS[:2]) + "]"
    arr = f"list_filter([{hits}], lambda x: x IS NOT NULL)"
    return f"(CASE WHEN {col} IS NULL OR {col} = '' OR len({arr}) = 0 THEN {fb} ELSE {arr}[1:3] END)"


for _k, _v in _lookup_sql().items():
    sql(_k, _v, "articles", "analysis_history")


# ------------------------------------------------------------------ scoring / text
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def source_level_sql(col: str) -> str:
    from veracity.functions.text import HIGH_SOURCES, LOW_SOURCES, MEDIUM_SOURCES
    low = f"lower({col})"

    def anyof(xs):
        return "(" + " OR ".join(f"contains({low}, '{x}')" for x in xs) + ")"
    net = f"regexp_extract({low}, '^https?://([^/?#]*)', 1)"
    return (f"(CASE WHEN {col} IS NULL OR {col} = '' THEN 'Medium' WHEN {anyof(HIGH_SOURCES)} THEN 'High' "
            f"WHEN {anyof(MEDIUM_SOURCES)} THEN 'Medium' WHEN {anyof(LOW_SOURCES)} THEN 'Low' "
            f"WHEN ({low} LIKE 'http://%' OR {low} LIKE 'https://%') AND ({net} LIKE '%.gov' OR {net} LIKE '%.edu') "
            f"THEN 'High' ELSE 'Medium' END)")


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def weight_sql(level: str) -> str:
    from veracity.functions.scoring import SOURCE_WEIGHT_DEFAULT, SOURCE_WEIGHTS
    whens = " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in SOURCE_WEIGHTS.items())
    return f"(CASE lower({level}) {whens} ELSE {_d(SOURCE_WEIGHT_DEFAULT)} END)"


def index_sql(level: str, score: str, bias: str) -> str:
    from veracity.functions import scoring as S
    w = S.CONTENT_WEIGHTS
    content = (f"((((coalesce({score}, {_d(S.DEFAULT_CREDIBILITY)}) * {_d(w['evidence'])})"
               f" + ({_d(S.DEFAULT_LOGIC)} * {_d(w['logical_consistency'])}))"
               f" + ({_d(S.DEFAULT_COMPLETENESS)} * {_d(w['completeness'])}))"
               f" + ((1 - coalesce({bias}, {_d(S.DEFAULT_BIAS)})) * {_d(w['bias'])}))")
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {weight_sql(level)} + {content}))"


def preview_sql(col: str) -> str:
    nl2 = "chr(10) || chr(10)"
    return (f"(CASE WHEN {col} IS NULL OR {col} = '' THEN 'No content available' "
            f"WHEN length({col}) <= 5000 THEN {col} ELSE substring(substring({col}, 1, 200) || {nl2} || "
            f"'[CONTENT TRIMMED FOR ANALYSIS]' || {nl2} || substring({col}, 201, 4550) || {nl2} || '...' || "
            f"right({col}, 200), 1, 5000) END)")


def _scoring_sql():
    from veracity.functions import scoring as S
    out = {}
    out["source_level"] = f"""
SELECT id, source, url, {source_level_sql('source')} AS level_by_source, {source_level_sql('url')} AS level_by_url
FROM articles"""
    out["score_band"] = """
SELECT id, credibility_score,
  CASE WHEN credibility_score >= 0.8 THEN 'High' WHEN credibility_score >= 0.6 THEN 'Medium'
       WHEN credibility_score IS NOT NULL THEN 'Low' END AS faq_band,
  CASE WHEN credibility_score > 0.8 THEN 'High' WHEN credibility_score > 0.6 THEN 'Medium'
       WHEN credibility_score IS NOT NULL THEN 'Low' END AS chart_band
FROM analysis_history"""
    lv = source_level_sql("a.source")
    out["credibility_index"] = f"""
SELECT h.id AS analysis_id, h.article_id, {lv} AS source_credibility,
  {index_sql(lv, 'h.credibility_score', 'h.bias_score')} AS credibility_index,
  {weight_sql(lv)} AS source_contribution,
  {index_sql(lv, 'h.credibility_score', 'h.bias_score')} - {weight_sql(lv)} AS content_contribution
FROM analysis_history h JOIN articles a ON a.id = h.article_id"""
    out["short_summary"] = "\nSELECT id, short_summary FROM articles"
    out["content_preview"] = f"\nSELECT id, {preview_sql('content')} AS content_preview FROM articles"
    out["tag_topics"] = f"\nSELECT id, array_to_string({tags_sql('content')}, ',') AS topics FROM articles"
    out["topic_counts"] = f"""
SELECT topic, count(*) AS articles FROM (SELECT unnest({tags_sql('content')}) AS topic FROM articles) t GROUP BY topic"""
    q3 = "topics[1:3]"
    out["build_topic_query"] = f"""
SELECT id, CASE WHEN coalesce(len({q3}), 0) > 0 THEN array_to_string({q3}, ' OR ') ELSE 'general news' END AS query
FROM analysis_history"""
    out["host_counts"] = """
SELECT replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') AS host, count(*) AS pages
FROM pages GROUP BY 1"""
    out["normalize_analysis"] = """
SELECT id, coalesce(credibility_score, 0.6::DOUBLE) AS credibility_score,
  array_to_string(coalesce(topics, ['General News', 'Politics']), ',') AS topics
FROM analysis_history"""
    found = "regexp_extract(text, '(?s)\\{.*\\}', 0)"
    ok = f"(json_valid(nullif({found}, '')) AND json_type(nullif({found}, '')) = 'OBJECT')"
    j = f"nullif({found}, '')"
    names = (f"list_transform(CAST(json_extract({j}, '$.topics') AS JSON[]), lambda t: coalesce("
             f"json_extract_string(t, '$.name'), CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') END))")
    tp = f"array_to_string({tags_sql('text')}, ',')"
    out["source_level_by_host"] = f"""
SELECT page_id, source, {source_level_sql('source')} AS level FROM (
  SELECT page_id, CASE WHEN page_id % 9 = 8 THEN host ELSE 'https://' || host || '/' || CAST(page_id AS VARCHAR) END AS source
  FROM (SELECT page_id, ['www.bbc.com', 'reuters.com', 'edition.cnn.com', 'www.dailymail.co.uk', 'data.agency.gov',
    'lab.college.edu', 'plain.example.org', 'breitbart.com'][page_id % 8 + 1] AS host FROM pages))"""
    out["decode_stored_documents"] = f"""
SELECT id, CASE WHEN id % 3 = 0 THEN credibility_score ELSE 0.6::DOUBLE END AS credibility_score,
  CASE WHEN id % 3 = 0 THEN 'stored' ELSE {_q(S.NORMALIZED_EXPLANATION)} END AS explanation,
  CASE WHEN topics IS NULL THEN 'General News,Politics' ELSE array_to_string(topics, ',') END AS topics,
  CASE WHEN id % 3 = 0 THEN array_to_string(key_arguments, '|') END AS key_points,
  CASE WHEN id % 3 = 0 THEN array_to_string(topics[1:3], ' OR ') END AS similar_articles_query,
  CAST(NULL AS VARCHAR) AS error, 'parsed' AS outcome
FROM analysis_history"""
    out["fold_analysis"] = """
SELECT id, credibility_score, CASE WHEN id % 3 <> 0 THEN sentiment_score END AS sentiment_score, bias_score,
  array_to_string(topics, ',') AS topics, CASE WHEN id % 3 = 0 AND topics IS NOT NULL THEN 0.8::DOUBLE END AS top_relevance,
  array_to_string(key_arguments, ',') AS key_arguments,
  CASE WHEN id % 3 <> 0 THEN array_to_string(list_sort(perspective_keys), ',') END AS perspectives,
  CASE WHEN id % 3 <> 0 AND list_contains(perspective_keys, 'western') THEN 'western:' || CAST(k % 3 AS VARCHAR) END
    AS western_summary,
  CASE WHEN id % 3 = 0 THEN array_to_string(topics[1:3], ' OR ') END AS similar_articles_query,
  CASE WHEN id % 3 = 1 THEN 0.85::DOUBLE END AS news_integrity
FROM analysis_history"""
    out["topic_relevance"] = f"""
SELECT id, name, CASE WHEN name = 'Politics' THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS relevance
FROM (SELECT id, unnest({tags_sql('content')}) AS name FROM articles)"""
    out["default_documents"] = f"""
SELECT page_id, 0.5::DOUBLE AS credibility_score, 'Default score due to analysis error: ' || url AS explanation,
  'General' AS topics, 'General' AS similar_articles_query, url AS error, 'default' AS outcome FROM pages"""
    out["decode_response"] = f"""
SELECT conv_id, turn,
  CASE WHEN text IS NULL OR text = '' THEN {_d(S.FALLBACK_SCORE)}
       WHEN {ok} THEN CASE WHEN json_extract({j}, '$.credibility') IS NOT NULL
         THEN CAST(json_extract({j}, '$.credibility.score') AS DOUBLE) ELSE {_d(S.FALLBACK_SCORE)} END
       ELSE {_d(S.FALLBACK_SCORE)} END AS credibility_score,
  CASE WHEN text IS NULL OR text = '' THEN {_q(S.FALLBACK_EXPLANATION + S.EMPTY_RESPONSE_ERROR)}
       WHEN {ok} THEN CASE WHEN json_extract({j}, '$.credibility') IS NOT NULL
         THEN json_extract_string({j}, '$.credibility.explanation') ELSE {_q(S.NORMALIZED_EXPLANATION)} END
       ELSE {_q(S.TEXT_EXPLANATION)} END AS explanation,
  CASE WHEN text IS NULL OR text = '' THEN 'General News,Politics'
       WHEN {ok} THEN CASE WHEN json_extract({j}, '$.topics') IS NOT NULL THEN array_to_string({names}, ',')
         ELSE 'General News,Politics' END
       ELSE {tp} END AS topics,
  CASE WHEN text IS NULL OR text = '' THEN ''
       WHEN {ok} THEN array_to_string(CAST(json_extract({j}, '$.key_points') AS VARCHAR[]), '|')
       ELSE {_q('|'.join(S.TEXT_KEY_POINTS))} END AS key_points,
  CASE WHEN {ok} AND NOT (text IS NULL OR text = '') THEN json_extract_string({j}, '$.similar_articles_query')
       ELSE 'general news' END AS similar_articles_query,
  CASE WHEN text IS NULL OR text = '' THEN {_q(S.EMPTY_RESPONSE_ERROR)}
       WHEN {ok} THEN json_extract_string({j}, '$.error') END AS error,
  CASE WHEN text IS NULL OR text = '' THEN 'error_fallback' WHEN {ok} THEN 'parsed' ELSE 'text_fallback' END AS outcome
FROM conversations WHERE role = 'assistant'"""
    head, rest = S.PROMPT_TEMPLATE.split("{source}")
    mid, tail = rest.split("{preview}")
    src = f"CASE WHEN source IS NULL OR source = '' THEN {_q(S.UNKNOWN_SOURCE)} ELSE source END"
    cnt = f"CASE WHEN content IS NULL OR content = '' THEN {_q(S.NO_CONTENT)} ELSE content END"
    out["build_prompt"] = f"""
SELECT id, {_q(head)} || ({src}) || {_q(mid)} || {preview_sql('(' + cnt + ')')} || {_q(tail)} AS prompt
FROM articles"""
    lv = source_level_sql("a.source")
    cred = f"CASE WHEN l.analysis_id IS NOT NULL THEN coalesce(l.cs, {_d(S.FALLBACK_SCORE)}) ELSE {_d(S.FALLBACK_SCORE)} END"
    bias = "CASE WHEN l.analysis_id IS NOT NULL THEN l.bs END"
    topics = f"CASE WHEN l.analysis_id IS NOT NULL THEN coalesce(l.tp, ['General News', 'Politics']) ELSE {tags_sql('a.content')} END"
    idx = index_sql(lv, cred, bias)
    out["analyze_articles"] = f""",
lat AS (
  SELECT article_id, id AS analysis_id, credibility_score AS cs, bias_score AS bs, topics AS tp
  FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn
        FROM analysis_history) x WHERE rn = 1
)
SELECT a.id, {lv} AS source_credibility, l.analysis_id IS NOT NULL AS from_history,
  {cred} AS credibility_score, {idx} AS credibility_index, {weight_sql(lv)} AS source_contribution,
  {idx} - {weight_sql(lv)} AS content_contribution,
  CASE WHEN length(a.content) > 200 THEN substring(a.content, 1, 200) || '...' ELSE a.content END AS short_summary,
  CASE WHEN coalesce(len(({topics})[1:3]), 0) > 0 THEN array_to_string(({topics})[1:3], ' OR ') ELSE 'general news' END
    AS similar_query
FROM articles a LEFT JOIN lat l ON l.article_id = a.id"""
    return out


for _k, _v in _scoring_sql().items():
    sql(_k, _v, "articles", "analysis_history")


def _analysis_sql() -> dict[str, str]:
    """Q4 and E13 by the stored documents, written from what the documents hold."""
    from veracity.functions import scoring as S
    base = f""",
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn
                       FROM analysis_history) x WHERE rn = 1),
own AS (
  SELECT a.id, a.source, a.created_at, a.content, l.id AS doc, l.credibility_score AS cs, {tags_sql('a.content')} AS tags,
    CASE WHEN l.id IS NULL THEN {tags_sql('a.content')} ELSE coalesce(l.topics, ['General News', 'Politics']) END AS topics,
    l.key_arguments
  FROM articles a LEFT JOIN lat l ON l.article_id = a.id),
q AS (SELECT *, list_distinct(list_transform(topics[1:3], lambda x: lower(x))) AS qt,
        list_distinct(list_transform(tags, lambda x: lower(x))) AS lt FROM own),
pairs AS (SELECT q.id, t.id AS similar_id, t.created_at AS similar_at, len(list_intersect(q.qt, t.lt)) AS shared_topics
          FROM q JOIN q t ON t.id <> q.id AND len(list_intersect(q.qt, t.lt)) > 0),
ranked AS (SELECT id, similar_id, shared_topics, row_number() OVER (PARTITION BY id ORDER BY similar_at DESC, similar_id) AS rank
           FROM pairs)"""
    cred = f"CASE WHEN q.doc IS NULL THEN {_d(S.FALLBACK_SCORE)} ELSE coalesce(q.cs, {_d(S.FALLBACK_SCORE)}) END"
    return {
        "similar_by_analysis": base + """
SELECT id, rank, similar_id, shared_topics FROM ranked WHERE rank <= 3""",
        "analyze_with_documents": base + f"""
SELECT q.id, {source_level_sql('q.source')} AS source_credibility, {cred} AS credibility_score,
  array_to_string(q.topics[1:3], ' OR ') AS similar_query, array_to_string(q.topics, ',') AS topics,
  CASE WHEN q.doc IS NULL THEN {_q('|'.join(S.TEXT_KEY_POINTS))} ELSE array_to_string(q.key_arguments, '|') END AS key_points,
  CASE WHEN q.doc IS NULL THEN {_q('|'.join(S.TEXT_BIASES))} WHEN q.doc % 3 = 0 THEN '' END AS potential_biases,
  coalesce((SELECT string_agg(CAST(r.similar_id AS VARCHAR), ',' ORDER BY r.rank) FROM ranked r
            WHERE r.id = q.id AND r.rank <= 3), '') AS similar_ids
FROM q"""}


for _k, _v in _analysis_sql().items():
    sql(_k, _v, "articles", "analysis_history")


# ------------------------------------------------------------------ store
def host_sql(col: str) -> str:
    return f"replace(regexp_extract({col}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


# The text of a page by regular expressions: enough for the fixture's regular pages,
# and nothing of the parser that the engine uses.
_BLOCK = ("</?(?:address|article|aside|blockquote|div|dl|fieldset|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|"
          "section|table|ul)\\b")


def _plain(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "chr(160)")):
        out = f"replace({out}, '{entity}', {char})"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


PAGE_TEXT = f"""page_article AS (
  SELECT page_id, url, html LIKE '%<article%' AS found,
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1),
      '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)\\b.*?</(script|style)>', '', 'g') AS art FROM pages
),
page_parts AS (SELECT *, string_split(art, '<p>')[2:] AS parts FROM page_article),
page_cut AS (
  SELECT *, [regexp_extract(x, '(?s)^(.*?)(?:{_BLOCK}|$)', 1) for x in parts] AS paras,
    regexp_extract(art, '(?s)<h1>(.*?)(?:</h1>|$)', 1) AS h1 FROM page_parts
),
page_text AS (
  SELECT page_id, url, regexp_matches(url, '^[A-Za-z]+://[^/?#]+') AS valid, found,
    CASE WHEN valid AND found THEN {_plain("array_to_string(paras, ' ')")} END AS text,
    CASE WHEN valid THEN replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), 'www.', '') END AS host,
    CASE WHEN valid AND art LIKE '%<h1>%' THEN {_plain('h1')} WHEN valid THEN 'No title available' END AS title,
    CASE WHEN NOT valid THEN 'Invalid URL format' WHEN NOT found THEN 'Failed to extract content' END AS error
  FROM page_cut
)"""

ORACLE["extract_pages"] = f"WITH {PAGE_TEXT}\nSELECT page_id, url, text, host, title, error FROM page_text"
ORACLE["page_extraction_report"] = f"""WITH {PAGE_TEXT}
SELECT coalesce(host, url) AS host, count(*) AS pages, count(error) AS failures, avg(length(text)) AS mean_text_length
FROM page_text GROUP BY 1"""

_PERSPECTIVE_JSON = """'{' || array_to_string([
  '"' || x || '":{' || concat_ws(',', CASE WHEN credibility_score >= 0.8 THEN '"credibility":"High"'
    WHEN credibility_score >= 0.6 THEN '"credibility":"Medium"'
    WHEN credibility_score IS NOT NULL THEN '"credibility":"Low"' END,
    '"summary":"' || x || ':' || CAST(k % 3 AS VARCHAR) || '"', '"key_points":[]') || '}'
  for x in perspective_keys], ',') || '}'"""
sql("encode_analysis", f"""
SELECT id, '{{' || concat_ws(',',
  '"credibility_score":' || CAST(credibility_score AS VARCHAR), '"sentiment_score":' || CAST(sentiment_score AS VARCHAR),
  '"bias_score":' || CAST(bias_score AS VARCHAR),
  '"topics":["' || array_to_string(topics, '","') || '"]', '"key_arguments":["' || array_to_string(key_arguments, '","') || '"]',
  CASE WHEN perspective_keys IS NOT NULL THEN '"perspectives":' || {_PERSPECTIVE_JSON} END) || '}}' AS analysis_data
FROM analysis_history""", "analysis_history")


def _store_sql():
    from veracity.plans import catalog as C
    now = f"TIMESTAMP '{C.NOW}'"
    batch = f""",
{PAGE_TEXT},
batch AS (
  SELECT page_id AS seq, title, {host_sql('url')} AS source, url, coalesce(text, title) AS content,
    {source_level_sql('url')} AS credibility_level, false AS is_featured FROM page_text
  UNION ALL
  SELECT 1000000000 + item_id, substring(text, 1, 60), 'benchmark', CAST(NULL AS VARCHAR), text, 'Medium', false
  FROM benchmark
  UNION ALL
  SELECT 2000000000 + conv_id * 1000 + turn, substring(text, 1, 60), '{C.TALK_HOST}',
    'https://{C.TALK_HOST}/' || CAST(conv_id % 50 AS VARCHAR), text, 'Low', false
  FROM conversations
),
b AS (SELECT *, nullif(url, '') AS k FROM batch),
existing AS (SELECT url AS k, min(id) AS eid FROM articles WHERE url IS NOT NULL AND url <> '' GROUP BY url),
per_url AS (
  SELECT b.k, min(b.seq) AS first_seq, max(b.seq) AS last_seq, any_value(e.eid) AS eid
  FROM b LEFT JOIN existing e ON e.k = b.k WHERE b.k IS NOT NULL GROUP BY b.k
),
creators AS (SELECT k, first_seq AS seq FROM per_url WHERE eid IS NULL UNION ALL SELECT k, seq FROM b WHERE k IS NULL),
new_ids AS (SELECT k, seq, (SELECT coalesce(max(id), 0) FROM articles) + row_number() OVER (ORDER BY seq) AS nid
            FROM creators),
resolved AS (
  SELECT b.*, coalesce(p.eid, nu.nid, nb.nid) AS article_id,
    (b.k IS NULL OR p.eid IS NULL) AS created_in_batch, (b.k IS NULL OR b.seq = p.last_seq) AS is_last
  FROM b LEFT JOIN per_url p ON p.k = b.k
  LEFT JOIN new_ids nu ON nu.k = b.k AND b.k IS NOT NULL
  LEFT JOIN new_ids nb ON nb.seq = b.seq AND b.k IS NULL
),
last_rows AS (SELECT * FROM resolved WHERE is_last)"""
    def doc_score(t):
        return (f"CASE WHEN {t}credibility_level = 'High' THEN 0.9::DOUBLE WHEN {t}credibility_level = 'Medium' THEN 0.6::DOUBLE "
                "ELSE 0.3::DOUBLE END")

    def doc_topics(t):
        return f"array_to_string({tags_sql(t + 'content')}, ',')"
    summ = "CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END"
    out = {}
    out["upsert_articles"] = batch + f"""
SELECT a.id, CASE WHEN u.article_id IS NULL THEN a.title ELSE u.title END AS title,
  CASE WHEN u.article_id IS NULL THEN a.source ELSE u.source END AS source, a.url,
  CASE WHEN u.article_id IS NULL THEN a.short_summary ELSE
    (CASE WHEN length(u.content) > 200 THEN substring(u.content, 1, 200) || '...' ELSE u.content END) END AS short_summary,
  CASE WHEN u.article_id IS NULL THEN a.credibility_level ELSE u.credibility_level END AS credibility_level,
  a.created_at, CASE WHEN u.article_id IS NULL THEN a.updated_at ELSE {now} END AS updated_at,
  CASE WHEN u.article_id IS NULL THEN a.is_featured ELSE u.is_featured END AS is_featured,
  CASE WHEN u.article_id IS NOT NULL THEN {doc_score('u.')} END AS credibility_score,
  CASE WHEN u.article_id IS NOT NULL THEN {doc_topics('u.')} END AS topics
FROM articles a LEFT JOIN (SELECT * FROM last_rows WHERE NOT created_in_batch) u ON u.article_id = a.id
UNION ALL
SELECT article_id, title, source, url, {summ}, credibility_level, {now}, {now}, is_featured,
  {doc_score('')}, {doc_topics('')}
FROM last_rows WHERE created_in_batch"""
    out["append_history"] = batch + f"""
SELECT (SELECT max(id) FROM analysis_history) + row_number() OVER (ORDER BY seq) AS id, article_id,
  {now} AS created_at, {doc_score('')} AS credibility_score, {doc_topics('')} AS topics
FROM resolved"""
    patch = """,
patch AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Low' END AS lvl,
  CASE WHEN quality = 1 AND toxic = 0 THEN true END AS feat, quality = 0 AS reviewed FROM labels),
updated AS (
  SELECT a.id, a.source, a.credibility_level AS old_level, coalesce(p.lvl, a.credibility_level) AS credibility_level,
    coalesce(p.feat, a.is_featured) AS is_featured,
    coalesce(p.lvl IS NOT NULL OR p.feat IS NOT NULL OR p.reviewed, false) AS was_updated,
    CASE WHEN was_updated THEN """ + now + """ ELSE a.updated_at END AS updated_at,
    CASE WHEN p.reviewed THEN 0.2::DOUBLE END AS credibility_score, CASE WHEN p.reviewed THEN 'review' END AS topics
  FROM articles a LEFT JOIN patch p ON p.id = a.id
)"""
    out["update_articles"] = patch + """
SELECT id, source, credibility_level, is_featured, updated_at, was_updated, credibility_score, topics FROM updated"""
    out["history_from_update"] = f"""
SELECT (SELECT max(id) FROM analysis_history) + row_number() OVER (ORDER BY l.doc_id) AS id, l.doc_id AS article_id,
  {now} AS created_at, 0.2::DOUBLE AS credibility_score, 'review' AS topics
FROM labels l WHERE l.quality = 0 AND l.doc_id IN (SELECT id FROM articles)"""
    out["restate_source_stats"] = patch + """,
changed AS (SELECT * FROM updated WHERE old_level IS DISTINCT FROM credibility_level),
deltas AS (
  SELECT source, -count(*) FILTER (WHERE old_level = 'High') AS high, -count(*) FILTER (WHERE old_level = 'Medium') AS medium,
    -count(*) FILTER (WHERE old_level = 'Low') AS low, -count(*) AS total, true AS is_initial
  FROM changed WHERE source IN (SELECT source FROM source_stats) GROUP BY source
  UNION ALL
  SELECT source, count(*) FILTER (WHERE credibility_level = 'High'), count(*) FILTER (WHERE credibility_level = 'Medium'),
    count(*) FILTER (WHERE credibility_level IS NULL OR credibility_level NOT IN ('High', 'Medium')), count(*), false
  FROM changed GROUP BY source
  UNION ALL
  SELECT source, high, medium, low, total_analyzed, is_initial FROM source_stats
)
SELECT source, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low,
  CAST(sum(total) AS BIGINT) AS total_analyzed, bool_and(is_initial) AS is_initial
FROM deltas GROUP BY source"""
    out["update_source_stats"] = batch + f"""
SELECT source, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low,
  CAST(sum(total) AS BIGINT) AS total_analyzed, bool_and(is_initial) AS is_initial, max(last_updated) AS last_updated
FROM (
  SELECT source, high, medium, low, total_analyzed AS total, is_initial, last_updated FROM source_stats
  UNION ALL
  SELECT source, count(*) FILTER (WHERE credibility_level = 'High'), count(*) FILTER (WHERE credibility_level = 'Medium'),
    count(*) FILTER (WHERE credibility_level IS NULL OR credibility_level NOT IN ('High', 'Medium')), count(*), false, {now}
  FROM batch GROUP BY source
) u GROUP BY source"""
    out["validate_articles"] = """
SELECT id, concat_ws('; ',
  CASE WHEN title IS NULL THEN 'title is null' END, CASE WHEN source IS NULL THEN 'source is null' END,
  CASE WHEN content IS NULL THEN 'content is null' END,
  CASE WHEN credibility_level IS NOT NULL AND credibility_level NOT IN ('High', 'Medium', 'Low') THEN 'unknown credibility level' END,
  CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END) AS reasons
FROM articles"""
    out["validate_broken_articles"] = """
SELECT id, concat_ws('; ', CASE WHEN id % 7 = 0 OR title IS NULL THEN 'title is null' END,
  CASE WHEN id % 11 = 0 OR source IS NULL THEN 'source is null' END,
  CASE WHEN id % 17 = 0 OR content IS NULL THEN 'content is null' END,
  CASE WHEN id % 5 = 0 THEN 'unknown credibility level' END, CASE WHEN id % 13 = 0 THEN 'duplicate id' END) AS reasons
FROM (SELECT id, title, source, content FROM articles UNION ALL
      SELECT id, title, source, content FROM articles WHERE id % 13 = 0)"""
    out["restate_moved_sources"] = """,
moved AS (SELECT a.source, a.credibility_level AS lvl FROM articles a WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)),
deltas AS (
  SELECT source, -count(*) FILTER (WHERE lvl = 'High') AS high, -count(*) FILTER (WHERE lvl = 'Medium') AS medium,
    -count(*) FILTER (WHERE lvl = 'Low') AS low, -count(*) AS total, true AS is_initial FROM moved GROUP BY source
  UNION ALL
  SELECT 'moved.example.org', count(*) FILTER (WHERE lvl = 'High'), count(*) FILTER (WHERE lvl = 'Medium'),
    count(*) FILTER (WHERE lvl IS NULL OR lvl NOT IN ('High', 'Medium')), count(*), false FROM moved HAVING count(*) > 0
  UNION ALL
  SELECT source, high, medium, low, total_analyzed, is_initial FROM source_stats
)
SELECT source, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low,
  CAST(sum(total) AS BIGINT) AS total_analyzed, bool_and(is_initial) AS is_initial
FROM deltas GROUP BY source"""
    out["orphan_history"] = """
SELECT id, article_id, created_at FROM analysis_history h
WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.id = h.article_id)"""
    out["cascade_delete"] = """
SELECT id, article_id FROM analysis_history
WHERE article_id IS NULL OR article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"""
    out["cascade_delete_articles"] = """
SELECT id, title, source FROM articles
WHERE id IS NULL OR id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"""
    out["seed_featured"] = f"""
SELECT id, title, is_featured FROM articles
UNION ALL
SELECT (SELECT max(id) FROM articles) + 1, '{C.FEATURED_TITLE}', true
WHERE NOT EXISTS (SELECT 1 FROM articles WHERE title = '{C.FEATURED_TITLE}')"""
    out["decode_analysis"] = """
SELECT id, credibility_score, sentiment_score, bias_score, array_to_string(topics, ',') AS topics,
  array_to_string(key_arguments, ',') AS key_arguments, array_to_string(list_sort(perspective_keys), ',') AS perspectives
FROM analysis_history"""
    return out


for _k, _v in _store_sql().items():
    sql(_k, _v, "articles", "analysis_history", "source_stats")


# ------------------------------------------------------------------ pages / feed
_RE2_STRIP = ("[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}"
              "\\x{202F}\\x{205F}\\x{3000}]")


def _feed_sql():
    from veracity.operators.feed import query_terms
    from veracity.plans import catalog as C
    from veracity.sources import pages as PG
    out = {}
    strip = f"regexp_replace(input_text, '^{_RE2_STRIP}+|{_RE2_STRIP}+$', '', 'g')"
    out["route_input"] = f""",
inputs AS (
  SELECT 'turn:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS input_id, text AS input_text FROM conversations
  UNION ALL
  SELECT 'page:' || CAST(page_id AS VARCHAR), '  ' || url || chr(10) FROM pages
),
t AS (SELECT input_id, {strip} AS input FROM inputs),
k AS (SELECT *, CASE WHEN input IS NULL OR input = '' THEN 'empty'
  WHEN starts_with(input, 'http://') OR starts_with(input, 'https://') THEN 'url' ELSE 'text' END AS kind FROM t)
SELECT input_id, kind, CASE WHEN kind = 'empty' THEN '{PG.EMPTY_INPUT}' END AS error,
  CASE WHEN kind = 'text' THEN '{PG.DIRECT_TITLE}' END AS title,
  CASE WHEN kind = 'text' THEN '{PG.DIRECT_SOURCE}' END AS source, length(input) AS input_length
FROM k"""
    cols = "id, title, short_summary AS description, source, url, created_at AS published_at, lang"
    match = _any_like(["title", "short_summary", "content"], query_terms(C.NEWS_QUERY))
    where = (f"{match} AND lang = 'en' AND CAST(created_at AS DATE) >= DATE '2024-01-02' "
             f"AND CAST(created_at AS DATE) <= DATE '2024-01-20'")
    out["search_news"] = f"\nSELECT {cols} FROM articles WHERE {where} ORDER BY created_at DESC, id LIMIT 20"
    out["search_news_total"] = f"\nSELECT count(*) AS total_results FROM articles WHERE {where}"
    ev = _any_like(["title", "short_summary", "content"], query_terms(C.EVERYTHING_QUERY))
    out["get_everything"] = f"\nSELECT {cols} FROM articles WHERE {ev} ORDER BY created_at DESC, id LIMIT 5"
    rel = _any_like(["title"], query_terms(C.NEWS_QUERY))
    hosts = ", ".join(f"'{h}'" for h in C.FEED_DOMAINS)
    out["search_news_relevancy"] = (f"\nSELECT {cols} FROM articles WHERE {match} AND {host_sql('url')} IN ({hosts})"
                                    f" ORDER BY CASE WHEN {rel} THEN 1 ELSE 2 END, created_at DESC, id LIMIT 15")
    chosen = ", ".join(f"'{x}'" for x in C.FEED_SOURCES)
    out["top_headlines_by_source"] = (f"\nSELECT {cols} FROM articles WHERE lang = 'en' AND source IN ({chosen})"
                                      " ORDER BY created_at DESC, id LIMIT 12")
    out["list_sources_by_country"] = f"""
SELECT source, count(*) AS articles, max(created_at) AS latest_published_at FROM articles
WHERE lang = 'fr' AND list_contains({tags_sql('content')}, 'technology') GROUP BY source"""
    out["news_article_by_url"] = f"\nSELECT {cols} FROM articles WHERE url IN (SELECT url FROM pages WHERE url <> '')"
    th = f"lang = 'fr' AND list_contains({tags_sql('content')}, 'technology')"
    out["top_headlines"] = f"\nSELECT {cols} FROM articles WHERE {th} ORDER BY created_at DESC, id LIMIT 20"
    out["top_headlines_total"] = f"\nSELECT count(*) AS total_results FROM articles WHERE {th}"
    out["list_sources"] = """
SELECT source, count(*) AS articles, max(created_at) AS latest_published_at FROM articles WHERE lang = 'en' GROUP BY source"""
    return out


for _k, _v in _feed_sql().items():
    sql(_k, _v, "articles")


# ------------------------------------------------------------------ streams
def _streams_sql():
    from veracity.plans import catalog as C
    from veracity.streaming import streams as SS
    out = {}
    out["source_stats_stream"] = "\nSELECT source, high, medium, low, total_analyzed, is_initial FROM source_stats"
    n = C.QUOTA_N
    out["quota_windows"] = f"""
SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS requests,
  least(count(*), {n}) AS admitted, greatest(count(*) - {n}, 0) AS rejected
FROM events GROUP BY user_id, date_trunc('minute', ts)"""
    out["quota_windows_stream"] = out["quota_windows"]
    out["quota_windows_daily"] = """
SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS requests,
  least(count(*), 1) AS admitted, greatest(count(*) - 1, 0) AS rejected
FROM events GROUP BY user_id, date_trunc('day', ts)"""
    out["quota_admissions_daily"] = """
SELECT event_id, user_id, date_trunc('day', ts)::TIMESTAMP AS window_start,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS position,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 1 AS admitted
FROM events"""
    out["quota_admissions"] = f"""
SELECT event_id, user_id, date_trunc('minute', ts) AS window_start,
  row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS position,
  row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= {n} AS admitted
FROM events"""
    def limited(limits, client, late=""):
        # one request after the other: the state of every window, as SQL
        def start(w, of="s.t"):
            return f"({of} - {of} % {w * 1_000_000})"
        used = {w: f"(CASE WHEN {start(w)} = {start(w, 'r.t')} THEN r.used{w} ELSE 0 END)" for w, _ in limits}
        refused = "CASE " + " ".join(f"WHEN {used[w]} >= {m} THEN {w}" for w, m in limits) + " END"
        room = " AND ".join(f"{used[w]} < {m}" for w, m in limits)
        return f"""RECURSIVE_MARK
s AS (SELECT event_id, {client}::VARCHAR AS client, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {client} ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT client, rn, event_id, t, NULL::BIGINT AS refused_by, {", ".join(f"1 AS used{w}" for w, _ in limits)} FROM s WHERE rn = 1
  UNION ALL
  SELECT s.client, s.rn, s.event_id, s.t, {refused}, {", ".join(f"{used[w]} + ({room})::INT" for w, _ in limits)}
  FROM r JOIN s ON s.client = r.client AND s.rn = r.rn + 1
)
SELECT event_id, client, refused_by IS NULL AS admitted, refused_by::BIGINT AS refused_by{late} FROM r"""
    out["quota_admissions_combined"] = limited([(60, 10), (3600, 50), (86_400, 200)], "user_id")
    out["quota_admissions_combined_tight"] = limited([(60, 1), (3600, 2), (86_400, 12)], "event_type")
    out["quota_admissions_stream"] = limited([(60, 1), (3600, 2), (86_400, 12)], "event_type", ", false AS late")
    reuse = f""",
subs AS (SELECT event_id, ts, sha256(event_type || chr(1) || props) AS key FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM subs),
r AS (
  SELECT key, rn, event_id, ts, ts AS anchor, false AS hit FROM s WHERE rn = 1
  UNION ALL
  SELECT s.key, s.rn, s.event_id, s.ts,
    CASE WHEN s.ts >= r.anchor + INTERVAL {C.REUSE_TTL} SECOND THEN s.ts ELSE r.anchor END,
    s.ts < r.anchor + INTERVAL {C.REUSE_TTL} SECOND
  FROM r JOIN s ON s.key = r.key AND s.rn = r.rn + 1
)
SELECT event_id, key, ts, hit, anchor AS cached_at FROM r"""
    out["reusable_results"] = reuse.replace(",\nsubs AS", "RECURSIVE_MARK subs AS", 1)
    out["reusable_results_stream"] = out["reusable_results"]
    out["latest_analysis_stream"] = """
SELECT article_id, id, created_at, credibility_score, sentiment_score, bias_score
FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) AS rn
      FROM analysis_history) x WHERE rn = 1"""
    sp = ("[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}"
          "\\x{3000}\\x{FEFF}]")
    nsp = sp.replace("[", "[^@", 1)

    def tr(c):
        return f"regexp_replace({c}, '^{sp}+|{sp}+$', '', 'g')"
    types = ", ".join(f"'{t}'" for t in SS.FEEDBACK_TYPES)
    out["feedback_check"] = f""",
t AS (SELECT conv_id, turn, {tr('name')} AS n, {tr('email')} AS e, type, {tr('message')} AS m FROM feedback),
c AS (SELECT *, CASE
  WHEN coalesce(n, '') = '' OR coalesce(e, '') = '' OR coalesce(type, '') = '' OR coalesce(m, '') = '' THEN '{SS.MISSING_FIELDS}'
  WHEN NOT regexp_matches(e, '^{nsp}+@{nsp}+\\.{nsp}+$') THEN '{SS.BAD_EMAIL}'
  WHEN type NOT IN ({types}) THEN '{SS.BAD_TYPE}' END AS reason FROM t)
SELECT conv_id, turn, reason IS NULL AS valid, reason FROM c"""
    return out


for _k, _v in _streams_sql().items():
    _sql = W(_v, "articles", "analysis_history", "feedback", "source_stats")
    ORACLE[_k] = _sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK", ",") \
        if "RECURSIVE_MARK" in _sql else _sql

ORACLE["restated_stats_stream"] = ORACLE["restate_source_stats"]
for _k, _of in (("stored_articles", "upsert_articles"), ("stored_history", "append_history")):
    ORACLE[_k] = ORACLE[_of]
