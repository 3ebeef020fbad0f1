"""DuckDB text of the article-store views, used only by the SQL oracles.

Written independently of the Spark views (FIXTURES.md §2) so that the oracle
is a second implementation, not a transcript of the DataFrame code.
"""

from __future__ import annotations

ARTICLES = """
articles AS (
  SELECT d.doc_id AS id, substring(d.text, 1, 60) AS title, d.source AS source, p.url AS url,
    d.lang AS lang, d.text AS content,
    CASE WHEN length(d.text) > 200 THEN concat(substring(d.text, 1, 200), '...') ELSE d.text END AS short_summary,
    CASE WHEN l.quality = 0 THEN 'Low' WHEN l.quality = 1 AND l.toxic = 0 THEN 'High' ELSE 'Medium' END AS credibility_level,
    TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 14200000) * INTERVAL '37' MINUTE AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 14200000) * INTERVAL '37' MINUTE AS updated_at,
    d.doc_id = 0 AS is_featured
  FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id
)"""

HISTORY = """
analysis_history AS (
  SELECT event_id AS id,
    CASE WHEN k >= 97 THEN event_id ELSE user_id END AS article_id,
    date_trunc('hour', ts) AS created_at,
    CASE WHEN event_type <> 'error' THEN CAST(k AS DOUBLE) / 100 END AS credibility_score,
    CASE WHEN event_type <> 'signup' THEN CAST((k * 7) % 100 AS DOUBLE) / 100 END AS sentiment_score,
    CASE WHEN event_type <> 'view' THEN CAST((k * 13) % 100 AS DOUBLE) / 100 END AS bias_score,
    CASE WHEN event_type <> 'error' THEN [
      CASE k % 5 WHEN 0 THEN 'politics' WHEN 1 THEN 'economy' WHEN 2 THEN 'technology' WHEN 3 THEN 'science' ELSE 'health' END,
      CASE k % 3 WHEN 0 THEN 'politics' WHEN 1 THEN 'conflict' ELSE 'media' END] END AS topics,
    CASE WHEN event_type <> 'click' THEN
      CASE k % 4 WHEN 0 THEN ['western'] WHEN 1 THEN ['western', 'neutral'] WHEN 2 THEN ['neutral']
                 ELSE ['western', 'neutral', 'eastern'] END END AS perspective_keys,
    CASE WHEN event_type <> 'purchase' THEN
      ['arg' || CAST(k % 6 AS VARCHAR), 'arg' || CAST(k % 4 AS VARCHAR)] END AS key_arguments,
    CAST(NULL AS VARCHAR) AS summary,
    k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e
)"""

# perspective rows: one per (analysis, key) with the band of the analysis score
PERSPECTIVES = """
perspective_rows AS (
  SELECT h.id, h.article_id, h.created_at, p.key AS pkey,
    CASE WHEN h.credibility_score >= 0.8 THEN 'High' WHEN h.credibility_score >= 0.6 THEN 'Medium'
         WHEN h.credibility_score IS NOT NULL THEN 'Low' END AS pcred,
    p.key || ':' || CAST(h.k % 3 AS VARCHAR) AS psummary
  FROM analysis_history h, (SELECT unnest(h2.perspective_keys) AS key, h2.id AS hid FROM analysis_history h2) p
  WHERE p.hid = h.id
)"""

FEEDBACK = """
feedback AS (
  SELECT conv_id, turn, role AS name,
    CASE WHEN turn % 3 = 2 THEN concat('user', CAST(conv_id AS VARCHAR), ' at example.com')
         ELSE concat('user', CAST(conv_id AS VARCHAR), '@example.com') END AS email,
    CASE conv_id % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'suggestion' WHEN 2 THEN 'question' WHEN 3 THEN 'other' ELSE '' END AS type,
    text AS message
  FROM conversations
)"""

SOURCE_STATS = """
seed_stats AS (
  SELECT * FROM (VALUES
    ('BBC News', 5, 1, 0), ('Reuters', 5, 1, 0), ('The New York Times', 4, 2, 0), ('The Guardian', 4, 2, 0),
    ('CNN', 3, 3, 0), ('Fox News', 2, 3, 1), ('Al Jazeera', 3, 2, 1), ('RT', 1, 2, 3),
    ('Breitbart', 1, 1, 4), ('Daily Mail', 2, 2, 2)) AS t(source, high, medium, low)
),
source_stats AS (
  SELECT source, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium,
    CAST(sum(low) AS BIGINT) AS low, CAST(sum(total) AS BIGINT) AS total_analyzed,
    bool_and(is_initial) AS is_initial, max(last_updated) AS last_updated
  FROM (
    SELECT source, high, medium, low, high + medium + low AS total, true AS is_initial,
           CAST(NULL AS TIMESTAMP) AS last_updated FROM seed_stats
    UNION ALL
    SELECT source,
      count(*) FILTER (WHERE credibility_level = 'High'),
      count(*) FILTER (WHERE credibility_level = 'Medium'),
      count(*) FILTER (WHERE credibility_level IS NULL OR credibility_level NOT IN ('High', 'Medium')),
      count(*), false, max(updated_at)
    FROM articles GROUP BY source
  ) u GROUP BY source
)"""

_DEFS = {
    "articles": (ARTICLES, ()),
    "analysis_history": (HISTORY, ()),
    "perspective_rows": (PERSPECTIVES, ("analysis_history",)),
    "feedback": (FEEDBACK, ()),
    "source_stats": (SOURCE_STATS, ("articles",)),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first).

    ``body`` may itself start with ``, name AS (...)`` CTE definitions that
    follow the shared ones; write it as plain SQL otherwise.
    """
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _DEFS[n][1]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH " + ",\n".join(_DEFS[n][0].strip() for n in order)
    body = body.strip()
    if body.startswith(","):
        return head + "\n" + body
    return head + "\n" + body
