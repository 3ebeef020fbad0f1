"""DuckDB SQL of the queries that SQL can express, written from the contracts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded_words(table: str) -> str:
    return (f"SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
            rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}")


_DECONTAMINATION = f"""
WITH d AS ({_folded_words('documents')}), b AS ({_folded_words('benchmark')}),
bw AS (SELECT DISTINCT item_id, w[i:i + l - 1] AS win, l FROM (
  SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
  FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, i, w[i:i + l - 1] AS win FROM (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
  FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT doc_id, dw.i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256,
  coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def mixing_ctes(docs: str, rounds: int = 36) -> str:
    """CTEs up to ``mixed`` (doc_id, source, lang, topic, n_tokens, rate, sampled)."""
    marks = [("licence", ("Licensed under", "All rights reserved")), ("table", (" | ",)),
             ("symbols", ("%%%", "&&&", "$$$", "***", "###")), ("shouting", ("!!",))]
    cases = " ".join("WHEN " + " OR ".join(f"contains(t, '{m}')" for m in ms) + f" THEN '{name}'" for name, ms in marks)
    out = [f"""tokens AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE {cases} ELSE 'prose' END AS topic,
  greatest(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM {docs}))""",
           "sums AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM tokens GROUP BY ALL)"]
    for dim, power in (("source", 0.5), ("lang", 0.7), ("topic", 1.0)):
        out.append(f"""{dim}s AS (SELECT {dim}, 0.5 * sum(s) OVER () * pow(s, {power}) / sum(pow(s, {power})) OVER () AS t_{dim}
  FROM (SELECT {dim}, sum(tokens) AS s FROM sums GROUP BY ALL))""")
    out.append("r0 AS (SELECT *, 0.5 * tokens AS w FROM sums JOIN sources USING (source) JOIN langs USING (lang) JOIN topics USING (topic))")
    n = 0
    for _ in range(rounds):
        for dim in ("source", "lang", "topic"):
            out.append(f"""r{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (w, f, g), least(w * CASE
  WHEN g > 0 AND t_{dim} > f THEN (t_{dim} - f) / g WHEN f + g > 0 THEN t_{dim} / (f + g) ELSE 0.0 END, 1e6 * tokens) AS w
  FROM (SELECT *, sum(if(w >= tokens, tokens, 0.0)) OVER (PARTITION BY {dim}) AS f,
    sum(if(w >= tokens, 0.0, w)) OVER (PARTITION BY {dim}) AS g FROM r{n}))""")
            n += 1
    out.append(f"""rates AS (SELECT source, lang, topic, round(r * p) / p AS rate FROM (
  SELECT *, pow(10, 5 - floor(log10(r))) AS p FROM (SELECT *, least(w, tokens) / tokens AS r FROM r{n})))""")
    out.append("""mixed AS (SELECT doc_id, source, lang, topic, n_tokens, rate, h < rate AS sampled FROM (
  SELECT tokens.*, rate, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0 AS h
  FROM tokens JOIN rates USING (source, lang, topic)))""")
    return ",\n".join(out)


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORD = r"[^\x20\x09-\x0D]+"

_NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)
"""

_LINES = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no
  FROM (SELECT doc_id, {_LOWER} AS t FROM documents)),
occ AS (SELECT doc_id, line_no, regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM raw),
line AS (SELECT line, row_number() OVER () AS id, hex(encode(line)) AS h FROM (SELECT DISTINCT line FROM occ WHERE line <> '')),
sh AS (
  SELECT DISTINCT id, substr(h, 2 * i + 1, 16) AS g FROM (
    SELECT id, h, unnest(range(0, length(h) // 2 - 7)) AS i FROM line WHERE length(h) >= 16)
  UNION ALL SELECT id, h FROM line WHERE length(h) < 16),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
link AS (
  SELECT a.id AS x, b.id AS y FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id
  JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.id, b.id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT DISTINCT x, x AS y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON ways.x = reach.y),
grp AS (SELECT x AS id, min(y) AS c FROM reach GROUP BY x),
seen AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY coalesce(grp.c, line.id) ORDER BY doc_id, line_no) = 1 AS kept
  FROM occ JOIN line USING (line) LEFT JOIN grp USING (id)),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE NOT kept), '') AS dropped FROM seen GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(dropped, '') AS dropped_lines
FROM documents LEFT JOIN per USING (doc_id)
"""

_RULES = {"symbols": "n_symbols / word_chars", "capitals": "n_capitals / word_chars",
          "exclamations": "n_exclamations / word_chars", "dup_lines": "n_dup_lines / n_lines",
          "repeats": "n_repeat_words / n_words"}
_CUTOFFS = ", ".join([f"0.0{i}" for i in range(1, 10)] + [f"{i / 100:.2f}" for i in range(10, 96, 5)])


def _quality_rules() -> str:
    def chars(of: str) -> str:
        return f"length(t) - length(translate(t, '{of}', ''))"
    values = ", ".join(f"coalesce({v.split(' / ')[0]}::DOUBLE / nullif({v.split(' / ')[1]}, 0), 0) AS {k}" for k, v in _RULES.items())
    longer = " UNION ALL ".join(f"SELECT doc_id, stratum, '{k}' AS rule, {k}::DOUBLE AS v FROM m" for k in _RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '(none)') AS stratum FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
  [l for l in string_split(t, chr(10)) if regexp_matches(l, '{_WORD}')] AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, g)) GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  ({chars('#*$%&|<>')})::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.c, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, {chars(UPPER)} AS n_capitals, {chars('!')} AS n_exclamations
  FROM w LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, {values} FROM f),
v AS ({longer}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counted AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE v.v > cutoff) AS k
  FROM v JOIN good USING (doc_id), (SELECT unnest([{_CUTOFFS}]::DOUBLE[]) AS cutoff) GROUP BY stratum, rule, cutoff),
tail AS (SELECT *, CASE WHEN k >= n * 0.01 THEN 1 ELSE list_sum(
    [exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) for i in range(0, k + 1)]) END AS p
  FROM counted),
passed AS (SELECT *, min((p <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM counted)))::INT)
  OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM tail),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM passed WHERE ok = 1 GROUP BY stratum, rule),
bad AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM v JOIN cut USING (stratum, rule)
  WHERE v.v > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM m LEFT JOIN bad USING (doc_id)
"""



def _crc32(strings: str, name: str) -> str:
    """CTEs that end in ``name`` (s, crc): the unsigned CRC-32 of the UTF-8 bytes of every
    s of the table ``strings``, a byte a round (the query must be WITH RECURSIVE)."""
    return f"""
{name}_bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM {name}_bits WHERE k < 8),
{name}_table AS MATERIALIZED (SELECT b, v FROM {name}_bits WHERE k = 8),
{name}_steps AS (
  SELECT s, hex(encode(s)) AS h, 0 AS i, 4294967295::BIGINT AS c FROM {strings} UNION ALL
  SELECT s, h, i + 1, xor(c >> 8, t.v) FROM {name}_steps JOIN {name}_table t
    ON t.b = (xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) WHERE 2 * i < length(h)),
{name} AS MATERIALIZED (SELECT s, xor(c, 4294967295) AS crc FROM {name}_steps WHERE 2 * i = length(h))"""


_SPELLING = f"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT k, r, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS r
    FROM documents) WHERE length(r) >= 5 GROUP BY k, r),
strs AS (SELECT DISTINCT k || ':' || r AS s FROM run),{_crc32('strs', 'hashed')},
cut AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(r, 1, (crc % length(r))::INT) || substr(r, (crc % length(r))::INT + 2) ELSE r END AS word, n
  FROM run JOIN hashed ON s = k || ':' || r),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (
  SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS MATERIALIZED (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT less.word, word.word FROM less JOIN word ON word.word = less.d
  UNION SELECT word.word, less.word FROM less JOIN word ON word.word = less.d),
best AS (SELECT x, n_near, y, m FROM (
  SELECT x, y, word.n AS m, count(*) OVER (PARTITION BY x) AS n_near,
    row_number() OVER (PARTITION BY x ORDER BY word.n DESC, encode(y)) AS place FROM near JOIN word ON word.word = y) WHERE place = 1),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form,
  CASE WHEN m >= 2 * n THEN m END AS form_n FROM word LEFT JOIN best ON x = word),
chain AS (SELECT word, word AS at FROM formed UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain ON chain.word = f.word
  JOIN formed l ON l.word = chain.at WHERE l.form IS NULL
"""

_IMPORTANCE = f"""
WITH RECURSIVE b AS ({_folded_words('benchmark')}), d AS ({_folded_words('documents')}),
runs AS MATERIALIZED (
  SELECT 0 AS of, doc_id AS id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM d
  UNION ALL
  SELECT 1, NULL, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
strs AS (SELECT DISTINCT s FROM runs),{_crc32('strs', 'hashed')},
feature AS MATERIALIZED (SELECT of, id, crc % 10000 AS bucket, count(*) AS n FROM runs JOIN hashed USING (s) GROUP BY ALL),
bucket AS (SELECT bucket, sum(n) FILTER (WHERE of = 0) AS s, sum(n) FILTER (WHERE of = 1) AS t FROM feature GROUP BY bucket),
total AS (SELECT sum(n) FILTER (WHERE of = 0) AS s, coalesce(sum(n) FILTER (WHERE of = 1), 0) AS t FROM feature),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(bucket.t, 0) + 1) * (total.s + 10000))::DOUBLE
  / ((coalesce(bucket.s, 0) + 1) * (total.t + 10000))::DOUBLE))::BIGINT AS g FROM bucket, total),
weighed AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n)::DOUBLE)::BIGINT AS weight
  FROM feature JOIN gain USING (bucket) WHERE of = 0 GROUP BY id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
    / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


ORACLE = {
    "op1_fuzzy_lines": _LINES,
    "op3_superminhash": _NEAR_DUPLICATES,
    "op7_risk_controlled_rules": _quality_rules(),
    "op5_decontamination": _DECONTAMINATION,
    "op11_spelling_chunks": _SPELLING,
    "op12_importance_resampling": _IMPORTANCE,
    "op9_raking": f"""WITH {mixing_ctes('documents')}
SELECT doc_id, source, lang, topic, n_tokens, rate, sampled FROM mixed""",
}
