"""SQL that the queries of the corpus operators must equal, where SQL can say it on whole tables.

Written on its own, by plain self joins and windows, without the operators' filters.
"""

from __future__ import annotations

_BLANK = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS t, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY 1
), words AS (
  SELECT first_id, regexp_extract_all(t, '{_BLANK}') AS w FROM texts
), shingles AS (
  SELECT DISTINCT first_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE [w[i:i + 4] for i in range(1, len(w) - 3)] END) AS s FROM words
), sizes AS (
  SELECT first_id, count(*) AS n FROM shingles GROUP BY first_id
), pairs AS (
  SELECT a.first_id AS x, b.first_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.first_id <> b.first_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.first_id = x JOIN sizes b ON b.first_id = y WHERE 5 * common >= 4 * (a.n + b.n - common)
), reached AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), groups AS (
  SELECT x, least(x, min(y)) AS class_id FROM reached GROUP BY x
), counts AS (
  SELECT x, count(*) AS n_links FROM links GROUP BY x
)
SELECT d.doc_id, coalesce(g.class_id, t.first_id) AS class_id, t.n_copies, coalesce(c.n_links, 0) AS n_links
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.t LEFT JOIN groups g ON g.x = t.first_id LEFT JOIN counts c ON c.x = t.first_id
"""

#: The patterns without look-around and possessive repeats, which change speed but not matches.
_PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(h, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6"""),
    ("access", r"AKIA[A-Z0-9]+", "length(h) >= 20"),
    ("hex", r"[0-9a-f]+", "length(h) >= 24"),
    ("key_id", r"""(?:ASIA|AROA|AIDA)[A-Z0-9]{8,}|(?i:client_?id|user_?name|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", "true"),
    ("secret", r"[A-Za-z0-9/+_-]+", "length(h) >= 20 AND regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Z]') AND regexp_matches(h, '[a-z]')"),
    ("endpoint", r"""(?i:https?|wss?|ftps?|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|(?i:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}""", "true"),
)
_ROLES = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "secret": "secret", "endpoint": "endpoint"}


def _found(k: int, pattern: str, valid: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, kind, e - length(h) AS s, e FROM (
      SELECT doc_id, {k} AS kind, h, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (
        SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS h, unnest(string_split_regex(t, '{p}')[:-2]) AS g, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d)) WHERE {valid}"""


SECRET_SCAN = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({' UNION ALL '.join(_found(k, p, v) for k, (_, p, v) in enumerate(_PATTERNS))}),
named AS (SELECT *, ['assign', 'access', 'hex', 'key_id', 'secret', 'endpoint'][kind + 1] AS name, [{', '.join(f"'{_ROLES[n]}'" for n, _, _ in _PATTERNS)}][kind + 1] AS role FROM parts),
kept AS (
  SELECT * FROM named p WHERE kind < 3 OR (
    NOT EXISTS (SELECT 1 FROM named b WHERE b.doc_id = p.doc_id AND b.kind < 3 AND b.s < p.e AND p.s < b.e)
    AND (kind = 4 OR EXISTS (SELECT 1 FROM named q WHERE q.doc_id = p.doc_id AND q.role = 'secret' AND (q.s, q.kind) <> (p.s, p.kind) AND q.s - p.e <= 300 AND p.s - q.e <= 300))
    AND (kind = 3 OR EXISTS (SELECT 1 FROM named q WHERE q.doc_id = p.doc_id AND q.role = 'id' AND (q.s, q.kind) <> (p.s, p.kind) AND q.s - p.e <= 300 AND p.s - q.e <= 300)))
),
said AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (doc_id)
"""


def quality_rules_sql() -> str:
    """The counts by windows and sets, the certificates by the binomial law through lgamma."""
    from evidentia.llm.quality_rules import RiskControl

    control = RiskControl()
    levels = ", ".join(f"('{rule}', {level}::DOUBLE)" for rule, cutoffs in control.rules.items() for level in cutoffs)
    share = control.limit / len(control.rules)
    metrics = " UNION ALL ".join(f"SELECT doc_id, stratum, quality, '{r}' AS rule, {r} AS value FROM labelled" for r in control.rules)
    broken = ", ".join(f"CASE WHEN s.{r} > (SELECT level FROM best b WHERE b.stratum = s.lang AND b.rule = '{r}') THEN '{r}' END" for r in control.rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_BLANK}') GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!')) AS bangs,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals, coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
stats AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS repeated_line_share,
    n_repeat_words / greatest(n_words, 1) AS repeated_word_share, word_chars / greatest(n_words, 1) AS chars_per_word, bangs / greatest(n_words, 1) AS bangs_per_word, capitals / greatest(word_chars, 1) AS capital_share
  FROM counts
),
labelled AS (SELECT *, lang AS stratum FROM stats JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE NOT base_failed),
tests AS (
  SELECT stratum, rule, level, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND value > level) AS k, count(*) FILTER (quality = 0) AS m, count(*) FILTER (quality = 0 AND value > level) AS hits
  FROM ({metrics}) JOIN (VALUES {levels}) l(rule, level) USING (rule) GROUP BY ALL
),
certain AS (
  SELECT *, hits / greatest(m, 1) - k / greatest(n, 1) AS gain,
    list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})) for i in range(k + 1)]) AS p
  FROM tests WHERE k <= {share} * n
),
best AS (SELECT stratum, rule, arg_max(level, (gain, level)) AS level FROM certain WHERE gain > 0 AND p <= {control.error} / ((SELECT count(DISTINCT stratum) FROM labelled) * {len(control.rules)}) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules = '' AS kept, rules
FROM (SELECT s.*, array_to_string(list_filter([{broken}], lambda r: r IS NOT NULL), ',') AS rules FROM stats s)
"""

#: Sets that match share one of the rarest words of each, so only those meet; all else is as it is defined.
LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '{_BLANK}'))) AS w FROM l),
sets AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min((doc_id, i))) AS id, w, min((doc_id, i)) AS first FROM s WHERE len(w) > 0 GROUP BY w),
words AS (SELECT id, len(w) AS n, unnest(w) AS word FROM sets),
rarest AS MATERIALIZED (
  SELECT id, n, word FROM (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY many, word) AS place FROM words JOIN (SELECT word, count(*) AS many FROM words GROUP BY word) USING (word))
  WHERE place <= n - (4 * n + 4) // 5 + 1
), met AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM rarest a JOIN rarest b ON a.word = b.word AND b.id < a.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT later FROM met JOIN sets a ON a.id = later JOIN sets b ON b.id = earlier
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))
), removed AS (
  SELECT s.doc_id, count(*) AS n_removed, string_agg(s.i, ',' ORDER BY s.i) AS removed FROM s JOIN sets ON sets.w = s.w WHERE (s.doc_id, s.i) > sets.first OR sets.id IN (SELECT later FROM gone) GROUP BY s.doc_id
)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN removed USING (doc_id)
"""
