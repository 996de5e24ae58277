"""SQL for the queries of this subpackage that SQL can express, with the operators' parameters."""

from __future__ import annotations

from lamina.llm import neardup, quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_frequency() -> str:
    """Base statistics, and the line rule over whole lines in place of their hashes."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS ls FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, array_to_string(regexp_extract_all({_LOWER.format("l")}, '{_WORD}'), ' ') AS line, sum(len(regexp_extract_all(l, '{_WORD}'))) AS words FROM (SELECT doc_id, source, unnest(ls) AS l FROM w) GROUP BY ALL),
firsts AS (SELECT source, min(doc_id) AS doc_id FROM d GROUP BY source, t),
sizes AS (SELECT source, count(*) AS n FROM firsts GROUP BY source),
counted AS (SELECT l.source, line, count(*) AS docs FROM lines l JOIN firsts f ON f.doc_id = l.doc_id GROUP BY ALL),
frequent AS (SELECT c.source, c.line FROM counted c JOIN sizes m ON m.source IS NOT DISTINCT FROM c.source WHERE c.docs > {quality.LEAST} AND c.docs * c.docs > {quality.GROWTH * quality.GROWTH} * m.n),
removed AS (SELECT l.doc_id, sum(l.words) AS words FROM lines l JOIN frequent f ON f.line = l.line AND f.source IS NOT DISTINCT FROM l.source GROUP BY l.doc_id),
stats AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(r.words, 0) AS gone FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN removed r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words) AND n_words - gone >= {quality.REMAINS} * n_words AS kept FROM stats"""


def near_duplicates() -> str:
    """All links by brute force over shared shingles, and what they reach."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {neardup.WIDTH} THEN list_transform(range(1, len(ws) - {neardup.WIDTH - 2}), lambda i: array_to_string(ws[i:i + {neardup.WIDTH - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {neardup.PERCENT} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


def secret_ledger() -> str:
    """Every rule over every text; matches are placed by the lengths of what lies between them."""
    parts = []
    for place, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(rf"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, {"start + length(found) - length(g)" if rule.tail else "start"} AS start, start + length(found) AS "end" FROM (
  SELECT doc_id, found, g, CAST(sum(length(piece)) OVER o + coalesce(sum(length(found)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(p[1:len(m)]) AS piece, unnest(m) AS found, unnest(g) AS g FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d WHERE regexp_matches(t, '{pattern}')))
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE length(g) >= {rule.least}""")
    many = len(secrets.BASE)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE place = {i}) AS BIGINT) AS n_{kind}" for i, kind in enumerate(secrets.BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(parts)}),
told AS (SELECT *, kind || ':' || start || ':' || "end" AS s FROM spans)
SELECT d.doc_id, {counts.replace("count(*)", "count(place)")}, sha256(coalesce(string_agg(s, ',' ORDER BY start, place) FILTER (WHERE place < {many}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, place), '') AS spans
FROM d LEFT JOIN told ON told.doc_id = d.doc_id GROUP BY d.doc_id"""
