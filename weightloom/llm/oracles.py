"""DuckDB SQL for the queries of this subpackage that SQL can express, over the driver's tables."""

from __future__ import annotations

_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER x AS win, count(*) OVER x AS n FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows WHERE n = 8) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY 1),
s AS (SELECT d.doc_id, d.source, d.text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '{_GAP}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
texts AS (SELECT source, text, min(doc_id) AS id, any_value(n_words) AS n_words, any_value(base_failed) AS base_failed FROM f GROUP BY 1, 2),
parts AS (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM texts),
keyed AS (SELECT source, text, lower(trim(regexp_replace(line, '{_GAP}', ' ', 'g'))) AS line, len(regexp_extract_all(line, '{_WORD}')) AS n FROM parts WHERE regexp_matches(line, '{_WORD}')),
frequent AS (SELECT source, line FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT text) > 5),
hit AS (SELECT source, text, line, sum(n) AS n FROM keyed JOIN frequent USING (source, line) GROUP BY 1, 2, 3),
poor AS (SELECT source, text, id FROM texts JOIN (SELECT source, text, sum(n) AS lost FROM hit GROUP BY 1, 2) USING (source, text) WHERE NOT base_failed AND n_words - lost < 0.25 * n_words),
held AS (SELECT source, line, arg_min(text, id) AS text FROM hit JOIN poor USING (source, text) GROUP BY 1, 2),
lost AS (SELECT source, text, sum(n) AS lost FROM hit ANTI JOIN held USING (source, line, text) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(lost, 0) >= 0.25 * n_words AS kept, CAST(n_words - coalesce(lost, 0) AS BIGINT) AS n_words_left FROM f LEFT JOIN lost USING (source, text)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""

ORACLE_SQL = {"op2_quality_rules": QUALITY, "op10_warc": ARCHIVES}
