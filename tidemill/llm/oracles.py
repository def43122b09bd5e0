"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import quality, warc

_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in quality.BOILERPLATE)
_SPACE = r"[\x20\x09-\x0D]+"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first FROM h WHERE payload_bytes >= {warc.MIN_REVISIT_BYTES} GROUP BY payload_digest HAVING count(*) > 1)
SELECT h.page_id, payload_bytes, payload_digest, CASE WHEN h.page_id <> m.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN h.page_id <> m.first THEN m.first END AS refers_to FROM h LEFT JOIN m USING (payload_digest)
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i, words FROM w WHERE len(words) > {quality.WINDOW}),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS s FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least({quality.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {quality.WINDOW})) AS k FROM dup) GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, line, lower(line) AS low, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '') AS t FROM raw),
c AS (SELECT doc_id, line, len(t) AS n,
   (NOT regexp_matches(line, '[{quality.END_MARKS}{quality.NO_MARKS}]') AND len(t) >= {quality.PUNCTUATION_FROM})
   OR (len(t) > 0 AND (
     (len(list_filter(t, lambda x: x IN ('|', '»', '›', '·', '•', '>', '>>'))) >= {quality.NAV_MIN} AND len(list_filter(t, lambda x: x IN ('|', '»', '›', '·', '•', '>', '>>'))) * {quality.NAV_WORDS} >= len(t))
     OR len(list_filter(t, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) * 100 > len(t) * {quality.MAX_SYMBOL_PERCENT}
     OR len(list_filter(t, lambda x: ends_with(x, '!!'))) * 100 > len(t) * {quality.MAX_SHOUT_PERCENT}))
   OR len(list_filter([{_PHRASES}], lambda p: contains(low, p))) > 0 AS fails FROM l),
k AS (SELECT doc_id, sum(CASE WHEN fails THEN 0 ELSE n END) AS left_words, count(*) FILTER (WHERE n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS n_dup_lines FROM c GROUP BY doc_id),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
   coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, left_words FROM w LEFT JOIN k USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT}) AND left_words * 100 > n_words * {quality.MIN_KEPT_PERCENT} AS kept FROM b
"""
