"""DuckDB SQL with the same rows, where SQL can express a query."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP1 = rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
hits AS (SELECT doc_id, i, s.n, item FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS all_items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_RECORD = r"""
'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
|| chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
|| coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)
"""

OP7 = f"""
WITH a AS (SELECT page_id, {_RECORD} AS record FROM pages),
b AS (SELECT page_id, {_RECORD} AS record
      FROM (SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN html || ' ' ELSE html END AS html FROM pages WHERE page_id % 101 <> 5))
SELECT a.page_id, CAST(coalesce(sum(strlen(a.record)) OVER (ORDER BY a.page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(strlen(a.record) AS BIGINT) AS length, sha256(a.record) AS record_sha256,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.record <> b.record THEN 'changed' ELSE 'intact' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
"""

SQL = {"op1_decontamination": OP1, "op7_warc_audit": OP7}
