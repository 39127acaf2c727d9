"""DuckDB equivalents of the registered queries that SQL can express."""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i AS line, part[i] AS raw, trim(part[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key0
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS part FROM documents), LATERAL (SELECT unnest(range(1, len(part) + 1)) AS i)
), k AS (
  SELECT doc_id, line, raw, translate(key0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.line, k.raw, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
), pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM dw, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hit AS (
  SELECT p.doc_id, p.i, p.n, v.item FROM pos p JOIN win v USING (n, s)
), word AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY doc_id
), item AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes,
         translate(' || '.join_parts, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""".replace("' || '.join_parts", " || ".join(f"upper(to_base(('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT, 32, 8))" for k in range(4)))

ORACLE = {"op5_warc": WARC, "op4_line_dedup": LINE_DEDUP, "op10_decontamination": DECONTAMINATION}
