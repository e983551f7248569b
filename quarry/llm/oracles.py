"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES ('assign', 0, 12), ('access', 1, 18), ('hex', 2, 16)) AS v(kind, ord, least)),
m AS (
  SELECT rid, kind, ord, least, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS w,
         regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g,
         string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gap
  FROM d, p WHERE kind = 'assign' AND regexp_matches(lower(t), 'passw|secret|token|api_?key')
  UNION ALL
  SELECT rid, kind, ord, least, regexp_extract_all(t, 'AKIA[A-Z0-9]{14,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{14,}'), string_split_regex(t, 'AKIA[A-Z0-9]{14,}')
  FROM d, p WHERE kind = 'access'
  UNION ALL
  SELECT rid, kind, ord, least, regexp_extract_all(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}'), string_split_regex(t, '[0-9a-f]{16,}')
  FROM d, p WHERE kind = 'hex'),
x AS (SELECT rid, kind, ord, least, w, g, gap, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
y AS (SELECT rid, kind, ord, least, length(w[i]) AS n, length(g[i]) AS gn,
             sum(length(gap[i]) + length(w[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM x),
z AS (SELECT rid,
             count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - n, ord) AS spans
      FROM y WHERE gn >= least GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (rid)
"""

OP8 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT item, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM g),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
e AS (SELECT rid, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'gram': array_to_string(w[i:i + k - 1], ' ')}})) AS x
      FROM d, (SELECT DISTINCT k FROM grams) n WHERE len(w) >= k),
places AS (SELECT DISTINCT rid, x.i AS i, e.k, item FROM e JOIN grams ON grams.gram = e.x.gram AND grams.k = e.k),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM places) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM places) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS original FROM h WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < original THEN original END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""

OP10 = rf"""
WITH u AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(h, p, verdict)),
m AS (SELECT page_id, max_by(h || p, len(h || p)) AS rule, max_by(verdict, len(h || p)) AS verdict
      FROM u, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'i': i, 'h': md5(array_to_string(w[i:i + 49], ' '))})) AS x FROM d WHERE len(w) >= 50),
first AS (SELECT x.h AS h, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(x.i, x.i + 50)) AS p FROM win JOIN first ON first.h = win.x.h WHERE m < doc_id),
e AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n FROM e LEFT JOIN gone ON gone.rid = e.rid AND gone.p = e.p GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


def oracles() -> dict[str, str]:
    return {"op3_warc": OP3, "op4_secrets": OP4, "op8_decontamination": OP8, "op9_substrings": OP9, "op10_urlfilter": OP10}
