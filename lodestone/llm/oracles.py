"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_SHARDS = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h
  FROM documents),
p AS (
  SELECT doc_id, n_bytes, k.d, h >> (48 - k.d) AS bits, h
  FROM d CROSS JOIN (SELECT unnest(range(0, 37)) AS d) k),
b AS (
  SELECT d, bits, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS alone
  FROM p GROUP BY d, bits),
leaf AS (
  SELECT p.doc_id, p.n_bytes, min(p.d) AS depth
  FROM p JOIN b USING (d, bits) WHERE shard_bytes <= 1048576 OR alone GROUP BY p.doc_id, p.n_bytes)
SELECT leaf.doc_id,
       substr(right(repeat('0', 48) || to_binary(p.h), 48), 1, leaf.depth) AS shard,
       CAST(leaf.depth AS INTEGER) AS depth, CAST(leaf.n_bytes AS BIGINT) AS n_bytes,
       CAST(b.shard_bytes AS BIGINT) AS shard_bytes, b.shard_docs
FROM leaf JOIN p ON p.doc_id = leaf.doc_id AND p.d = leaf.depth JOIN b ON b.d = p.d AND b.bits = p.bits
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_URLS = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT s.page_id, s.host, s.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(action, length(rhost || rpath)) AS action
  FROM s LEFT JOIN r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN
    starts_with(host || path, 'm.') OR contains(host || path, '/print/') OR contains(host || path, '/wp-admin/')
    OR ends_with(host || path, '.html') OR regexp_matches(host || path, '^blog\..*/fr/') OR contains(host || path, '.org/es/')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
"""

_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

_NEAR = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM d),
own AS MATERIALIZED (
  SELECT doc_id, n_shingles, min(doc_id) OVER (PARTITION BY shingles) AS class
  FROM (SELECT doc_id, count(*) AS n_shingles, list(shingle ORDER BY shingle) AS shingles FROM g GROUP BY doc_id)),
one AS MATERIALIZED (SELECT g.doc_id AS class, shingle, n_shingles FROM g JOIN own USING (doc_id) WHERE doc_id = class),
near AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM one a JOIN one b USING (shingle) WHERE a.class <> b.class
  GROUP BY a.class, b.class, a.n_shingles, b.n_shingles HAVING 100 * count(*) >= 75 * (a.n_shingles + b.n_shingles - count(*))),
reached(class, root) AS (
  SELECT class, class FROM own WHERE doc_id = class UNION SELECT near.b, root FROM reached JOIN near ON a = class),
root AS (SELECT class, min(root) AS root FROM reached GROUP BY class)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN root USING (class)
"""

_PASSAGES = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos,
         unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS passage
  FROM d),
again AS (SELECT doc_id, pos FROM starts QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_extendible_shards": _SHARDS, "op5_exact_dedup": _EXACT, "op6_near_duplicates": _NEAR, "op9_url_filters": _URLS,
    "op10_repeated_passages": _PASSAGES, "op12_hard_negatives": _NEGATIVES}
