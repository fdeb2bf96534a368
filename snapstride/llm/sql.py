"""DuckDB SQL with the same rows as the queries that SQL can express."""

EXACT_DEDUP = """
WITH folded AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), grouped AS (
  SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY body
)
SELECT f.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       f.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(f.body) AS text_sha256
FROM folded f JOIN grouped g ON f.body = g.body
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u,
         1e0 + CASE WHEN length(text) > 0
                    THEN CAST(length(regexp_replace(text, '[^\p{L} ]', '', 'g')) AS DOUBLE) / length(text)
                    ELSE 0e0 END AS q
  FROM documents
), keyed AS (
  SELECT doc_id, source, size, round(pow(u, 1e0 / q), 12) AS k FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight
  FROM keyed GROUP BY source
), ordered AS (
  SELECT *, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS goal,
         coalesce(sum(2e0 * source_size) OVER w, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM sources
  WINDOW w AS (ORDER BY 2e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (goal - capped) / open_weight AS lv FROM ordered
), level AS (
  SELECT max(lv) AS lv FROM levels WHERE cap >= lv * weight
), aims AS (
  SELECT s.source, s.source_size,
         round(CASE WHEN l.lv IS NULL THEN s.cap ELSE least(s.cap, l.lv * s.weight) END, 6) AS target
  FROM levels s CROSS JOIN level l
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM aims
), run AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k DESC, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST((epochs + CASE WHEN size > 0 AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM run
"""

LINE_DEDUP = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id <> repeated.keep, false) AS gone
  FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

#: Base 32 of a 160-bit digest: its 40 hex digits in eight groups of five (20 bits each),
#: every group four letters of the alphabet.
WARC = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, h, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest
  FROM hashed
), keepers AS (
  SELECT h, max(page_id) AS keeper FROM coded GROUP BY h
)
SELECT c.page_id, c.payload_bytes, c.payload_digest,
       CASE WHEN c.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN c.page_id = k.keeper THEN NULL ELSE k.keeper END AS refers_to
FROM coded c JOIN keepers k ON c.h = k.h
"""
