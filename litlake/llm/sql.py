"""The same rows as the queries in DuckDB's SQL, over the whole tables."""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

MIX = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source_key, source_size,
         CASE (row_number() OVER (ORDER BY source_key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source_key, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source_key)),
levels(k, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM sources
  UNION ALL
  SELECT k + 1, (SELECT (sum(s.source_size) - coalesce(sum(3 * s.source_size) FILTER (3 * s.source_size < level * s.weight), 0))::DOUBLE
                        / sum(s.weight) FILTER (3 * s.source_size >= level * s.weight) FROM sources s)
  FROM levels WHERE k < 40),
targets AS (
  SELECT source_key, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target
  FROM sources, (SELECT level FROM levels WHERE k = 40)),
dealt AS (
  SELECT z.*, t.source_size, t.target, md5('17|' || coalesce(doc_id::VARCHAR, 'null')) AS place,
         ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT
           % greatest(ceil(t.source_size / 1000000), 1)::BIGINT AS shard
  FROM sizes z JOIN targets t USING (source_key)),
cells AS (
  SELECT source_key, shard, cell_size, aim, floor(aim / 256 + 0.5)::BIGINT AS base
  FROM (SELECT source_key, shard, sum(size)::BIGINT AS cell_size,
               CASE WHEN first(source_size) > 0 THEN first(target) * sum(size) / first(source_size) ELSE 0 END AS aim
        FROM dealt GROUP BY source_key, shard)),
missing AS (SELECT (round(sum(aim) / 256) - sum(base))::BIGINT AS m FROM cells),
ups AS (
  SELECT source_key, shard, count(*) AS more FROM (
    SELECT source_key, shard, row_number() OVER (ORDER BY aim / (2 * (base + step) + 1) DESC, source_key, shard, step) AS r
    FROM cells, (SELECT unnest(range(0, greatest((SELECT m FROM missing), 0))) AS step))
  WHERE r <= (SELECT m FROM missing) GROUP BY source_key, shard),
downs AS (
  SELECT source_key, shard, count(*) AS less FROM (
    SELECT source_key, shard, row_number() OVER (ORDER BY aim / (2 * (base - step) + 1), source_key, shard, step) AS r
    FROM cells, (SELECT unnest(range(1, greatest(-(SELECT m FROM missing), 0) + 1)) AS step) WHERE step <= base)
  WHERE r <= -(SELECT m FROM missing) GROUP BY source_key, shard),
quotas AS (
  SELECT c.*, greatest(ceil(cell_size / 256), 1)::BIGINT AS blocks,
         least(base + coalesce(more, 0) - coalesce(less, 0), 3 * greatest(ceil(cell_size / 256), 1)::BIGINT) AS quota,
         ('0x' || substr(md5('17|' || source_key || '|' || shard::VARCHAR), 1, 8))::BIGINT
           % greatest(ceil(cell_size / 256), 1)::BIGINT AS opening
  FROM cells c LEFT JOIN ups USING (source_key, shard) LEFT JOIN downs USING (source_key, shard)),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source_key, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM dealt)
SELECT p.doc_id, p.size, p.source_size, p.target,
       ((q.quota // q.blocks) * p.size
        + greatest(least(upto, (opening + quota % blocks) * 256) - greatest(upto - p.size, opening * 256), 0)
        + greatest(least(upto, (opening + quota % blocks - blocks) * 256) - (upto - p.size), 0))::BIGINT AS taken
FROM placed p JOIN quotas q USING (source_key, shard)
"""

CONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (
  SELECT item_id, ws, least(13, len(ws)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark) WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, lengths WHERE len(ws) >= m)),
found AS (SELECT doc_id, item_id, m, i FROM places JOIN windows USING (m, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
of AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)
"""

DUPLICATE_GROUPS = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s
    FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM docs
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) USING (doc_id)
"""

URLS = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {LOWER}) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(regexp_split_to_array(host, '[.\-]'),
      ['adult', 'ads', 'bets', 'casino', 'pills', 'spam', 'porn', 'warez']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

WARC = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
newest AS (
  SELECT payload_digest, max(page_id) AS response FROM rows WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM response AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response AND payload_bytes >= 1000 THEN response END AS refers_to
FROM rows LEFT JOIN newest USING (payload_digest)
"""

#: The checksum of a decimal id, bit by bit: DuckDB has no crc32.
PREFIX_TRIE = """
WITH RECURSIVE crc AS (
  SELECT conv_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                            lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
original AS (
  SELECT conv_id, list(turn_ ORDER BY turn NULLS FIRST, role, text) AS turns FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn_
    FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS s
  FROM original o JOIN crc USING (conv_id)
  LEFT JOIN original b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, s[1:depth] AS seq, count(*) AS n, min(conv_id) AS least,
         coalesce(string_agg(CASE WHEN len(s) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY ALL),
own AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n - 1) * octet_length(encode(seq[depth].t)) END AS saved,
         CASE WHEN depth > 0 THEN seq[1:depth - 1] END AS above
  FROM nodes),
children AS (SELECT above AS seq, count(*) AS n_children FROM own WHERE depth > 0 GROUP BY 1),
counted AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM own o LEFT JOIN children USING (seq)),
totals AS (
  SELECT seq, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (
    SELECT c.seq[1:k] AS seq, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) c)
  GROUP BY 1)
SELECT c.least AS conv_id, c.depth, p.least AS parent_conv_id, c.n AS n_convs, c.n_children,
       n_leaves, saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN totals USING (seq) LEFT JOIN counted p ON p.seq = c.above
"""
