"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The shares are dealt out round by round, as the definition says.
MIX = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (
  SELECT 0 AS round, source, source_size, w, false AS full_, true AS more FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, now, bool_or(now AND NOT full_) OVER ()
  FROM (SELECT *, full_ OR w * (sum(source_size) OVER () * 1.5 - sum(CASE WHEN full_ THEN source_size * 2.0 ELSE 0.0 END) OVER ())
               / sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER () > source_size * 2.0 AS now FROM r WHERE more)),
last AS (SELECT * FROM r WHERE round = (SELECT max(round) FROM r)),
t AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN source_size * 2.0 ELSE
              (sum(source_size) OVER () * 1.5 - sum(CASE WHEN full_ THEN source_size * 2.0 ELSE 0.0 END) OVER ())
              / sum(CASE WHEN full_ THEN 0.0 ELSE w END) OVER () * w END AS target FROM last),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0) ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p
"""

LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE o.owner < k.doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.owner IS NULL OR o.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o ON k.key = o.key GROUP BY k.doc_id
"""

NGRAMS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS words FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4
           THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS grams FROM w),
s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a)
SELECT g.doc_id, len(grams)::BIGINT AS n_shingles, coalesce(c.least, g.doc_id) AS component_id
FROM g LEFT JOIN (SELECT node, min(seen) AS least FROM reach GROUP BY node) c ON g.doc_id = c.node
"""


def _hits(kind: str, number: int, pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, '{kind}' AS kind, {number} AS no, unnest(regexp_extract_all(text, '{pattern}')) AS hit,
         unnest((regexp_split_to_array(text, '{pattern}'))[1:len(regexp_extract_all(text, '{pattern}'))]) AS gap,
         generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS pos
  FROM t WHERE regexp_matches(text, '{pattern}')"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_SQL = _ASSIGN.replace("'", "''")
SECRETS = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
hits AS ({_hits("assign", 0, _ASSIGN)} UNION ALL {_hits("access", 1, "AKIA[A-Z0-9]+")}
  UNION ALL {_hits("hex", 2, "[0-9a-f]+")} UNION ALL {_hits("live", 3, "[A-Za-z0-9+/_-]{24,}")}),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY pos)::BIGINT AS upto FROM hits),
spans AS (
  SELECT doc_id, source, kind, no, hit, upto - length(hit) AS from_, upto FROM placed WHERE
    kind = 'assign' AND length(regexp_extract(hit, '{_ASSIGN_SQL}', 2)) >= 6 OR kind = 'access' AND length(hit) >= 20
    OR kind = 'hex' AND length(hit) >= 24 OR kind = 'live' AND regexp_matches(hit, '[0-9]')
       AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')),
base AS (SELECT * FROM spans WHERE kind <> 'live'),
live AS (
  SELECT * FROM spans l WHERE kind = 'live' AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.from_ < l.upto AND l.from_ < b.upto)),
candidates AS (SELECT * FROM base UNION ALL SELECT * FROM live),
valued AS (
  SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(hit, '{_ASSIGN_SQL}', 2) ELSE hit END AS value FROM candidates),
owned AS (
  SELECT value, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners,
         count(DISTINCT doc_id) AS repositories FROM valued GROUP BY value),
every AS (
  SELECT valued.*, CASE WHEN owners >= 2 THEN 'example' WHEN repositories > 3 THEN 'shared' ELSE 'live' END AS verdict
  FROM valued JOIN owned ON valued.value = owned.value)
SELECT t.doc_id, (count(*) FILTER (WHERE kind = 'assign'))::BIGINT AS n_assign,
  (count(*) FILTER (WHERE kind = 'access'))::BIGINT AS n_access, (count(*) FILTER (WHERE kind = 'hex'))::BIGINT AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || from_ || ':' || upto, ',' ORDER BY from_, no) FILTER (WHERE kind <> 'live'), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || from_ || ':' || upto, ',' ORDER BY from_, no)
           FILTER (WHERE kind <> 'live' OR verdict <> 'example'), '') AS spans,
  (count(*) FILTER (WHERE verdict = 'example'))::BIGINT AS n_example,
  (count(*) FILTER (WHERE verdict = 'shared'))::BIGINT AS n_shared,
  (count(*) FILTER (WHERE verdict = 'live'))::BIGINT AS n_live
FROM t LEFT JOIN every ON t.doc_id = every.doc_id GROUP BY t.doc_id
"""

# Checksums half a byte at a time, from the reflected polynomial; hex digits of a
# byte are exchanged because the lower half goes first.
_CRC_HALF = """list_transform(range(16), lambda n: list_reduce([1, 2, 3, 4],
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"""
SHARDS = rf"""
WITH half AS (SELECT {_CRC_HALF} AS t),
d AS (
  SELECT doc_id, source, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, md5('shard-1:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         xor(4294967295, list_reduce(
           list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\2\1', 'g'), ''),
                          lambda c: strpos('0123456789ABCDEF', c)::BIGINT - 1),
           lambda c, h: xor(c >> 4, half.t[((xor(c, h) & 15) + 1)::INTEGER]), 4294967295::BIGINT)) AS text_crc32
  FROM documents, half),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) AS rank,
         count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, rank) - 1 AS place,
         count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard,
       (place - (place * 24 // total * total + 23) // 24)::BIGINT AS slot, NULL::DOUBLE AS grown_shard FROM p
"""

ORACLES = {"op3_mix_sources": MIX, "op8_line_dedup": LINES, "op9_ngram_join": NGRAMS, "op10_secret_scan": SECRETS,
           "op12_interleaved_shards": SHARDS}
