"""The SQL of the order-dependent title step: one record after the other."""

from __future__ import annotations

from .oracle import _FLIP, _FLIP_ALL, PAPER_ID, PAPERS, last_name, norm, recency

_TOTAL = "(length(x) + length(y))"
# Longest common subsequence, a row of the table per character. Everything is a
# list of numbers, because reductions keep the type of their elements.
_LCS = """list_reduce(list_concat([list_transform(range(length(y) + 1), lambda i: 0)], list_transform(string_split(x, ''), lambda c: [unicode(c)])),
    lambda above, c: list_reduce(list_concat([[0]], list_transform(range(1, length(y) + 1), lambda j: [j::INT])),
      lambda row_, j: list_append(row_, CASE WHEN unicode(substr(y, j[1], 1)) = c[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], row_[-1]) END)))[-1]"""

_PRIORITY = ("CASE {} WHEN 'crossref' THEN 0 WHEN 'openalex' THEN 1 WHEN 'semantic_scholar' THEN 2 WHEN 'local_file' THEN 4 "
             "WHEN 'exa' THEN 5 WHEN 'google_scholar' THEN 6 ELSE 9 END")
_LEADS = f"({_PRIORITY.format('o.apis[1]')} < CASE WHEN len(c.apis) = 1 THEN {_PRIORITY.format('c.apis[1]')} ELSE 9 END)"
_BETTER = f"(o.aq > c.aq OR {_LEADS} AND o.aq = c.aq)"
_KNOWN = f"((o.year IS NOT NULL) > (c.year IS NOT NULL) OR {_LEADS} AND (o.year IS NOT NULL) = (c.year IS NOT NULL))"
_FIELDS = ("ord", "tier", "nt", "title", "last", "aq", "authors", "year", "doi", "apis", "n")
_OWN = "{" + ", ".join(f"'{f}': o.{f}" for f in _FIELDS) + "}"
_ROW = "{" + ", ".join(f"'{f}': {f}" for f in _FIELDS) + "}"
_JOINED = f"""{{'ord': c.ord, 'tier': c.tier, 'nt': CASE WHEN {_LEADS} THEN o.nt ELSE c.nt END, 'title': CASE WHEN {_LEADS} THEN o.title ELSE c.title END,
    'last': CASE WHEN {_BETTER} THEN o.last ELSE c.last END, 'aq': greatest(o.aq, c.aq), 'authors': CASE WHEN {_BETTER} THEN o.authors ELSE c.authors END,
    'year': CASE WHEN {_KNOWN} THEN o.year ELSE c.year END, 'doi': CASE WHEN {_LEADS} THEN o.doi ELSE c.doi END,
    'apis': CASE WHEN {_LEADS} THEN list_concat(o.apis, list_filter(c.apis, lambda s: NOT list_contains(o.apis, s)))
      ELSE list_concat(c.apis, list_filter(o.apis, lambda s: NOT list_contains(c.apis, s))) END, 'n': c.n + o.n}}"""

#: From rw (scope, ord, tier, nt, title, last, aq, authors, year, doi, apis, n), tier 0 with a
#: DOI, to done (scope, and the same of what is left).
REPLAY = f"""
nd AS MATERIALIZED (SELECT scope, nt, count(*) AS rows_ FROM rw WHERE nt <> '' GROUP BY scope, nt),
cand AS MATERIALIZED (SELECT a.scope, a.nt AS x, b.nt AS y FROM nd a JOIN nd b ON a.scope = b.scope AND a.nt < b.nt
    AND abs(length(a.nt) - length(b.nt)) <= (length(a.nt) + length(b.nt)) // 10 AND levenshtein(a.nt, b.nt) <= (length(a.nt) + length(b.nt)) // 10),
sim AS MATERIALIZED (SELECT scope, x, y FROM cand WHERE 1.0 - ({_TOTAL} - 2 * {_LCS})::DOUBLE / {_TOTAL} >= 0.9),
near AS MATERIALIZED (SELECT scope, x, list(y) AS ys, len(ys) > 1 OR max(r) > 1 AS busy FROM (
    SELECT *, 0 AS r FROM sim UNION ALL SELECT scope, y, x, 0 FROM sim UNION ALL SELECT scope, nt, nt, rows_ FROM nd) GROUP BY scope, x),
act AS MATERIALIZED (SELECT rw.*, ys, coalesce(busy, false) AS busy FROM rw LEFT JOIN near ON near.scope = rw.scope AND x = nt),
op AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ord) AS k FROM act WHERE tier = 1 AND busy),
fold AS (
  SELECT scope, 0::BIGINT AS k, coalesce(list({_ROW} ORDER BY ord) FILTER (WHERE tier = 0), []) AS cs FROM act WHERE busy GROUP BY scope
  UNION ALL
  SELECT scope, k, CASE WHEN coalesce(home, 0) = 0 THEN list_append(cs, own) ELSE list_concat(cs[1:home - 1], [joined], cs[home + 1:]) END FROM (
    SELECT scope, k, cs, own, home, {_JOINED} AS joined FROM (
      SELECT o.scope, o.k, f.cs, o, {_OWN} AS own, h.home, f.cs[greatest(h.home, 1)] AS c FROM (
        SELECT f.scope, f.k, f.cs FROM fold f) f JOIN op o ON o.scope = f.scope AND o.k = f.k + 1, LATERAL (SELECT list_position(list_transform(f.cs, lambda c:
          list_contains(o.ys, c.nt) AND (o.year IS NULL OR c.year IS NULL OR abs(o.year - c.year) <= 1) AND (o.last = '' OR c.last = '' OR o.last = c.last)), true) AS home) h))),
done AS (SELECT scope, unnest(cs, recursive := true) FROM (SELECT scope, cs, k, max(k) OVER (PARTITION BY scope) AS m FROM fold) WHERE k = m
  UNION ALL SELECT scope, {", ".join(_FIELDS)} FROM act WHERE NOT busy)"""

_QUALITY = "(CASE WHEN authors IS NULL THEN -1 ELSE len(list_filter(authors, lambda a: contains(a, ','))) * 1000 + len(authors) * 10 + length(array_to_string(authors, '')) END)"
_LAST = f"lower(coalesce({last_name('authors[1]')}, ''))"

SQL = {
    "dedup_papers": f"""WITH RECURSIVE {PAPERS},
      d0 AS (SELECT *, {_QUALITY} AS aq, row_number() OVER (PARTITION BY doi ORDER BY doc_id % 3, doc_id) AS rn FROM p WHERE doi IS NOT NULL),
      ap AS (SELECT doi, list(src ORDER BY rn) AS apis FROM (SELECT doi, src, min(rn) AS rn FROM d0 GROUP BY doi, src) GROUP BY doi),
      d1 AS (SELECT doi, min(doc_id) AS ord, arg_min(title, rn) AS title, arg_min(authors, aq * -1000000 + rn) AS authors, max(aq) AS aq,
          arg_min(year, rn) FILTER (WHERE year IS NOT NULL) AS year, count(*) AS n FROM d0 GROUP BY doi),
      o0 AS (SELECT *, {norm('title')} AS nt, {_QUALITY} AS aq, {_LAST} AS last FROM p WHERE doi IS NULL),
      rw AS (SELECT 0 AS scope, ord, 0 AS tier, {norm('title')} AS nt, title, {_LAST} AS last, aq, authors, year, doi, apis, n FROM d1 JOIN ap USING (doi)
        UNION ALL SELECT 0, min(doc_id), 1, nt, arg_min(title, doc_id), last, max(aq), arg_min(authors, aq * -1000000000 + doc_id), any_value(year), NULL, [src], count(*)
          FROM o0 WHERE nt <> '' GROUP BY nt, year, last, src
        UNION ALL SELECT 0, doc_id, 1, '', title, last, aq, authors, year, NULL, [src], 1 FROM o0 WHERE nt = ''),
      {REPLAY}
      SELECT {PAPER_ID} AS paper_id, ord, tier::INT AS doi_first, n::BIGINT AS merged_from, array_to_string(apis, '+') AS source FROM done""",
    "retrieval": f"""WITH RECURSIVE {PAPERS}, r0 AS (SELECT *, src = 'semantic_scholar' AS s2, row_number() OVER (PARTITION BY venue, src = 'semantic_scholar' ORDER BY doc_id) - 1 AS rank FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY venue, s2 ORDER BY rank) AS passed FROM r0 WHERE year BETWEEN 2005 AND 2020),
      c0 AS (SELECT venue AS scope, rank + CASE WHEN s2 THEN 0 ELSE 1099511627776 END AS at_, title, year, CASE WHEN s2 THEN 'semantic_scholar' ELSE 'publish_or_perish' END AS src,
          CASE WHEN s2 THEN 2 ELSE 9 END AS prio, list_transform(authors, lambda a: CASE WHEN s2 THEN {_FLIP_ALL} ELSE {_FLIP} END) AS authors, doi FROM r WHERE passed <= 10 AND (s2 OR title <> '')),
      c AS (SELECT *, {_QUALITY} AS aq, {_LAST} AS last, {norm('title')} AS nt FROM c0),
      d0 AS (SELECT *, row_number() OVER (PARTITION BY scope, doi ORDER BY prio, at_) AS rn FROM c WHERE doi IS NOT NULL),
      ap AS (SELECT scope, doi, list(src ORDER BY rn) AS apis FROM (SELECT scope, doi, src, min(rn) AS rn FROM d0 GROUP BY scope, doi, src) GROUP BY scope, doi),
      d1 AS (SELECT scope, doi, min(at_) AS ord, arg_min(title, rn) AS title, arg_min(authors, aq * -1000000 + rn) AS authors, max(aq) AS aq,
          arg_min(year, rn) AS year, count(*) AS n FROM d0 GROUP BY scope, doi),
      rw AS (SELECT scope, ord, 0 AS tier, {norm('title')} AS nt, title, {_LAST} AS last, aq, authors, year, doi, apis, n FROM d1 JOIN ap USING (scope, doi)
        UNION ALL SELECT scope, min(at_), 1, nt, arg_min(title, at_), last, max(aq), arg_min(authors, aq * -10000000000000 + at_), any_value(year), NULL, [src], count(*)
          FROM c WHERE doi IS NULL AND nt <> '' GROUP BY scope, nt, year, last, src
        UNION ALL SELECT scope, at_, 1, '', title, last, aq, authors, year, NULL, [src], 1 FROM c WHERE doi IS NULL AND nt = ''),
      {REPLAY},
      s AS (SELECT 'src' || (s_suppkey % 20) AS venue, arg_min(s_suppkey % 13, s_suppkey) AS ct FROM supplier GROUP BY 1)
      SELECT scope AS claim_id, {PAPER_ID} AS paper_id, title, array_to_string(apis, '+') AS source, CASE WHEN ct IS NULL THEN 0.1 WHEN ct > 10 THEN 0.95 WHEN ct > 5 THEN 0.8
        WHEN ct > 2 THEN 0.6 WHEN ct > 0.5 THEN 0.4 ELSE 0.2 END::DOUBLE AS tier_score, {recency('year')} AS recency_score, n::BIGINT AS merged_from
      FROM done LEFT JOIN s ON s.venue = scope""",
}
