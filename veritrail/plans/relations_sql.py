"""The SQL of the queries in relations."""

from __future__ import annotations

from .oracle import CLAIMS, PAPERS, _case_need, _case_type, norm, strip

_NUMBERED = r"\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]"
_VENUE = f"WITH {PAPERS}, s AS (SELECT doc_id, venue, (doc_id % 41) / 40 AS support FROM p)"


def _contained(part: str) -> str:
    """Ratio of blocks of a title and a part of it that is one block."""
    return f"round(CASE WHEN n = 0 OR length({part}) = 0 THEN 0 ELSE 2 * length({part}) / (n + length({part})) END, 9)"


SQL: dict[str, str] = {
    "span_sections": rf"""WITH t AS (SELECT doc_id, replace(text, '. ', ' [' || (doc_id % 97) || ']. ') AS text FROM documents),
      h AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBERED}')) AS hit,
          unnest(regexp_split_to_array(text, '{_NUMBERED}')[1:len(regexp_extract_all(text, '{_NUMBERED}'))]) AS gap,
          generate_subscripts(regexp_extract_all(text, '{_NUMBERED}'), 1) AS i FROM t WHERE regexp_matches(text, '{_NUMBERED}')),
      sp AS (SELECT doc_id, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS fin FROM h),
      pa AS (SELECT doc_id, unnest(s) AS para, generate_subscripts(s, 1) - 1 AS pid FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM t)),
      po AS (SELECT *, coalesce(sum(length(para) + 1) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pa),
      se AS (SELECT doc_id, pid, off, unnest(m) AS raw, generate_subscripts(m, 1) AS sid FROM (
          SELECT *, regexp_extract_all(para, '[^.!?。！？；]*[.!?。！？；]["'')】」』”]*|[^.!?。！？；]+\z') AS m FROM po)),
      sf AS (SELECT *, off + sum(length(raw)) OVER (PARTITION BY doc_id, pid ORDER BY sid) AS fin, {strip('raw')} AS sent FROM se),
      sn AS (SELECT doc_id, pid, fin, fin - length(regexp_replace(raw, '^\s+', '')) AS start_,
          row_number() OVER (PARTITION BY doc_id, pid ORDER BY sid) - 1 AS no FROM sf WHERE sent <> ''),
      at_ AS (SELECT sp.doc_id, sp.fin - n AS start, sp.fin, pid, off FROM sp JOIN po ON po.doc_id = sp.doc_id
          AND sp.fin - n < off + length(para) AND off < sp.fin)
      SELECT a.doc_id, a.start::INT AS start, a.fin::INT AS "end", min(a.pid)::INT AS paragraph_id, coalesce(min(sn.no), -1)::INT AS sentence_id
      FROM at_ a LEFT JOIN sn ON sn.doc_id = a.doc_id AND a.start < sn.fin AND sn.start_ < a.fin GROUP BY ALL""",
    "verdict_as_of": """WITH l AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_id END AS own FROM events),
      w AS (SELECT event_id, user_id, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM l)
      SELECT w.event_id, w.user_id, coalesce(e.event_type, '') AS verdict, coalesce(e.value, -1.0) AS verdict_value, coalesce(v, -1) AS verdict_event
      FROM w LEFT JOIN events e ON e.event_id = v""",
    "searches_verified": """SELECT f.user_id, f.event_id AS found_id, coalesce(c.event_id, -1) AS checked_id
      FROM events f LEFT JOIN events c ON c.user_id = f.user_id AND c.event_type = 'purchase' AND c.ts BETWEEN f.ts AND f.ts + INTERVAL 1 DAY
      WHERE f.event_type = 'view'""",
    "log_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
      SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, no""",
    "venue_trailing_years": f"""WITH {PAPERS}, c AS (SELECT venue, year, count(*) AS n FROM p WHERE year IS NOT NULL GROUP BY ALL)
      SELECT venue, year::INT AS year, n, (sum(n) OVER (PARTITION BY venue ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))::BIGINT AS trailing FROM c""",
    "venue_percentiles": f"""{_VENUE} SELECT venue, support, count(*) AS n, round(any_value(r), 9) AS percent_rank, round(any_value(c), 9) AS cume_dist FROM (
      SELECT venue, support, percent_rank() OVER (PARTITION BY venue ORDER BY support) AS r, cume_dist() OVER (PARTITION BY venue ORDER BY support) AS c FROM s) GROUP BY ALL""",
    "venue_quartiles": f"{_VENUE} SELECT doc_id, venue, (ntile(4) OVER (PARTITION BY venue ORDER BY support, doc_id))::INT AS quartile FROM s",
    "claim_cube": f"""WITH {CLAIMS}, c AS (SELECT {_case_type('original_text')} AS claim_type, {_case_need('original_text')} AS citation_need, source FROM cl JOIN documents USING (doc_id))
      SELECT coalesce(claim_type, '') AS claim_type, coalesce(citation_need, '') AS citation_need, coalesce(source, '') AS source,
        grouping(claim_type, citation_need, source)::INT AS level, count(*) AS n FROM c GROUP BY CUBE (claim_type, citation_need, source)""",
    "verdict_table": "SELECT user_id::VARCHAR AS paper_id, arg_max(event_type, event_id) AS verdict, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id",
    "daily_sketches": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_within, true AS ranks_within FROM events GROUP BY event_type",
    "title_blocks": f"""WITH {PAPERS}, t AS (SELECT doc_id, length({norm('title')}) AS n, {norm('left(title, (length(title) // 3)::INT)')} AS a,
      {norm('right(title, (length(title) // 3)::INT)')} AS b FROM p) SELECT doc_id, {_contained('a')} AS beginning, {_contained('b')} AS ending FROM t""",
    "captured_search": f"""WITH {PAPERS} SELECT venue AS query, 'W' || doc_id AS id, coalesce(doi, '') AS doi, title, year::INT AS publication_year, n_chars AS cited_by_count
      FROM p WHERE year BETWEEN 2005 AND 2020 AND doc_id % 4 <> 0""",
}
