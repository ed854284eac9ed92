"""The SQL of the queries in branches."""

from __future__ import annotations

from ..operators.audit import REQUIRED_ARTIFACTS
from . import bridge as B
from .dedup_sql import SQL as DEDUP
from .oracle import (_list, APA_MARKER, CLAIMS, GREEDY, LOG, PAPER_ID, PAPERS, REFS, STYLED, TOPIC, VERIFIED, _FLIP, APA_ENTRY, _series, headline,
                     last_name, level, norm, pyround, strip)
from .oracle import ORACLE as OTHERS

_LINES = "l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pid FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
_STYLE = "CASE WHEN pid % 7 = 0 THEN 'h2' WHEN pid % 11 = 4 THEN 'title' ELSE '' END"
_CAPPED = "CASE WHEN doc_id % 5 = 0 THEN least(s, 0.74::DOUBLE) ELSE s END"
_PRIORITY = ("CASE WHEN regexp_matches(lower(x), 'related|background|literature') THEN 1 WHEN regexp_matches(lower(x), 'introduction|intro|引言') THEN 2 "
             "WHEN regexp_matches(lower(x), 'method|approach|model|方法') THEN 3 WHEN regexp_matches(lower(x), 'experiment|result|evaluation|实验') THEN 4 "
             "WHEN regexp_matches(lower(x), 'discussion|conclu|讨论|结论') THEN 5 ELSE 9 END")
_CITED = (r"\([^()]*?[A-Za-z一-鿿][^()]*?(?:19|20)\d{2}[a-z]?(?:[^()]*?;[^()]*?)*\)|\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]")
_NAMES = f"""m AS (SELECT doc_id, list_transform(range(1, doc_id % 26 + 1), lambda i: {_list(B.FAMILY_NAMES)}[(i + doc_id) % 10 + 1]) AS f, doc_id % 26 AS n FROM documents),
      r AS (SELECT *, list_transform(f, lambda x: 'A. B. ' || x) AS fi, list_transform(f, lambda x: x || ', A. B.') AS li, list_transform(f, lambda x: x || ' A. B.') AS na,
        list_transform(f, lambda x: x || ' A B') AS va FROM m)"""


def _joined(a: str, joint: str) -> str:
    return f"CASE WHEN n = 0 THEN '' WHEN n = 1 THEN {a}[1] ELSE array_to_string({a}[1:n - 1], ', ') || '{joint}' || {a}[n] END"


_IEEE = f"CASE WHEN n >= 7 THEN fi[1] || ', et al.' ELSE {_joined('fi', ', and ')} END"
_SEC = f"""{_LINES},
      h AS (SELECT *, {_STYLE} AS st, {strip('line')} AS t FROM l), o AS (SELECT *, st <> '' AND t <> '' AS opens FROM h),
      w AS (SELECT *, last_value(CASE WHEN opens THEN pid END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pid) AS at_,
          first_value(CASE WHEN opens THEN pid END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
          max(pid) OVER (PARTITION BY doc_id) AS fin FROM o)"""

SQL: dict[str, str] = {
    "judged_scores": f"""WITH j AS (SELECT doc_id, {pyround('least(1.0, (doc_id % 13) / 10)', 2)} AS s FROM documents WHERE doc_id % 3 <> 2), c AS (SELECT *, {_CAPPED} AS k FROM j)
      SELECT doc_id, k AS support_score, CASE WHEN k <> s THEN {level('k')} WHEN doc_id % 2 = 0 THEN 'DIRECT' ELSE {level('s')} END AS support_level,
        'read' || CASE WHEN k <> s THEN ' [capped: METADATA_ONLY]' ELSE '' END AS support_reasoning FROM c""",
    "applied_judgments": f"""WITH j AS (SELECT doc_id, least(1.0, (doc_id % 10) / 8) AS e, {pyround('least(1.0, (doc_id % 10) / 8)', 2)} AS s FROM documents WHERE doc_id % 2 = 0),
      c AS (SELECT *, {_CAPPED} AS k FROM j) SELECT doc_id, k AS support_score, CASE WHEN k <> s THEN {level('k')} ELSE {level('e')} END AS support_level,
        'why' || CASE WHEN k <> s THEN ' [capped: METADATA_ONLY]' ELSE '' END AS support_reasoning FROM c""",
    "pending_judgments": f"""WITH {PAPERS} SELECT doc_id::VARCHAR AS claim_id, 'It works.' AS claim, {PAPER_ID} AS paper_id, array_to_string(authors, '|') AS authors,
      CASE WHEN abstract = '' THEN 'METADATA_ONLY' ELSE 'ABSTRACT' END AS evidence_level, least(2000, length(abstract))::INT AS evidence_chars FROM p""",
    "judged_entailment": """WITH j AS (SELECT CASE WHEN doc_id % 5 = 4 THEN 'FAIL' ELSE ['PASS', 'FAIL', 'WEAK', 'WEAK'][doc_id % 4 + 1] END AS v,
      CASE WHEN doc_id % 5 = 4 THEN 'heuristic' ELSE 'llm' END AS m FROM documents) SELECT v AS entailment_verdict, m AS review_method, count(*) AS n FROM j GROUP BY ALL""",
    "hinted_claims": f"""SELECT doc_id::VARCHAR AS claim_id, CASE WHEN doc_id % 2 = 0 THEN 'Teachers in China use claim ' || doc_id ELSE {strip(headline('text'))} END AS normalized_claim,
      CASE WHEN doc_id % 2 = 0 THEN 'teachers' ELSE '' END AS population, CASE WHEN doc_id % 2 = 0 THEN 'china' ELSE '' END AS geography FROM documents""",
    "cached_verdicts": f"""WITH {VERIFIED}, k AS (SELECT DISTINCT doi FROM p WHERE doc_id % 3 = 0 AND doi IS NOT NULL)
      SELECT doc_id, CASE WHEN k.doi IS NOT NULL THEN 'CONFLICT' ELSE status END AS verification_status, k.doi IS NOT NULL AS verification_cached FROM v LEFT JOIN k ON k.doi = v.doi""",
    "bibliographic_gate": f"""SELECT 'FAIL' AS level, "check", sum(n)::BIGINT AS n FROM ({OTHERS['verdict_findings']}) GROUP BY 2
      UNION ALL SELECT 'WEAK', 'citation_in_document', sum(n)::BIGINT FROM (WITH {STYLED}, m AS (SELECT {APA_MARKER} AS marker FROM q WHERE year IS NOT NULL UNION ALL SELECT '[' || doc_id || ']' FROM q UNION ALL SELECT '(Nobody' || (doc_id % 3) || ', 1999)' FROM q),
        ok AS (SELECT DISTINCT split_part(authors[1], ',', 1) AS name, coalesce(year::VARCHAR, '') AS year FROM p WHERE doc_id % 3 = 0 AND len(authors) > 0)
        SELECT count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM ok WHERE contains(marker, year) AND regexp_matches(marker, '(?i)\\b' || name || '\\b')))
      UNION ALL SELECT 'FAIL', 'reference_doi_orphan', fails FROM ({OTHERS['audit_fold']}) UNION ALL SELECT 'WEAK', 'reference_entry', weak FROM ({OTHERS['audit_fold']})""",
    "word_structure": f"""WITH {_SEC}, z AS (SELECT w.*, CASE WHEN at_ IS NOT NULL AND NOT w.opens THEN b.t ELSE '' END AS x, b.pid AS bp FROM w LEFT JOIN h b ON b.doc_id = w.doc_id AND b.pid = at_)
      SELECT doc_id, pid::INT AS paragraph_id, st <> '' AS is_heading, CASE WHEN st = 'h2' THEN 2 ELSE 0 END::INT AS heading_level, x AS section,
        coalesce(at_ + 1, -1)::INT AS section_start, CASE WHEN at_ IS NULL THEN -1 ELSE coalesce(nxt - 1, fin) END::INT AS section_end, {_PRIORITY}::INT AS priority FROM z""",
    "word_references": f"""WITH {_LINES}, h AS (SELECT doc_id, pid, CASE WHEN pid % 7 = 0 AND doc_id % 2 = 0 THEN 'References' ELSE line END AS line, {_STYLE} AS st FROM l),
      o AS (SELECT *, {strip('line')} AS t, st <> '' AND {strip('line')} <> '' AS opens FROM h),
      w AS (SELECT *, last_value(CASE WHEN opens THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pid) AS sec FROM o),
      n AS (SELECT doc_id, count(*) AS n FROM w WHERE NOT opens AND t <> '' AND regexp_matches(lower(sec), 'reference|bibliography|参考文献') GROUP BY 1)
      SELECT doc_id, min(pid)::INT AS heading, coalesce(any_value(n.n), 0) AS n FROM o LEFT JOIN n USING (doc_id) WHERE lower(t) = 'references' GROUP BY doc_id""",
    "word_insertions": rf"""WITH {CLAIMS}, f AS (SELECT doc_id, para, regexp_matches(para, '{_CITED}') AS cited FROM pa WHERE pid = 0),
      s AS (SELECT doc_id, arg_min(fin - length(regexp_extract(sent, '[.!?。！？]*$', 0)), sid) AS at_ FROM sp WHERE pid = 0 AND sent <> '' GROUP BY doc_id)
      SELECT f.doc_id, CASE WHEN cited THEN 'skipped_existing|skipped_existing|skipped_existing' WHEN at_ IS NULL THEN 'skip|skip|skip'
          ELSE 'inserted|skipped_existing|skipped_existing' END AS statuses,
        CASE WHEN cited OR at_ IS NULL THEN para ELSE left(para, at_::INT) || ' [77]' || substr(para, at_::INT + 1) END AS text FROM f LEFT JOIN s USING (doc_id)""",
    "closing_markers": rf"""WITH {_LINES}, b AS (SELECT doc_id, pid, regexp_extract(line, '(?s)^(.*?)(\s*)$', 1) AS body, regexp_extract(line, '(?s)^(.*?)(\s*)$', 2) AS tail FROM l)
      SELECT doc_id, pid::INT AS line_no, CASE WHEN regexp_matches(body, '[.!?。！？]$') THEN left(body, -1) || ' [1]' || right(body, 1) ELSE body || ' [1]' END || tail AS text,
        ['citet', 'parencite', 'textcite', 'cite'][pid % 4 + 1] AS command FROM b""",
    "last_reference_number": r"""SELECT coalesce(max(TRY_CAST(x AS INT)), 0)::INT AS last_number FROM (
      SELECT unnest(regexp_extract_all(replace(text, '. ', ' [' || (doc_id % 97) || ']. '), '\[\s*(\d+)(?:\s*[,-]\s*\d+)*\s*\]', 1)) AS x FROM documents)""",
    "bibliography_items": f"""WITH {STYLED}, k AS (SELECT *, {PAPER_ID} AS pid, '[' || (row_number() OVER (ORDER BY doc_id) + 6) || '] ' || concat_ws(' ', nullif({_series('fi', ', and ')}, '') || ',', '"' || title || ',"',
        concat_ws(', ', '*' || venue || '*', year::VARCHAR)) || coalesce(', doi: ' || doi, '') || '.' AS entry FROM q)
      SELECT min(doc_id) AS ord, pid AS key, '\\bibitem{{' || pid || '}} ' || arg_min(entry, doc_id) AS item FROM k WHERE pid NOT IN (SELECT pid FROM k WHERE doc_id % 5 = 0) GROUP BY pid""",
    "apa_list_with_suffixes": f"""WITH {STYLED}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY coalesce(la[1], 'Unknown'), year) > 1 THEN
        chr((96 + row_number() OVER (PARTITION BY coalesce(la[1], 'Unknown'), year ORDER BY doc_id))::INT) ELSE '' END AS sx FROM q)
      SELECT doc_id AS ord, lower(coalesce(la[1], 'Unknown')) AS sort_name, coalesce(year, 9999)::INT AS sort_year,
        replace({APA_ENTRY}, '(' || coalesce(year::VARCHAR, 'n.d.') || ').', '(' || coalesce(year::VARCHAR, 'n.d.') || sx || ').') AS entry FROM s""",
    "two_paper_lists": f"SELECT paper_id, ord, merged_from, source FROM ({DEDUP['dedup_papers']})",
    "long_author_lists": f"""WITH {_NAMES} SELECT doc_id, {_IEEE} AS ieee, CASE WHEN n > 20 THEN array_to_string(li[1:19], ', ') || ', ... ' || li[n] ELSE {_joined('li', ', & ')} END AS apa,
      CASE WHEN n > 5 THEN na[1] || ' et al' ELSE {_joined('na', ' & ')} END AS nature, CASE WHEN n > 6 THEN array_to_string(va[1:6], ', ') || ', et al' ELSE array_to_string(va, ', ') END AS vancouver FROM r""",
    "proceedings_entries": f"""WITH {_NAMES}, {PAPERS} SELECT doc_id, concat_ws(' ', nullif({_IEEE}, '') || ',', '"' || title || ',"', concat_ws(', ',
        CASE WHEN doc_id % 3 = 0 THEN 'in *Proceedings of X*' ELSE '*Journal Y*' END, year::VARCHAR)) || coalesce(', doi: ' || doi, '') || '.' AS ieee,
      CASE WHEN doc_id % 3 = 0 THEN '@inproceedings{{k,' ELSE '@article{{k,' END AS bibtex_kind FROM r JOIN p USING (doc_id)""",
    "combined_markers": f"""WITH {STYLED} SELECT doc_id, '(' || regexp_replace({APA_MARKER}, '^\\(+|\\)+$', '', 'g') || '; Lee, 2020)' AS combined,
      {strip("regexp_replace(concat_ws(' ', 'It may seem that', title, 'often works'), '(?i)\\b(may|might|possibly|perhaps|often|typically|generally|seem(s)?)\\b', '', 'g')")} AS plain,
      coalesce(abs(year - (2000 + doc_id % 25)) <= 1, true) AS close FROM q""",
    "distinct_selected": f"""WITH {GREEDY}, d AS (SELECT {PAPER_ID} AS paper_id, sel.claim_id, doc_id, row_number() OVER (PARTITION BY {PAPER_ID} ORDER BY sel.claim_id, pick) AS r
      FROM t1 JOIN sel USING (claim_id, doc_id)) SELECT paper_id, claim_id, doc_id FROM d WHERE r = 1""",
    "support_buckets": f"""WITH {TOPIC} SELECT claim_id, count(*) FILTER (WHERE support >= 0.6) AS passed, count(*) FILTER (WHERE support >= 0.3 AND support < 0.6) AS rejected, 0::BIGINT AS contradictory,
      count(*) FILTER (WHERE support < 0.3) AS insufficient FROM t0 GROUP BY claim_id""",
    "web_mapped": f"""WITH {PAPERS} SELECT doc_id, 'exa' AS source, title, array_to_string(list_transform(authors, lambda a: 'Exa, ' || split_part(replace(a, ',', ''), ' ', 1)), '|') AS authors,
        coalesce(year, 1990)::INT AS year, 'journal' AS venue_type, coalesce(doi, '') AS doi, 'h' AS abstract FROM p
      UNION ALL SELECT doc_id, 'google_scholar', title, 'Lee, Ann', coalesce(year, -1)::INT, 'other', '', 'a' FROM p""",
    "typed_search": f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY doc_id) AS passed FROM p WHERE doc_id % 2 = 0 AND year BETWEEN 2004 AND 2022)
      SELECT venue AS claim_id, doc_id AS ord, title, year::INT AS year, ['journal', '', 'preprint'][doc_id % 4 + 1] AS venue_type FROM r WHERE passed <= 5""",
}

SQL["whole_audit"] = f"""WITH g AS ({SQL['bibliographic_gate']}),
  r AS (SELECT '8A_bibliographic' AS gate, (sum(n) FILTER (WHERE level = 'FAIL'))::BIGINT AS fails, (sum(n) FILTER (WHERE level = 'WEAK'))::BIGINT AS weak FROM g
    UNION ALL SELECT '8B_entailment', count(*), 0 FROM documents
    UNION ALL SELECT 'chain', sum(n)::BIGINT + {len(REQUIRED_ARTIFACTS)}, 0 FROM ({OTHERS['chain_gaps']}))
  SELECT max('FAIL') OVER () AS overall, gate, CASE WHEN fails > 0 THEN 'FAIL' WHEN weak > 0 THEN 'WEAK' ELSE 'PASS' END AS gate_overall, fails, weak FROM r"""
