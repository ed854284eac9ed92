r"""The catalog queries as plain SQL over the same tables, for comparison.

Fragments in capitals are put together below. RE2 has ASCII word boundaries
and no lookaround, so patterns are rewritten with explicit neighbours.
"""

from __future__ import annotations

import re

from ..functions import claims as C
from ..functions import scores as S
from ..functions.text import STOPWORDS
from . import bridge as B
from .catalog import _TAILS

_W = r"[^\p{L}\p{N}_]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _re2(patterns) -> str:
    """A pattern group as one RE2 alternation."""
    out = []
    for flag, body in patterns:
        body = body.replace("框架(?!理论)", "框架(?:[^理]|理[^论]|理?$)")
        body = re.sub(r"\\b(?=[A-Za-z(])", lambda m: rf"(?:^|{_W})", body)
        body = body.replace(r"\b", rf"(?:$|{_W})")
        out.append(f"(?i:{body})" if flag else f"(?:{body})")
    return _text("|".join(out))


def headline(text: str) -> str:
    return rf"regexp_extract({text}, '^[^.!?\s]+(?: [^.!?\s]+){{0,9}}', 0)"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def norm(text: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')")


def n_words(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> ''))"


def pyround(x: str, digits: int) -> str:
    """Half-even rounding of the binary value, by exact partial products."""
    s = float(10 ** digits)
    return (f"(SELECT CASE WHEN (t - b) - 0.5 > -r OR ((t - b) - 0.5 = -r AND b % 2 = 1) THEN (b + 1) / {s}::DOUBLE ELSE b / {s}::DOUBLE END "
            f"FROM (SELECT t, r, floor(t + r) AS b FROM (SELECT h * {s}::DOUBLE AS t, (x - h) * {s}::DOUBLE AS r FROM "
            f"(SELECT x, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS h FROM (SELECT ({x})::DOUBLE AS x)))))")


def keyword_ctes(name: str, source: str, key: str, text: str, top: int) -> str:
    """CTE `name`(key, kw): ranked keyword list per key."""
    stop = ", ".join(_text(w) for w in STOPWORDS)
    return rf"""
{name}_t AS (SELECT {key} AS k, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
    SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_\-]+') AS t FROM {source})),
{name}_c AS (SELECT k, w, count(*) AS n, min(i) AS i FROM (SELECT k, trim(w, '-') AS w, i FROM {name}_t)
    WHERE regexp_full_match(w, '[a-z][a-z\-]{{2,}}') AND w NOT IN ({stop}) GROUP BY k, w),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS r FROM {name}_c),
{name} AS (SELECT k, list(w ORDER BY r) AS kw FROM {name}_r WHERE r <= {top} GROUP BY k)"""


def coverage(a: str, b: str) -> str:
    return (f"CASE WHEN coalesce(len({a}), 0) > 0 AND coalesce(len({b}), 0) > 0 "
            f"THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0::DOUBLE END")


def last_name(a: str) -> str:
    return rf"CASE WHEN contains({a}, ',') THEN trim(split_part({a}, ',', 1)) ELSE coalesce(regexp_extract({a}, '(\S+)$', 1), '') END"


def _name(slot: int) -> str:
    fam = f"{_list(B.FAMILY_NAMES)}[(letter + {slot}) % 10 + 1]"
    giv = f"{_list(B.GIVEN_NAMES)}[(letter + {slot}) % 4 + 1]"
    return f"CASE WHEN letter % 3 = 0 THEN {fam} || ', ' || {giv} ELSE {giv} || ' ' || {fam} END"


PAPERS = rf"""
p0 AS (SELECT *, {headline('text')} AS title FROM documents),
p1 AS (SELECT *, CASE WHEN title = '' THEN 0 ELSE ascii(lower(title)) END AS letter FROM p0),
p AS (SELECT doc_id, text, lang, source AS venue, n_chars, title, letter,
    list_slice([{_name(0)}, {_name(1)}, {_name(2)}], 1, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE letter % 3 + 1 END) AS authors,
    CASE WHEN doc_id % 11 <> 0 THEN 2000 + letter % 25 END AS year,
    CASE WHEN doc_id % 2 = 0 THEN '10.1000/' || left(sha256(text), 12) END AS doi,
    CASE WHEN doc_id % 5 <> 0 THEN text ELSE '' END AS abstract,
    {_list(B.SOURCES)}[doc_id % 3 + 1] AS src
  FROM p1)"""

PAPER_ID = (f"left(sha256(CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) ELSE 'title:' || {norm('title')} || '|year:' || "
            f"coalesce(year::VARCHAR, '') || '|author:' || lower(coalesce({last_name('authors[1]')}, '')) END), 16)")

REGISTRY = PAPERS + r""",
reg AS (SELECT *, CASE WHEN rid % 10 = 2 THEN left(title, (length(title) * 3 // 10)::INT) ELSE title END AS real_title,
    CASE WHEN rid % 10 = 4 THEN coalesce(year, 2000) + 2 ELSE coalesce(year, 2000) END AS real_year
  FROM (SELECT doi, min(doc_id) AS rid, arg_min({'t': title, 'a': authors, 'y': year}, doc_id) AS s FROM p WHERE doi IS NOT NULL GROUP BY doi),
    LATERAL (SELECT s.t AS title, s.a AS authors, s.y AS year) WHERE rid % 10 <> 0)"""


def _hits(name: str, keep: str) -> str:
    return f"""
{name} AS (SELECT title, year FROM (SELECT title, year, row_number() OVER (PARTITION BY title ORDER BY year NULLS FIRST) AS r
    FROM (SELECT DISTINCT title, year FROM p WHERE {keep} AND title <> '')) WHERE r <= 3)"""


VERIFIED = REGISTRY + "," + _hits("s2", "doc_id % 3 = 0") + "," + _hits("oah", "doc_id % 2 = 1 AND doc_id % 3 <> 2") + rf""",
second AS (SELECT doi, {norm('real_title')} <> '' AND (rid % 3 = 1 OR EXISTS (
    SELECT 1 FROM s2 WHERE s2.title = real_title AND s2.year = real_year)) AS ok FROM reg),
v0 AS (SELECT p.*, reg.rid, reg.authors AS real_authors, real_year, second.ok AS second,
    length({norm('real_title')}) AS n1, length({norm('p.title')}) AS n2
  FROM p LEFT JOIN reg ON reg.doi = p.doi LEFT JOIN second ON second.doi = p.doi),
v1 AS (SELECT *, CASE WHEN n1 = 0 OR n2 = 0 THEN false ELSE 1 - (n2 - n1) / (n1 + n2) >= 0.85 END AS title_ok,
    year IS NULL OR year = real_year AS year_ok,
    (n2 > 0 AND EXISTS (SELECT 1 FROM s2 WHERE s2.title = v0.title AND (v0.year IS NULL OR s2.year = v0.year))) AS in_s2,
    (n2 > 0 AND EXISTS (SELECT 1 FROM oah WHERE oah.title = v0.title AND (v0.year IS NULL OR oah.year = v0.year))) AS in_oa FROM v0),
v AS (SELECT *, CASE WHEN doi IS NULL THEN CASE WHEN in_s2 AND in_oa THEN 'LIKELY_REAL' ELSE 'UNVERIFIED' END
    WHEN rid IS NULL THEN 'UNVERIFIED' WHEN NOT (title_ok AND year_ok) THEN 'CONFLICT'
    WHEN second THEN 'VERIFIED' ELSE 'LIKELY_REAL' END AS status FROM v1)"""

CLAIMS = rf"""
pa AS (SELECT doc_id, unnest(s) AS para, generate_subscripts(s, 1) - 1 AS pid FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
po AS (SELECT *, coalesce(sum(length(para) + 1) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pa),
se AS (SELECT doc_id, pid, off, unnest(m) AS raw, generate_subscripts(m, 1) AS sid FROM (SELECT *, regexp_extract_all(para, '[^.!?。！？；]*[.!?。！？；]["'')】」』”]*|[^.!?。！？；]+\z') AS m FROM po)),
sp AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id, pid ORDER BY sid) AS fin, {strip('raw')} AS sent FROM se),
sk AS (SELECT *, fin - length(raw) + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start_ FROM sp
  WHERE sent <> '' AND {n_words('sent')} >= 4 AND NOT regexp_matches(sent, {_text('(?i)' + C.SELF_REFERENCE)})),
sh AS (SELECT *, list_filter([{", ".join(
    f"CASE WHEN regexp_matches(sent, '(?s)^(.*?)\\s+{w}\\s+(.*)$') THEN [{strip(f'''regexp_extract(sent, '(?s)^(.*?)\\s+{w}\\s+(.*)$', 1)''')}, {strip(f'''regexp_extract(sent, '(?s)^(.*?)\\s+{w}\\s+(.*)$', 2)''')}] END"
    for w in C.CONJUNCTIONS)}], lambda h: h IS NOT NULL AND {n_words('h[1]')} >= 6 AND {n_words('h[2]')} >= 6
    AND NOT contains(lower(h[1]), ' and ') AND NOT contains(h[1], ', and '))[1] AS halves FROM sk),
su AS (SELECT doc_id, pid, sid, off, start_, fin, halves IS NOT NULL AS cut, unnest(coalesce(halves, [sent])) AS original_text,
    generate_subscripts(coalesce(halves, [sent]), 1) - 1 AS part FROM sh),
cl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pid, sid, part) AS claim_no FROM su)"""


def _case_type(t: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({t}, {_re2(pats)}) THEN '{name}'" for name, pats in C.TYPE_PATTERNS)
    return f"CASE {whens} ELSE '{C.DEFAULT_TYPE}' END"


def _case_need(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, {_re2(C.NOT_NEEDED_PATTERNS)}) THEN 'NOT_NEEDED' "
            f"WHEN regexp_matches({t}, {_re2(C.REQUIRED_PATTERNS)}) THEN 'REQUIRED' ELSE 'RECOMMENDED' END")


TAILED = f"""
tc AS (SELECT doc_id, {headline('text')} || ' ' || {_list(_TAILS)}[doc_id % {len(_TAILS)} + 1] AS original_text FROM documents)"""


def _facet(name: str) -> str:
    body = C.FACET_PATTERNS[name]
    core = body[2:] if body.startswith(r"\b") else body
    core = core.replace(r"\w*", r"[\p{L}\p{N}_]*")
    core = core[:-2] if core.endswith(r"\b") else core
    tail = "" if name == "population" else rf"(?:$|{_W})"
    return f"lower(coalesce(regexp_extract(original_text, {_text(rf'(?i)(?:^|{_W})({core}){tail}')}, 1), ''))"


def recency(y: str) -> str:
    a = f"({B.CURRENT_YEAR} - {y})"
    return f"CASE WHEN {y} IS NULL THEN 0.1 WHEN {a} <= 2 THEN 1.0 WHEN {a} <= 5 THEN 0.8 WHEN {a} <= 10 THEN 0.5 WHEN {a} <= 20 THEN 0.3 ELSE 0.1 END::DOUBLE"


def originality(y: str) -> str:
    a = f"({B.CURRENT_YEAR} - {y})"
    return f"CASE WHEN {y} IS NULL THEN 0.5 WHEN {a} >= 20 THEN 1.0 WHEN {a} >= 10 THEN 0.8 WHEN {a} >= 5 THEN 0.5 ELSE 0.3 END::DOUBLE"


def authority(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN 0.1::DOUBLE ELSE {pyround(f'least(1.0::DOUBLE, log10({c} + 1) / 4.0::DOUBLE)', 4)} END"


def level(s: str) -> str:
    return f"CASE WHEN {s} >= 0.75 THEN 'DIRECT' WHEN {s} >= 0.6 THEN 'PARTIAL' WHEN {s} >= 0.3 THEN 'BACKGROUND' ELSE 'INSUFFICIENT_EVIDENCE' END"


# --- names for the citation styles ------------------------------------------------

def _initials(given: str) -> str:
    return (rf"array_to_string(list_transform(list_filter(regexp_split_to_array({given}, '[\s\-]+'), lambda g: g <> ''), "
            rf"lambda g: upper(left(g, 1)) || '.'), ' ')")


_GIVEN = r"CASE WHEN contains(a, ',') THEN trim(regexp_replace(a, '^[^,]*,', '')) ELSE regexp_replace(a, '\s+\S+$', '') END"
FIRST_FORM = f"{_initials(_GIVEN)} || ' ' || {last_name('a')}"
LAST_FORM = f"{last_name('a')} || ', ' || {_initials(_GIVEN)}"
STYLED = PAPERS + f""",
q AS (SELECT *, list_transform(authors, lambda a: {FIRST_FORM}) AS fi, list_transform(authors, lambda a: {LAST_FORM}) AS li,
    list_transform(authors, lambda a: {last_name('a')}) AS la, len(authors) AS na FROM p)"""


def _series(names: str, joint: str) -> str:
    return (f"CASE na WHEN 0 THEN '' WHEN 1 THEN {names}[1] WHEN 2 THEN {names}[1] || '{joint}' || {names}[2] "
            f"ELSE {names}[1] || ', ' || {names}[2] || '{joint}' || {names}[3] END")


_VANC = "list_transform(li, lambda a: replace(replace(a, ',', ''), '.', ''))"
APA_ENTRY = (f"concat_ws(' ', nullif({_series('li', ', & ')}, ''), '(' || coalesce(year::VARCHAR, 'n.d.') || ').', title || '.', "
             "'*' || venue || '*.', 'https://doi.org/' || doi)")
APA_MARKER = ("'(' || CASE na WHEN 0 THEN 'Unknown' WHEN 1 THEN la[1] WHEN 2 THEN la[1] || ' & ' || la[2] ELSE la[1] || ' et al.' END "
              "|| ', ' || coalesce(year::VARCHAR, 'n.d.') || ')'")

TOPIC = PAPERS + f""",
t0 AS (SELECT doc_id, venue AS claim_id, n_chars, year, title, doi, authors, abstract, (doc_id % 10) / 10 AS tier, (doc_id % 41) / 40 AS support,
    lower(coalesce(authors[1], '')) AS author, 'v' || (doc_id % 3) AS ven,
    ascii(right(venue, 1)) % 2 = 0 AS current_state, doc_id % 7 <> 0 AS real_ FROM p),
t1 AS (SELECT *, CASE WHEN support < 0.6 THEN 'below_threshold' WHEN NOT real_ THEN 'not_verified' END AS reason,
    CASE WHEN tier = 0 THEN 0.1::DOUBLE ELSE tier END AS tier1 FROM t0),
t2 AS (SELECT *, {pyround(authority('n_chars') + " * 0.7::DOUBLE + tier1 * 0.3::DOUBLE", 4)} AS mauth, {authority('n_chars')} AS auth FROM t1 WHERE reason IS NULL),
t3 AS (SELECT *, CASE WHEN current_state THEN 3 ELSE 2 END AS k FROM t2)"""


def _composite(div: str) -> str:
    """Weighted sums of the two profiles in use, terms in the fixed order."""
    cur = (f"support * 0.4::DOUBLE + tier1 * 0.25::DOUBLE + {recency('year')} * 0.25::DOUBLE + {originality('year')} * 0.0::DOUBLE "
           f"+ auth * 0.0::DOUBLE + mauth * 0.0::DOUBLE + ({div})::DOUBLE * 0.1::DOUBLE")
    met = (f"support * 0.4::DOUBLE + tier1 * 0.0::DOUBLE + {recency('year')} * 0.05::DOUBLE + {originality('year')} * 0.0::DOUBLE "
           f"+ auth * 0.0::DOUBLE + mauth * 0.35::DOUBLE + ({div})::DOUBLE * 0.0::DOUBLE")
    return pyround(f"CASE WHEN current_state THEN {cur} ELSE {met} END", 4)


def _clash(author: str, venue: str) -> str:
    return f"CASE WHEN author <> '' AND author = {author} THEN 0.6 WHEN ven = {venue} THEN 0.7 END"


GREEDY = TOPIC + f""",
c1 AS (SELECT *, {_composite('1.0')} AS c1 FROM t3),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY c1 DESC, doc_id) AS r FROM c1) WHERE r = 1),
c2 AS (SELECT x.*, {_composite("coalesce(" + _clash('a1', 'v1') + ", 1.0)")} AS c2 FROM (
    SELECT c.*, s.author AS a1, s.ven AS v1 FROM c1 c JOIN s1 s USING (claim_id) WHERE c.doc_id <> s.doc_id) x),
s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY c2 DESC, c1 DESC, doc_id) AS r FROM c2) WHERE r = 1),
c3 AS (SELECT x.*, {_composite("coalesce(" + _clash('a1', 'v1') + ", " + _clash('a2', 'v2') + ", 1.0)")} AS c3 FROM (
    SELECT c.*, s.author AS a2, s.ven AS v2 FROM c2 c JOIN s2 s USING (claim_id) WHERE c.doc_id <> s.doc_id AND c.k >= 3) x),
s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY c3 DESC, c2 DESC, c1 DESC, doc_id) AS r FROM c3) WHERE r = 1),
sel AS (SELECT claim_id, doc_id, 1 AS pick, c1 AS composite_score FROM s1 UNION ALL SELECT claim_id, doc_id, 2, c2 FROM s2
  UNION ALL SELECT claim_id, doc_id, 3, c3 FROM s3)"""

# --- keyword scoring ----------------------------------------------------------------

KEYWORDED = PAPERS + rf""",
k0 AS (SELECT *, left({strip('abstract')}, 2000) AS ev FROM p),""" + keyword_ctes("ek", "k0", "doc_id", "ev", 50) + "," + keyword_ctes("tk", "k0", "doc_id", "title", 50) + """,
kp AS (SELECT k0.*, ek.kw AS evk, tk.kw AS tik FROM k0 LEFT JOIN ek ON ek.k = doc_id LEFT JOIN tk ON tk.k = doc_id)"""


def _contra(claim: str, ev: str) -> str:
    return (f"regexp_matches({claim}, {_re2((('i', S.ASSERTION),))}) AND regexp_matches({ev}, {_re2((('i', S.NEGATION),))})")


SCORE_STEPS = """
raw AS (SELECT *, least(1.0::DOUBLE, a * 0.75::DOUBLE + t * 0.25::DOUBLE) AS r0 FROM ov),
low AS (SELECT *, CASE WHEN r0 < 0.3 THEN least(r0, 0.29::DOUBLE) ELSE r0 END AS r1 FROM raw)"""
_SCORE = (f"CASE WHEN ev = '' THEN {pyround('t * 0.5::DOUBLE', 2)} WHEN contra THEN 0.1::DOUBLE ELSE {pyround('r1', 2)} END")
_LEVEL = f"CASE WHEN ev = '' THEN 'INSUFFICIENT_EVIDENCE' WHEN contra THEN 'CONTRADICTORY' ELSE {level('r1')} END"

PAIRS = KEYWORDED + "," + keyword_ctes("ck", "benchmark", "item_id", "text", 50) + f""",
ov AS (SELECT 'C' || lpad(item_id::VARCHAR, greatest(3, length(item_id::VARCHAR))::INT, '0') AS claim_id, b.text AS claim, kp.doc_id, ev, year, n_chars, title, quality,
    {coverage('ck.kw', 'evk')} AS a, {coverage('ck.kw', 'tik')} AS t, ({_contra('b.text', 'ev')}) AS contra, ck.kw AS ckw
  FROM benchmark b JOIN ck ON ck.k = item_id, kp LEFT JOIN labels ON labels.doc_id = kp.doc_id),""" + SCORE_STEPS + f""",
sc AS (SELECT *, {_SCORE} AS score, {_LEVEL} AS lvl, CASE WHEN quality = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verdict,
    {_case_type('claim')} AS kind FROM low),
gt AS (SELECT *, CASE WHEN score < 0.6 THEN 'below_threshold' WHEN verdict <> 'VERIFIED' THEN 'not_verified'
    WHEN lvl IN ('CONTRADICTORY', 'INSUFFICIENT_EVIDENCE') THEN 'blocked_level' ELSE '' END AS reason FROM sc)"""

LOG = PAPERS + f""",
lg AS (SELECT pid, arg_max(verdict, ord) AS verdict FROM (
    SELECT {PAPER_ID} AS pid, CASE WHEN quality = 1 THEN 'VERIFIED' WHEN toxic = 1 THEN 'CONFLICT' ELSE 'LIKELY_REAL' END AS verdict, doc_id AS ord FROM labels JOIN p USING (doc_id)
    UNION ALL SELECT {PAPER_ID}, 'UNVERIFIED', doc_id + 1000000000 FROM labels JOIN p USING (doc_id) WHERE doc_id % 4 = 0) GROUP BY pid),
fp AS (SELECT *, {PAPER_ID} AS pid FROM p WHERE doc_id % 3 = 0)"""

REFS = STYLED + f""",
fin AS (SELECT lower(left(title, 60)) AS frag FROM p WHERE doc_id % 3 = 0 AND title <> ''),
ref AS (SELECT DISTINCT lower({APA_ENTRY}) AS body FROM q WHERE doc_id % 4 <> 1),
gap AS (SELECT frag FROM fin WHERE NOT EXISTS (SELECT 1 FROM ref WHERE contains(body, frag))),
own AS (SELECT DISTINCT doi FROM p WHERE doc_id % 3 = 0 AND doi IS NOT NULL)"""

_FLIP = rf"CASE WHEN contains(a, ',') THEN a ELSE {last_name('a')} || ', ' || regexp_replace(a, '\s+\S+$', '') END"
_FLIP_ALL = rf"regexp_extract(a, '(\S+)$', 1) || ', ' || regexp_replace(a, '\s+\S+$', '')"

VENUES = "['Oncotarget', 'Nature', 'Proc. of ICML', 'machine letters', '学报', '', 'Plos One', 'Journal X']"

CONCEPTS = (TAILED + "," + keyword_ctes("kw", "tc", "doc_id", "original_text", 6) + f""",
      m AS (SELECT doc_id, coalesce(kw, []) AS kw,
        CASE WHEN regexp_matches(original_text, '[一-鿿]') THEN list_transform(list_filter([{", ".join("{'zh': " + _text(k) + ", 'en': " + _text(v) + "}" for k, v in C.CHINESE_TERMS.items())}],
          lambda e: contains(original_text, e.zh)), lambda e: e.en) ELSE [] END AS z,
        flatten(list_transform(list_filter([{", ".join("{'p': " + _text(k) + ", 'a': " + _list(v) + "}" for k, v in C.SYNONYMS.items())}],
          lambda e: contains(lower(original_text), e.p)), lambda e: e.a)) AS al FROM tc LEFT JOIN kw ON k = doc_id),
      d AS (SELECT doc_id, kw, list_filter(z, lambda x, i: list_position(z, x) = i) AS z, list_filter(al, lambda x, i: list_position(al, x) = i) AS al FROM m),
      c AS (SELECT *, list_concat(z, list_filter(kw, lambda x: NOT list_contains(z, x))) AS base FROM d),
      e AS (SELECT *, list_filter(al, lambda x: NOT list_contains(base, x)) AS added,
        CASE WHEN len(kw) > 0 THEN list_concat(z, list_filter(al, lambda x: NOT list_contains(z, x))) ELSE z END AS syn FROM c),
      ce AS (SELECT doc_id, list_concat(base, added)[1:8] AS concepts, list_concat(syn, added)[1:8] AS synonyms FROM e)""")


def _cut(text: str) -> str:
    parts = rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"
    return f"CASE WHEN len({parts}) <= {C.MAX_QUERY_WORDS} THEN {text} ELSE array_to_string(({parts})[1:{C.MAX_QUERY_WORDS}], ' ') END"


# The queries of a claim: one concept is swapped for a synonym at its first
# place between word boundaries.
QUERIES = CONCEPTS + rf""",
q0 AS (SELECT doc_id, {strip('original_text')} AS norm, concepts, synonyms, {_facet('population')} AS pop, {_case_type('original_text')} AS ctype,
    {_case_need('original_text')} AS need FROM tc JOIN ce USING (doc_id)),
q1 AS (SELECT *, list_filter(synonyms, lambda a: {n_words('a')} >= 2 AND NOT contains(lower(norm), lower(a))) AS fresh,
    list_filter(concepts, lambda c: c <> '' AND contains(lower(norm), lower(c))) AS present, array_to_string(concepts[1:3], ' ') AS base FROM q0),
q2 AS (SELECT *, list_filter(list_transform(present, lambda c: {{'c': c, 'a': list_filter(fresh, lambda a: lower(a) <> lower(c))[1]}}), lambda s: s.a IS NOT NULL)[1] AS swap FROM q1),
q3 AS (SELECT doc_id, need, list_filter([
    {{'type': 'precise', 'query': {_cut('norm')}}},
    CASE WHEN len(concepts) > 0 AND array_to_string(concepts[1:6], ' ') <> '' THEN {{'type': 'broad', 'query': {_cut("array_to_string(concepts[1:6], ' ')")}}} END,
    CASE WHEN len(concepts) > 0 AND len(synonyms) > 0 AND swap IS NOT NULL THEN {{'type': 'synonym', 'query': {_cut(
        "regexp_replace(norm, '(?i)(^|' || " + _text(_W) + " || ')' || regexp_escape(swap.c) || '($|' || " + _text(_W) + " || ')', '" + r"\1' || swap.a || '\2" + "')")}}} END,
    CASE WHEN len(concepts) > 0 THEN {{'type': 'domain', 'query': {_cut("CASE WHEN pop <> '' THEN base || ' ' || pop WHEN len(synonyms) > 0 THEN base || ' ' || synonyms[1] ELSE base END")}}} END,
    {", ".join(f"CASE WHEN ctype = {_text(n)} THEN {{'type': {_text(k)}, 'query': {_cut('(norm || ' + _text(x) + ')')}}} END" for n, (k, x) in C.TYPE_QUERY_SUFFIX.items())}],
    lambda q: q IS NOT NULL) AS made FROM q2),
q4 AS (SELECT doc_id, need, list_filter(made, lambda q, i: len(list_filter(made[1:i - 1], lambda e: lower(e.query) = lower(q.query))) = 0) AS qs FROM q3)"""

ORACLE: dict[str, str] = {
    "keyword_top10": "WITH " + keyword_ctes("kw", "documents", "doc_id", "text", 10)
    + " SELECT doc_id, coalesce(array_to_string(kw, '|'), '') AS keywords FROM documents LEFT JOIN kw ON k = doc_id",
    "keyword_overlap": f"WITH h AS (SELECT *, {headline('text')} AS head FROM documents)," + keyword_ctes("a", "h", "doc_id", "head", 50) + ","
    + keyword_ctes("b", "h", "doc_id", "text", 50)
    + f" SELECT doc_id, {coverage('a.kw', 'b.kw')} AS overlap FROM documents LEFT JOIN a ON a.k = doc_id LEFT JOIN b ON b.k = doc_id",
    "sentence_list": rf"""WITH f AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
        string_split(regexp_replace({strip('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: {strip('y')}), lambda y: y <> '') AS s FROM documents)),
      g AS (SELECT *, sum(CASE WHEN i = 1 OR {n_words('x')} >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
      SELECT doc_id, (n - 1)::INT AS sentence_no, string_agg(x, ' ' ORDER BY i) AS sentence FROM g GROUP BY doc_id, n""",
    "title_similarity_steps": f"WITH {PAPERS} SELECT doc_id, round(CASE WHEN n1 = 0 OR n2 = 0 THEN 0 ELSE 1 - (n1 - n2) / (n1 + n2) END, 9) AS similarity "
    f"FROM (SELECT doc_id, length({norm('title')}) AS n1, length({norm('left(title, (length(title) // 3)::INT)')}) AS n2 FROM p)",
    "author_forms": f"WITH {PAPERS} SELECT doc_id, {last_name('a')} AS last_name, {FIRST_FORM} AS initials_first, {LAST_FORM} AS last_initials, "
    rf"CASE WHEN contains(a, ',') THEN a ELSE {last_name('a')} || ', ' || regexp_replace(a, '\s+\S+$', '') END AS family_given "
    "FROM (SELECT doc_id, authors[1] AS a FROM p WHERE len(authors) > 0)",
    "doi_normalise": "SELECT doc_id, '10.1000/ab' || doc_id AS doi FROM documents",
    "paper_ids": f"WITH {PAPERS} SELECT doc_id, {PAPER_ID} AS paper_id FROM p",
    "bibtex_keys": rf"""WITH {PAPERS}, w AS (SELECT doc_id, list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{4,}}')
        AND NOT list_contains({_list(STOPWORDS)}, lower(x)))[1] AS kw FROM p)
      SELECT doc_id, coalesce(nullif({last_name('authors[1]')}, ''), 'unknown') || '_' || coalesce(year::VARCHAR, 'xxxx') || '_' || lower(coalesce(kw, 'paper')) AS bibtex_key FROM p JOIN w USING (doc_id)""",
    "claim_extraction": f"""WITH {CLAIMS} SELECT doc_id, claim_no, 'C' || lpad(claim_no::VARCHAR, greatest(3, length(claim_no::VARCHAR))::INT, '0') AS claim_id, original_text,
      pid::INT AS paragraph_id, part::INT AS sentence_id, CASE WHEN NOT cut THEN (start_ + off)::INT ELSE -1 END AS char_start, CASE WHEN NOT cut THEN (fin + off)::INT ELSE -1 END AS char_end,
      cut AS split_from_compound FROM cl""",
    "claim_classes": f"WITH {CLAIMS} SELECT doc_id, claim_no, {_case_type('original_text')} AS claim_type, {_case_need('original_text')} AS citation_need FROM cl",
    "claim_class_counts": f"WITH {CLAIMS} SELECT {_case_type('original_text')} AS claim_type, {_case_need('original_text')} AS citation_need, count(*) AS n FROM cl GROUP BY 1, 2",
    "claim_type_branches": f"WITH {TAILED} SELECT doc_id, {_case_type('original_text')} AS claim_type, {_case_need('original_text')} AS citation_need FROM tc",
    "claim_facets": f"WITH {TAILED} SELECT doc_id, {_facet('population')} AS population, {_facet('geography')} AS geography, {_facet('time')} AS time FROM tc",
    "year_scores": f"WITH {PAPERS} SELECT doc_id, {recency('year')} AS recency, {originality('year')} AS originality FROM p",
    "authority_scores": f"WITH {PAPERS}, a AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN 0.1::DOUBLE ELSE (doc_id % 10) / 10 END AS tier, {authority('n_chars')} AS authority FROM p) "
    f"SELECT doc_id, authority, {pyround('authority * 0.7::DOUBLE + tier * 0.3::DOUBLE', 4)} AS method_authority FROM a",
    "support_bands": f"SELECT event_id, {level('(value / 100)')} AS level, CASE WHEN event_id % 3 = 0 THEN value / 100 ELSE least(value / 100, 0.74::DOUBLE) END AS capped, "
    f"{pyround('value / 100', 2)} AS rounded FROM events",
    "composite_scores": f"""WITH {PAPERS}, a AS (SELECT doc_id, year, (doc_id % 101) / 100 AS support, doc_id % 4 AS kind, CASE WHEN doc_id % 10 = 0 THEN 0.1::DOUBLE ELSE (doc_id % 10) / 10 END AS tier1, {authority('n_chars')} AS auth FROM p),
      b AS (SELECT *, {pyround('auth * 0.7::DOUBLE + tier1 * 0.3::DOUBLE', 4)} AS mauth, {recency('year')} AS rec, {originality('year')} AS orig FROM a)
      SELECT doc_id, ['DEFINITION', 'FOUNDATIONAL', 'METHOD', 'CURRENT_EMPIRICAL'][kind + 1] AS profile, {pyround(
        '''CASE kind WHEN 0 THEN support * 0.5::DOUBLE + tier1 * 0.0::DOUBLE + rec * 0.0::DOUBLE + orig * 0.3::DOUBLE + auth * 0.2::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        WHEN 1 THEN support * 0.4::DOUBLE + tier1 * 0.0::DOUBLE + rec * 0.05::DOUBLE + orig * 0.35::DOUBLE + auth * 0.2::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        WHEN 2 THEN support * 0.4::DOUBLE + tier1 * 0.0::DOUBLE + rec * 0.05::DOUBLE + orig * 0.0::DOUBLE + auth * 0.0::DOUBLE + mauth * 0.35::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        ELSE support * 0.4::DOUBLE + tier1 * 0.25::DOUBLE + rec * 0.25::DOUBLE + orig * 0.0::DOUBLE + auth * 0.0::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.1::DOUBLE END''', 4)} AS composite FROM b""",
    "contradiction_flags": f"SELECT doc_id, doc_id % 2 = 0 AND (doc_id % 3 <> 2 OR regexp_matches(text, {_re2((('i', S.NEGATION),))})) AS contradictory FROM documents",
    "blacklist_anti": f"""SELECT doc_id, {VENUES}[doc_id % 8 + 1] AS venue, 'Open Press' AS publisher, NULL::VARCHAR AS issn_l FROM documents
      WHERE doc_id % 8 NOT IN (0, 6) AND doc_id % 17 <> 0 AND doc_id % 23 <> 0""",
    "venue_tiers": f"""WITH s AS (SELECT 'src' || (s_suppkey % 20) AS venue, arg_min(s_suppkey % 13, s_suppkey) AS c FROM supplier GROUP BY 1),
      u AS (SELECT doc_id, source AS venue, doc_id AS d, NULL AS issn FROM documents UNION ALL SELECT -doc_id - 1, {VENUES}[doc_id % 8 + 1], doc_id, CASE WHEN doc_id % 23 = 0 THEN 'x' END FROM documents)
      SELECT u.doc_id, CASE WHEN d % 19 = 0 OR (u.venue NOT LIKE 'src%' AND u.venue IN ('Proc. of ICML', 'machine letters', '学报')) THEN 0.8
        WHEN issn IS NOT NULL OR c IS NULL THEN 0.1 WHEN c > 10 THEN 0.95 WHEN c > 5 THEN 0.8 WHEN c > 2 THEN 0.6 WHEN c > 0.5 THEN 0.4 ELSE 0.2 END::DOUBLE AS tier
      FROM u LEFT JOIN s ON s.venue = u.venue""",
    "inverted_index_abstract": rf"SELECT doc_id, {strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')} AS abstract FROM documents",
    "jats_strip": f"SELECT doc_id, {strip('text')} AS abstract FROM documents",
    "crossref_mapped": rf"""WITH {REGISTRY} SELECT doi, real_title AS title, array_to_string(list_transform(authors, lambda a: CASE WHEN contains(a, ',') THEN a ELSE
      regexp_extract(a, '(\S+)$', 1) || ', ' || regexp_replace(a, ' \S+$', '') END), '|') AS authors, real_year::INT AS year, 'journal' AS venue_type, 'A' AS abstract, 'https://doi.org/' || doi AS url FROM reg""",
    "openalex_mapped": rf"""SELECT doc_id, CASE WHEN {headline('text')} = '' THEN 'alt' ELSE {headline('text')} END AS title, source || ', Ann B.' AS authors, (2000 + doc_id % 20)::INT AS year, source AS venue,
      ['journal', 'preprint', 'conference', 'other'][doc_id % 4 + 1] AS venue_type, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 3 = 0 THEN '3-9' ELSE '3' END AS pages, doc_id % 2 = 0 AS is_oa,
      length({strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')})::INT AS abstract_chars FROM documents""",
    "page_titles": f"SELECT page_id, {norm(r'''regexp_extract(html, '(?s)<title>(.*?)</title>', 1)''')} AS title FROM pages",
    "dedup_doi_merge": f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id % 3, doc_id) AS rn,
        len(list_filter(authors, lambda a: contains(a, ','))) * 1000 + len(authors) * 10 + length(array_to_string(authors, '')) AS aq FROM p WHERE doi IS NOT NULL),
      s AS (SELECT doi, string_agg(src, '|' ORDER BY rn) AS apis FROM (SELECT doi, src, min(rn) AS rn FROM r GROUP BY doi, src) GROUP BY doi)
      SELECT doi AS doi_key, count(*) AS n, arg_min(title, rn) AS title, array_to_string(arg_min(authors, aq * -1000000 + rn), '|') AS authors, coalesce(arg_min(year, rn) FILTER (year IS NOT NULL), -1)::INT AS year,
        arg_min(venue, rn) AS venue, max(n_chars) AS citation_count, replace(any_value(apis), '|', '+') AS source, any_value(apis) AS source_apis, bool_or(doc_id % 7 = 0) AS is_oa,
        arg_min(length(abstract), rn)::INT AS abstract_chars, CASE WHEN bool_or(doc_id % 17 <> 0) THEN 'Open Press' ELSE 'MDPI AG' END AS publisher, NULL::VARCHAR AS volume, '1-' || max(n_chars) AS pages
      FROM r JOIN s USING (doi) GROUP BY doi""",
    "dedup_copies": f"WITH {PAPERS} SELECT sha256({norm('abstract')} || lang) AS doi_key, count(*) AS n, min(doc_id) AS ord FROM p GROUP BY 1",
    "verification": rf"""WITH {VERIFIED} SELECT doc_id, status AS verification_status, CASE WHEN doi IS NOT NULL AND rid IS NOT NULL THEN year_ok::VARCHAR ELSE '' END AS year_match,
      CASE WHEN doi IS NOT NULL AND rid IS NULL THEN 'NOT_FOUND' ELSE '' END AS doi_status,
      CASE WHEN status = 'CONFLICT' THEN (NOT title_ok)::INT + (NOT year_ok)::INT ELSE 0 END AS reasons,
      CASE WHEN doi IS NULL THEN concat_ws('+', CASE WHEN in_s2 THEN 'semantic_scholar' END, CASE WHEN in_oa THEN 'openalex' END) ELSE '' END AS matched,
      array_to_string(CASE WHEN status = 'VERIFIED' AND len(real_authors) > 0 THEN list_transform(authors, lambda a: CASE WHEN contains(a, ',') THEN a ELSE
        regexp_extract(a, '(\S+)$', 1) || ', ' || regexp_replace(a, ' \S+$', '') END) ELSE authors END, '|') AS authors FROM v""",
    "verdict_counts": f"WITH {VERIFIED} SELECT count(*) FILTER (status = 'VERIFIED') AS VERIFIED, count(*) FILTER (status = 'LIKELY_REAL') AS LIKELY_REAL, "
    "count(*) FILTER (status = 'UNVERIFIED') AS UNVERIFIED, count(*) FILTER (status = 'CONFLICT') AS CONFLICT FROM v",
    "kept_rejected": f"WITH {VERIFIED} SELECT doc_id, CASE WHEN status IN ('VERIFIED', 'LIKELY_REAL') THEN 'kept' ELSE 'rejected' END AS part FROM v",
    "latest_verdicts": "SELECT user_id::VARCHAR AS paper_id, arg_max(event_type, event_id) AS verdict, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id",
    "evidence_sources": rf"""WITH {REGISTRY}, d AS (SELECT p.*, {strip('abstract')} AS own, o.n AS oa, CASE WHEN s.n > 0 THEN s.n END AS s2,
        CASE WHEN p.doc_id % 15 = 5 THEN length({strip("'On ' || title")}) END AS ax FROM p
        LEFT JOIN (SELECT reg.doi, length({strip(r'''regexp_replace(text, '\s+', ' ', 'g')''')}) AS n FROM reg JOIN documents ON doc_id = rid WHERE rid % 3 = 1) o ON o.doi = p.doi
        LEFT JOIN (SELECT doi, min(length({strip("'summary of ' || title")})) AS n FROM p WHERE doi IS NOT NULL AND doc_id % 4 = 0 GROUP BY doi) s ON s.doi = p.doi)
      SELECT doc_id, CASE WHEN own <> '' OR oa > 0 OR s2 > 0 THEN 'ABSTRACT' WHEN ax > 0 THEN 'SUMMARY' ELSE 'METADATA_ONLY' END AS evidence_level,
        CASE WHEN own <> '' THEN 'search_result' WHEN oa > 0 THEN 'openalex' WHEN s2 > 0 THEN 'semantic_scholar' WHEN ax > 0 THEN 'arxiv_api' ELSE 'title_metadata' END AS evidence_source,
        least(2000, CASE WHEN own <> '' THEN length(own) WHEN oa > 0 THEN oa WHEN s2 > 0 THEN s2 ELSE coalesce(ax, 0) END)::INT AS evidence_chars FROM d""",
    "support_scores": f"WITH {KEYWORDED}, c0 AS (SELECT doc_id, title || ' ' || reverse(lang) || ' improves reliability' AS claim FROM p)," + keyword_ctes("ck", "c0", "doc_id", "claim", 50)
    + f", ov AS (SELECT kp.doc_id, ev, {coverage('ck.kw', 'evk')} AS a, {coverage('ck.kw', 'tik')} AS t, {_contra('claim', 'ev')} AS contra FROM kp JOIN c0 USING (doc_id) LEFT JOIN ck ON ck.k = kp.doc_id),"
    + SCORE_STEPS + f" SELECT doc_id, {_SCORE} AS support_score, {_LEVEL} AS support_level, 'heuristic' AS scoring_method FROM low",
    "gate_reasons": f"WITH {PAIRS} SELECT claim_id, doc_id, score AS support_score, reason AS reject_reason FROM gt WHERE score >= 0.6",
    "support_top1": f"""WITH {PAIRS}, g AS (SELECT *, {authority('n_chars')} AS auth, {recency('year')} AS rec, {originality('year')} AS orig FROM gt WHERE reason = ''),
      h AS (SELECT *, {pyround('auth * 0.7::DOUBLE + 0.4::DOUBLE * 0.3::DOUBLE', 4)} AS mauth FROM g),
      c AS (SELECT *, {pyround("""CASE kind WHEN 'DEFINITION' THEN score * 0.5::DOUBLE + 0.4::DOUBLE * 0.0::DOUBLE + rec * 0.0::DOUBLE + orig * 0.3::DOUBLE + auth * 0.2::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        WHEN 'METHOD' THEN score * 0.4::DOUBLE + 0.4::DOUBLE * 0.0::DOUBLE + rec * 0.05::DOUBLE + orig * 0.0::DOUBLE + auth * 0.0::DOUBLE + mauth * 0.35::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        WHEN 'THEORETICAL' THEN score * 0.4::DOUBLE + 0.4::DOUBLE * 0.0::DOUBLE + rec * 0.05::DOUBLE + orig * 0.35::DOUBLE + auth * 0.2::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        WHEN 'HISTORICAL' THEN score * 0.4::DOUBLE + 0.4::DOUBLE * 0.0::DOUBLE + rec * 0.05::DOUBLE + orig * 0.35::DOUBLE + auth * 0.2::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.0::DOUBLE
        ELSE score * 0.4::DOUBLE + 0.4::DOUBLE * 0.25::DOUBLE + rec * 0.25::DOUBLE + orig * 0.0::DOUBLE + auth * 0.0::DOUBLE + mauth * 0.0::DOUBLE + 1.0::DOUBLE * 0.1::DOUBLE END""", 4)} AS comp FROM h),
      r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY comp DESC, doc_id) AS n FROM c)
      SELECT 'C' || lpad(item_id::VARCHAR, greatest(3, length(item_id::VARCHAR))::INT, '0') AS claim_id, coalesce(r.doc_id, -1) AS doc_id, coalesce(r.score, -1.0)::DOUBLE AS support_score, coalesce(r.lvl, '') AS support_level,
        coalesce(r.comp, -1.0)::DOUBLE AS composite_score, CASE WHEN r.doc_id IS NULL THEN 'NO_SUPPORT' ELSE 'SELECTED' END AS selection_status
      FROM benchmark LEFT JOIN r ON r.claim_id = 'C' || lpad(item_id::VARCHAR, greatest(3, length(item_id::VARCHAR))::INT, '0') AND r.n = 1""",
    "greedy_selection": f"WITH {GREEDY} SELECT claim_id, doc_id, pick::INT AS pick, composite_score FROM sel",
    "topk_first_pick": f"WITH {GREEDY} SELECT claim_id, doc_id, composite_score FROM sel WHERE pick = 1",
    "rejected_pairs": f"WITH {GREEDY} SELECT t1.claim_id, coalesce(reason, 'outranked') AS reject_reason, count(*) AS n FROM t1 LEFT JOIN sel USING (claim_id, doc_id) WHERE pick IS NULL GROUP BY 1, 2",
    "claim_links": f"WITH {GREEDY} SELECT t1.claim_id, {PAPER_ID} AS paper_id, doi, {level('support')} AS support_level, 'SELECTED' AS selection_status, least(1000, length(abstract))::INT AS evidence_chars FROM t1 JOIN sel USING (claim_id, doc_id)",
    "ieee_entries": f"""WITH {STYLED} SELECT doc_id, '[' || (doc_id + 1) || '] ' || concat_ws(' ', nullif({_series('fi', ', and ')}, '') || ',', '"' || title || ',"', concat_ws(', ', '*' || venue || '*', year::VARCHAR))
      || coalesce(', doi: ' || doi, '') || '.' AS entry FROM q""",
    "apa_entries": f"WITH {STYLED} SELECT doc_id, {APA_ENTRY} AS entry FROM q",
    "nature_entries": f"WITH {STYLED}, n AS (SELECT *, list_transform(li, lambda a: replace(a, ',', '')) AS pl FROM q) SELECT doc_id, concat_ws(' ', (doc_id + 1) || '.', nullif({_series('pl', ' & ')}, '') || '.', title || '.', "
    "CASE WHEN year IS NULL THEN '*' || venue || '*.' ELSE '*' || venue || '* (' || year || ').' END) AS entry FROM n",
    "vancouver_entries": f"WITH {STYLED} SELECT doc_id, concat_ws(' ', (doc_id + 1) || '.', nullif(array_to_string({_VANC}, ', '), '') || '.', title || '.', venue || '.', year || '.') AS entry FROM q",
    "gbt_entries": f"WITH {STYLED} SELECT doc_id, '[' || (doc_id + 1) || '] ' || concat_ws(' ', nullif(array_to_string({_VANC}, ', '), '') || '.', title || '[J].', venue || ',', year || '.', 'DOI: ' || doi || '.') AS entry FROM q",
    "bibtex_entries": rf"""WITH {STYLED}, w AS (SELECT *, coalesce(nullif({last_name('authors[1]')}, ''), 'unknown') || '_' || coalesce(year::VARCHAR, 'xxxx') || '_' || lower(coalesce(list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+'),
        lambda x: regexp_full_match(x, '[A-Za-z]{{4,}}') AND NOT list_contains({_list(STOPWORDS)}, lower(x)))[1], 'paper')) AS base FROM q
        WHERE doi IS NULL OR doi NOT IN (SELECT doi FROM p WHERE doc_id % 6 = 0 AND doi IS NOT NULL)),
      n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS nth FROM w),
      k AS (SELECT *, CASE WHEN nth = 1 THEN base ELSE base || '_' || nth END AS bk FROM n)
      SELECT doc_id AS ord, bk AS bibtex_key, '@article{{' || bk || ',' || chr(10) || concat_ws(',' || chr(10), '  title     = {{' || title || '}}', '  author    = {{' || nullif(array_to_string(authors, ' and '), '') || '}}',
        '  journal  = {{' || venue || '}}', '  year      = {{' || year || '}}', '  doi       = {{' || doi || '}}') || chr(10) || '}}' AS entry FROM k""",
    "apa_markers": f"WITH {STYLED} SELECT doc_id, {APA_MARKER} AS marker, CASE na WHEN 0 THEN 'Unknown' WHEN 1 THEN la[1] WHEN 2 THEN la[1] || ' and ' || la[2] ELSE la[1] || ' et al.' END "
    "|| ' (' || coalesce(year::VARCHAR, 'n.d.') || ')' AS narrative FROM q",
    "year_suffixes": f"WITH {STYLED} SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY coalesce(la[1], 'Unknown'), year) > 1 THEN "
    "unicode(chr((96 + row_number() OVER (PARTITION BY coalesce(la[1], 'Unknown'), year ORDER BY doc_id))::INT))::INT ELSE 0 END AS suffix_code FROM q",
    "reference_list": f"WITH {STYLED} SELECT row_number() OVER (ORDER BY CASE WHEN contains(coalesce(authors[1], ''), ',') THEN lower(split_part(authors[1], ',', 1)) ELSE lower(coalesce(authors[1], '')) END, coalesce(year, 9999), doc_id) AS position, doc_id, {APA_ENTRY} AS entry FROM q",
    "citation_numbers": "WITH f AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id), n AS (SELECT user_id, row_number() OVER (ORDER BY e, user_id) AS c FROM f) "
    "SELECT event_id AS position, user_id AS paper_idx, c AS citation_number FROM events JOIN n USING (user_id)",
    "verdict_findings": f"""WITH {LOG} SELECT CASE WHEN lg.pid IS NULL THEN 'verification_log' ELSE 'verification_verdict' END AS "check", title AS paper,
      CASE WHEN lg.pid IS NULL THEN 'no verification log entry' ELSE 'verdict ''' || verdict || ''' not acceptable' END AS detail, count(*) AS n FROM fp LEFT JOIN lg ON lg.pid = fp.pid WHERE lg.pid IS NULL OR verdict <> 'VERIFIED' GROUP BY 1, 2, 3""",
    "orphan_dois": f"""WITH {PAPERS} SELECT DISTINCT 'FAIL' AS level, 'reference_doi_orphan' AS "check", 'reference lists DOI ' || doi || ' not in final_papers' AS detail FROM p
      WHERE doi IS NOT NULL AND doc_id % 5 <> 0 AND doi NOT IN (SELECT doi FROM p WHERE doc_id % 3 = 0 AND doi IS NOT NULL)""",
    "chain_gaps": f"""WITH {LOG} SELECT 'chain_gap' AS "check", left(title, 50) || ' lacks ' || w || ' record' AS detail, count(*) AS n FROM (
      SELECT title, 'verification' AS w FROM fp WHERE pid NOT IN (SELECT pid FROM lg) UNION ALL
      SELECT title, 'evidence' FROM fp WHERE pid NOT IN (SELECT {PAPER_ID} FROM p WHERE doc_id % 2 = 0)) GROUP BY ALL""",
    "marker_findings": f"""WITH {STYLED}, m AS (SELECT {APA_MARKER} AS marker FROM q WHERE year IS NOT NULL UNION ALL SELECT '[' || doc_id || ']' FROM q UNION ALL SELECT '(Nobody' || (doc_id % 3) || ', 1999)' FROM q),
      ok AS (SELECT DISTINCT split_part(authors[1], ',', 1) AS name, year FROM p WHERE year > 2010 AND len(authors) > 0)
      SELECT 'WEAK' AS level, 'marker ''' || left(marker, 50) || ''' not mapped to any final paper' AS detail, count(*) AS n FROM m
      WHERE NOT EXISTS (SELECT 1 FROM ok WHERE contains(marker, year::VARCHAR) AND regexp_matches(marker, '(?i)\\b' || name || '\\b')) GROUP BY ALL""".replace("\\\\b", "\\b"),
    "reference_gaps": f"""WITH {REFS} SELECT 'WEAK' AS level, 'reference_entry' AS "check", '''' || left(frag, 40) || '...'' missing from reference list' AS detail FROM gap""",
    "audit_fold": f"""WITH {REFS}, o AS (SELECT DISTINCT doi FROM p WHERE doi IS NOT NULL AND doc_id % 4 <> 1 AND doi NOT IN (SELECT doi FROM own))
      SELECT CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WEAK' ELSE 'PASS' END AS overall, f AS fails, w AS weak FROM (SELECT (SELECT count(*) FROM o) AS f, (SELECT count(*) FROM gap) AS w)""",
    "sentence_offsets": f"""WITH {CLAIMS} SELECT doc_id, pid::INT AS paragraph_id, (row_number() OVER (PARTITION BY doc_id, pid ORDER BY sid) - 1)::INT AS sentence_id,
      (fin - length(regexp_extract(sent, '[.!?。！？]*$', 0)))::INT AS "offset" FROM sp WHERE sent <> ''""",
    "latex_insertions": r"""SELECT doc_id, unnest([1, 2, 3, 4]) AS ord, unnest(['new1', 'new2', 'new1', 'old' || source]) AS key, unnest(['inserted', 'skip', 'skipped_existing', 'skipped_existing']) AS status,
      unnest(['', 'sentence out of range', 'key already cited', 'key already cited']) AS reason FROM documents""",
    "claim_concepts": f"WITH {CONCEPTS} SELECT doc_id, array_to_string(concepts, '|') AS concepts, array_to_string(synonyms, '|') AS synonyms FROM ce",
    "claim_queries": f"WITH {QUERIES} SELECT doc_id, (i - 1)::INT AS query_no, q.type AS type, q.query AS query FROM (SELECT doc_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM q4)",
    "search_budget": f"WITH {QUERIES} SELECT doc_id::VARCHAR AS claim_id, (i - 1)::INT AS query_no, q.type AS type, budget FROM (SELECT doc_id, greatest(1, 10 // len(qs))::INT AS budget, unnest(qs[1:4]) AS q, generate_subscripts(qs[1:4], 1) AS i FROM q4 WHERE need <> 'NOT_NEEDED') WHERE q.query <> ''",
    "source_union": f"""WITH {PAPERS}, r0 AS (SELECT *, src = 'semantic_scholar' AS s2, row_number() OVER (PARTITION BY venue, src = 'semantic_scholar' ORDER BY doc_id) - 1 AS rank FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY venue, s2 ORDER BY rank) AS passed FROM r0 WHERE year BETWEEN 2005 AND 2020)
      SELECT venue AS claim_id, rank + CASE WHEN s2 THEN 0 ELSE 1099511627776 END AS ord, title, year::INT AS year, CASE WHEN s2 THEN 'semantic_scholar' ELSE 'publish_or_perish' END AS source,
        array_to_string(list_transform(authors, lambda a: CASE WHEN s2 THEN {_FLIP_ALL} ELSE {_FLIP} END), '|') AS authors, 'journal' AS venue_type, coalesce(doi, '') AS doi, CASE WHEN NOT s2 THEN '1' END AS pages, n_chars AS citation_count
      FROM r WHERE passed <= 10 AND (s2 OR title <> '')""",
    "entailment_review": f"WITH {KEYWORDED}, c0 AS (SELECT doc_id, concat_ws(' ', {headline('text')}, 'reliability accuracy', {headline('reverse(text)')}) AS claim FROM documents),"
    + keyword_ctes("ck", "c0", "doc_id", "claim", 50) + f""", o AS (SELECT doc_id, ev, {coverage('ck.kw', 'evk')} AS s FROM kp LEFT JOIN ck ON ck.k = doc_id),
      f AS (SELECT *, 'heuristic overlap ' || printf('%.2f', {pyround('s', 2)}) AS shown FROM o)
      SELECT doc_id::VARCHAR AS claim_id, CASE WHEN length({strip('ev')}) < 40 THEN 'FAIL' WHEN s >= 0.3 THEN 'PASS' WHEN s >= 0.15 THEN 'WEAK' ELSE 'FAIL' END AS entailment_verdict,
        CASE WHEN length({strip('ev')}) < 40 THEN 'no usable evidence text to review' WHEN s >= 0.3 THEN shown WHEN s >= 0.15 THEN shown || ' — weak topical link' ELSE shown || ' — no substantive link' END AS entailment_reason,
        'heuristic' AS review_method FROM f""",
    "latex_texts": rf"""SELECT doc_id, regexp_replace(chr(10) || ' ' || chr(10) || regexp_replace(replace(replace(text, '%', ''), '\', ''), '\s+', ' ', 'g') || chr(10) || '  Known  . More text.' || chr(10), '\s+', ' ', 'g') AS body FROM documents""",
    "citation_spans": f"""WITH {STYLED}, m AS (SELECT doc_id, length(t.text) AS n, {APA_MARKER} AS own, '[' || doc_id || ']' AS num, '(Nobody' || (doc_id % 3) || ', 1999)' AS nob, year IS NOT NULL AS dated
        FROM q JOIN (SELECT doc_id, text FROM documents) t USING (doc_id)),
      s AS (SELECT doc_id, n + 1 AS start, own AS marker FROM m WHERE dated
        UNION ALL SELECT doc_id, n + 1 + length(own) + 5, num FROM m
        UNION ALL SELECT doc_id, n + 1 + length(own) + 5 + length(num) + 4, nob FROM m)
      SELECT doc_id, start::INT AS start, (start + length(marker))::INT AS "end", marker FROM s""",
}

from .dedup_sql import SQL as _DEDUP  # noqa: E402  (both use the fragments above)
from .relations_sql import SQL as _RELATIONS  # noqa: E402

ORACLE.update(_RELATIONS)
ORACLE.update(_DEDUP)

from .branches_sql import SQL as _BRANCHES  # noqa: E402

ORACLE.update(_BRANCHES)
