"""Claim columns: splitting, filtering, classification, normalisation, queries."""

from __future__ import annotations

from functools import reduce
from operator import or_
from re import _constants as _sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, SPACE, bind, keywords, strip, text_or_empty, word_count, words

# ---------------------------------------------------------------------------
# Patterns and word lists that decide the results below.
# ---------------------------------------------------------------------------

CONJUNCTIONS = ("and", "but", "while", "whereas", "which")

SELF_REFERENCE = (
    r"^(in this paper|in this work|in this study|in this article|in this section|"
    r"we propose|we present|we introduce|we show|we demonstrate|our approach|"
    r"our method|our contribution|the remainder of|the rest of|the next section|"
    r"the following section|section \d|chapter \d|table \d|figure \d|"
    r"algorithm \d|equation \d|this paper|this study)"
)

# Claim types in test order. "i" patterns ignore case.
TYPE_PATTERNS = (
    ("STATISTICAL", (
        ("i", r"\d+\.?\d*\s?%"),
        ("i", r"\b(mean|median|prevalence|incidence|rate)\b"),
        ("i", r"p\s*[<=>]\s*0?\.\d"),
        ("i", r"correlation|regression|odds ratio|hazard ratio"),
    )),
    ("DEFINITION", (
        ("i", r"\bis defined as\b|\bdefined by\b|\brefers to\b|\bis a .*\bconcept\b"),
        ("i", r"(UTAUT2|TAM|TOE|theory of planned behavior|definition)"),
        ("i", r"是一种|指的是|被定义为|是指"),
    )),
    ("METHOD", (
        ("i", r"method|algorithm|framework|approach|technique|procedure|protocol"),
        ("i", r"we (propose|develop|introduce|present) (a|an|the)"),
        ("i", r"PLS-SEM|SEM\b|regression|deep learning model|transformer"),
        ("i", r"算法|方法|流程|步骤|框架(?!理论)"),
    )),
    ("HISTORICAL", (
        ("i", r"\bin (19|20)\d{2}\b|\bhistorically\b|\bsince (19|20)\d{2}\b|\bseminal\b"),
    )),
    ("THEORETICAL", (
        ("i", r"theory\b|\btheoretical\b|\bconceptual\b|\bframework\b|\bmodel\b|\bparadigm\b"),
    )),
    ("NORMATIVE", (
        ("i", r"\bshould\b|\bmust\b|\bought to\b|\betically\b|\bnormative\b|\brequires?\b"),
    )),
    ("EMPIRICAL", (
        ("i", r"found|showed|observed|measured|evidence|results suggest|studies show"),
    )),
    ("CURRENT_STATE", (
        ("i", r"\b(currently|now|today|recent years|increasingly)\b"),
    )),
)
DEFAULT_TYPE = "EMPIRICAL"

NOT_NEEDED_PATTERNS = (
    ("i", r"^(in this paper|in this work|in this study|in this article|in this section|"
          r"we (propose|present|introduce|show|demonstrate|develop|design|collect|observe|found|found that))"),
    ("i", r"^(本文|本研究|我们|笔者)(提出|认为|主张|介绍|采用|使用|设计了|构建了|收集了|观察到)"),
    ("i", r"^(the remainder of|the rest of|the next section|the following section|"
          r"section \d|chapter \d|table \d|figure \d|algorithm \d|equation \d)"),
    ("i", r"^(we|our) (data|results|findings|survey|questionnaire|responses|sample|participants)\b"),
    ("i", r"\b(as follows|below|above|here)\b"),
)
REQUIRED_PATTERNS = (
    ("i", r"\d+\.?\d*\s?%"),
    ("", r"\$(?:\d|X)"),
    ("i", r"(increased|decreased|reduced|improved|raised|lowered)\s+by\b"),
    ("i", r"(accuracy|performance|efficiency|effectiveness|reliability|prevalence|incidence)\s+of\b"),
    ("i", r"has been (shown|proven|demonstrated|established|found|reported)\b"),
    ("i", r"it is (well known|widely accepted|generally believed|well established|commonly understood)"),
    ("i", r"(according to|based on|following)\s+(the|a|prior|previous|recent|seminal)"),
    ("i", r"(first proposed|introduced by|developed by|demonstrated in|defined by|coined)"),
    ("i", r"(outperform|surpass|exceed|outperforms|surpasses)"),
    ("i", r"(state-of-the-art|state of the art|cutting-edge|SOTA)"),
    ("i", r"(evidence|empirical|experimental|theoretical)\s+(shows|suggests|indicates|demonstrates|supports|confirms)"),
    ("i", r"\bcauses?\b|\bleads to\b|\bresults in\b|\bcorrelates? with\b|\bis associated with\b"),
    ("i", r"(was|were|is|are)\s+(found|shown|observed|estimated)\s+to\b"),
    ("i", r"according to [A-Z][a-z]+"),
    ("i", r"\((?:19|20)\d{2}[a-z]?\)"),
    ("i", r"\[(?:19|20)\d{2}\]"),
    ("i", r"\b(mean|median|average|p\s*[<=>]\s*0\.\d|statistically significant)\b"),
)
RECOMMENDED_PATTERNS = (
    ("i", r"(is widely used|commonly used|frequently employed|increasingly (used|adopted|common))"),
    ("i", r"(previous|prior|existing|recent|earlier|more recent)\s+(work|study|studies|research|literature|efforts|reviews)"),
    ("i", r"(a growing body|a large body|substantial evidence|mounting evidence)"),
)

FACET_PATTERNS = {
    "population": r"\b(students|teachers|employees|patients|children|adults|consumers|users|"
                  r"university|college|hospital|firms|companies|smes|organizations)\w*",
    "geography": r"\b(China|US|USA|United States|UK|Europe|Germany|Japan|Korea|India|Australia|"
                 r"Africa|developing countries)\b",
    "time": r"\b(202[0-9]|201[0-9]|recent years|since 20\d{2})\b",
}

SYNONYMS = {
    "generative ai": ["large language models", "chatgpt", "generative artificial intelligence", "llms"],
    "llm": ["large language model", "generative ai", "chatgpt"],
    "critical thinking": ["higher-order thinking", "analytical thinking", "critical reasoning"],
    "students": ["university students", "college students", "undergraduates", "higher education students"],
    "over-reliance": ["overreliance", "dependence", "uncritical reliance", "overdependence"],
    "e-learning": ["online learning", "digital learning", "distance education"],
    "acceptance": ["adoption", "usage intention", "behavioral intention"],
    "technology acceptance": ["technology adoption", "technology use"],
    "fraud": ["fraud detection", "financial fraud"],
    "deep learning": ["neural networks", "deep neural networks"],
}

CHINESE_TERMS = {
    "生成式人工智能": "generative artificial intelligence",
    "人工智能": "artificial intelligence",
    "大语言模型": "large language model",
    "学生": "students",
    "学习": "learning",
    "学习效果": "learning outcomes",
    "教育": "education",
    "教师": "teachers",
    "提升": "improve",
    "提高": "improve",
    "显著": "significantly",
    "影响": "impact",
    "效果": "effect",
    "研究": "research",
    "研究表明": "research shows",
    "框架": "framework",
    "模型": "model",
    "算法": "algorithm",
    "方法": "method",
    "理论": "theory",
    "技术": "technology",
    "接受": "acceptance",
    "行为意向": "behavioral intention",
    "绩效": "performance",
    "创新": "innovation",
    "采用": "adoption",
    "信任": "trust",
    "隐私": "privacy",
    "风险": "risk",
    "证据": "evidence",
    "结论": "conclusion",
    "有效性": "effectiveness",
    "效率": "efficiency",
    "动机": "motivation",
    "满意度": "satisfaction",
}

HEDGES = r"\b(may|might|possibly|perhaps|often|typically|generally|seem(s)?)\b"

MAX_QUERY_WORDS = 30
TYPE_QUERY_SUFFIX = {
    "EMPIRICAL": ("authoritative", " systematic review"),
    "CURRENT_STATE": ("authoritative", " systematic review"),
    "THEORETICAL": ("foundational", " theory"),
    "DEFINITION": ("foundational", " theory"),
    "METHOD": ("foundational", " method"),
}

# ---------------------------------------------------------------------------


def any_pattern(patterns) -> str:
    """One alternation for a pattern group, so a row is scanned once. Unicode
    classes, and a dot that stops at line feeds only."""
    return "(?dU)" + "|".join(f"(?:{body})" for _, body in patterns)


def _rarity(literals: frozenset[str]) -> int:
    """How much the weakest of some literals tells: its length; a mark counts more
    than a letter, a dot or a space."""
    return min((len(x) * 2 if len(x) > 1 or x.isalnum() or x in " .," else 3) for x in literals)


def needed_literals(pattern: str) -> frozenset[str]:
    """Strings of which every match of the pattern holds one; empty if none is
    known. Of what follows one another, the most telling part is taken."""
    def of(parts) -> frozenset[str]:
        found, run = [], ""
        for op, value in [*parts, (None, None)]:
            if op is _sre.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append(frozenset({run}))
                run = ""
            if op is _sre.SUBPATTERN:
                found.append(of(value[3]))
            elif op is _sre.BRANCH:
                branches = [of(x) for x in value[1]]
                found.append(frozenset().union(*branches) if all(branches) else frozenset())
            elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif op is _sre.IN and all(kind is _sre.LITERAL for kind, _ in value):
                found.append(frozenset(chr(c) for _, c in value))
        return max((x for x in found if x), key=_rarity, default=frozenset())

    return of(_parser.parse(pattern))


def matches_any(text: Column, patterns, low: Column | None = None) -> Column:
    """Whether a pattern of the group occurs. Patterns that ignore case run in
    lower case on the lower-case text, which is much cheaper than ignoring case
    at every position (the patterns hold no upper-case escapes). A pattern is tried
    only where one of the strings it needs occurs, which few texts hold."""
    low = F.lower(text) if low is None else low

    def hit(flag: str, body: str) -> Column:
        where, body = (low, body.lower()) if flag else (text, body)
        found = where.rlike(any_pattern([(flag, body)]))
        needed = sorted(needed_literals(body))
        return reduce(or_, [F.contains(where, F.lit(x)) for x in needed]) & found if needed else found

    return reduce(or_, [hit(flag, body) for flag, body in patterns])


def split_compound(sentence: Column) -> Column:
    """One or two sub-claims: the first conjunction, in the fixed order, with
    six words on both sides and no enumeration on its left."""

    def halves(word: str) -> Column:
        pattern = rf"(?sU)^(.*?){SPACE}+{word}{SPACE}+(.*)\z"
        return F.when(F.contains(sentence, F.lit(word)), F.array(
            strip(F.regexp_extract(sentence, pattern, 1)), strip(F.regexp_extract(sentence, pattern, 2))))

    def usable(h: Column) -> Column:
        left, right = F.get(h, 0), F.get(h, 1)
        return (h.isNotNull() & (word_count(left) >= 6) & (word_count(right) >= 6)
                & ~F.contains(F.lower(left), F.lit(" and ")) & ~F.contains(left, F.lit(", and ")))

    tries = F.array(*[halves(w) for w in CONJUNCTIONS])
    first = F.get(F.filter(tries, usable), 0)
    return F.coalesce(first, F.array(sentence))


def is_noise(text: Column) -> Column:
    """Sentences that cannot carry a citation: too short, or about the paper itself."""
    t = strip(text)
    short = F.when(t.rlike(CJK), F.length(t) < 8).otherwise(word_count(t) < 4)
    return (t == "") | short | t.rlike(f"(?iU){SELF_REFERENCE}")


def claim_type(text: Column) -> Column:
    def typed(low: Column) -> Column:
        cases = reduce(
            lambda acc, group: acc.when(matches_any(low, group[1], low), F.lit(group[0])),
            TYPE_PATTERNS[1:],
            F.when(matches_any(low, TYPE_PATTERNS[0][1], low), F.lit(TYPE_PATTERNS[0][0])))
        return cases.otherwise(F.lit(DEFAULT_TYPE))

    return bind(F.lower(text_or_empty(text)), typed)


def citation_need(text: Column) -> Column:
    def needed(t: Column) -> Column:
        return bind(F.lower(t), lambda low: F.when(matches_any(t, NOT_NEEDED_PATTERNS, low), F.lit("NOT_NEEDED"))
                    .when(matches_any(t, REQUIRED_PATTERNS, low), F.lit("REQUIRED"))
                    .otherwise(F.lit("RECOMMENDED")))

    return bind(strip(text_or_empty(text)), needed)


def facet(text: Column, name: str) -> Column:
    return F.lower(F.regexp_extract(text, f"(?iU){FACET_PATTERNS[name]}", 0))


def strip_hedges(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"(?iU){HEDGES}", ""))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def normalized_text(original: Column, hint: Column) -> Column:
    given = strip(text_or_empty(hint))
    return F.when(given == "", strip(text_or_empty(original))).otherwise(given)


def concepts_and_synonyms(original: Column, normalized: Column) -> Column:
    """{concepts, synonyms}, both at most eight. Chinese terms first, then the
    six top keywords, then the synonyms of every known phrase in the text."""
    none = F.array().cast("array<string>")
    zh_terms = F.array(*[F.struct(F.lit(k).alias("zh"), F.lit(v).alias("en"))
                         for k, v in CHINESE_TERMS.items()])
    zh = F.when(
        original.rlike(CJK),
        F.array_distinct(F.transform(
            F.filter(zh_terms, lambda e: F.contains(original, e["zh"])), lambda e: e["en"])),
    ).otherwise(none)
    phrases = F.array(*[F.struct(F.lit(k).alias("phrase"), _strings(v).alias("alts"))
                        for k, v in SYNONYMS.items()])
    low = F.lower(normalized)
    alts = F.array_distinct(F.flatten(F.transform(
        F.filter(phrases, lambda e: F.contains(low, e["phrase"])), lambda e: e["alts"])))

    def combine(zh_: Column, kws: Column, alts_: Column) -> Column:
        concepts = F.array_union(zh_, kws)
        synonyms = F.when(F.size(kws) > 0, F.array_union(zh_, alts_)).otherwise(zh_)
        added = F.array_except(F.filter(alts_, lambda a: word_count(a) <= 4), concepts)
        return F.struct(
            F.slice(F.concat(concepts, added), 1, 8).alias("concepts"),
            F.slice(F.concat(synonyms, added), 1, 8).alias("synonyms"))

    return bind(zh, lambda z: bind(keywords(normalized, 6),
                                   lambda k: bind(alts, lambda a: combine(z, k, a))))


def truncate_query(query: Column) -> Column:
    return bind(query, lambda q: bind(words(q), lambda tokens: F.when(
        F.size(tokens) <= MAX_QUERY_WORDS, q).otherwise(
        F.array_join(F.slice(tokens, 1, MAX_QUERY_WORDS), " "))))


def synonym_swap(norm: Column, concepts: Column, synonyms: Column) -> Column:
    """The claim with one concept replaced by a synonym of two or more words
    that the claim does not contain yet; null when no concept can be swapped."""
    low = F.lower(norm)
    new = F.filter(synonyms, lambda a: (word_count(a) >= 2) & ~F.contains(low, F.lower(a)))

    def alternative(concept: Column, alts: Column) -> Column:
        fits = F.filter(alts, lambda a: F.lower(a) != F.lower(concept))
        return F.struct(concept.alias("concept"), F.get(fits, 0).alias("alt"))

    present = F.filter(concepts, lambda c: (c != "") & F.contains(low, F.lower(c)))
    pick = bind(new, lambda alts: F.get(F.filter(F.transform(
        present, lambda c: alternative(c, alts)), lambda s: s["alt"].isNotNull()), 0))

    def swap(p: Column) -> Column:
        pattern = F.concat(F.lit(r"(?isU)^(.*?)\b\Q"), p["concept"], F.lit(r"\E\b"))
        safe = F.regexp_replace(p["alt"], r"([\\$])", r"\\$1")
        return F.regexp_replace(norm, pattern, F.concat(F.lit("$1"), safe))

    return bind(pick, swap)


def search_queries(norm: Column, concepts: Column, synonyms: Column, population: Column,
                   context: Column, ctype: Column) -> Column:
    """Typed queries of a claim; a query text already present (ignoring case)
    is not repeated."""

    def query(kind: str, text: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), truncate_query(text).alias("query")))

    return bind(norm, lambda n: _offered(n, concepts, synonyms, population, context, ctype, query))


def _offered(norm: Column, concepts: Column, synonyms: Column, population: Column, context: Column,
             ctype: Column, query) -> Column:
    has_concepts = F.size(concepts) > 0
    broad = F.array_join(F.slice(concepts, 1, 6), " ")
    hints = F.filter(F.array(text_or_empty(population), text_or_empty(context)), lambda w: w != "")
    base = F.array_join(F.slice(concepts, 1, 3), " ")
    domain = (F.when(F.size(hints) > 0, F.concat_ws(" ", base, F.array_join(hints, " ")))
              .when(F.size(synonyms) > 0, F.concat_ws(" ", base, F.get(synonyms, 0)))
              .otherwise(base))
    made = [
        query("precise", norm, F.lit(True)),
        query("broad", broad, has_concepts & (broad != "")),
        query("synonym", synonym_swap(norm, concepts, synonyms), has_concepts & (F.size(synonyms) > 0)),
        query("domain", domain, has_concepts),
    ]
    made += [query(kind, F.concat(norm, F.lit(suffix)), ctype == name)
             for name, (kind, suffix) in TYPE_QUERY_SUFFIX.items()]
    offered = F.filter(F.array(*made), lambda q: q["query"].isNotNull())

    def first_of_each(all_: Column) -> Column:
        return F.filter(all_, lambda q, i: F.size(F.filter(
            F.slice(all_, 1, i), lambda e: F.lower(e["query"]) == F.lower(q["query"]))) == 0)

    return bind(offered, first_of_each)
