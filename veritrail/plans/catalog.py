"""Named queries over the shared tables: every stage, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cite
from ..functions import claims as C
from ..functions import scores as S
from ..functions import text as X
from ..functions.cite import PaperColumns
from ..functions.ids import bibtex_key, normalize_doi, paper_id_of
from ..operators import (audit, dedup, documents, evidence, extract, keys, logs, quality, rank, references,
                         retrieve, support, verify)
from ..session import broadcast_checked, cut_lineage
from ..sources import files, mappers
from . import bridge as B
from . import branches, relations
from .texts import word_index

YEAR = B.CURRENT_YEAR
Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOG[fn.__name__] = fn
    return fn


def docs(spark, sf):
    return B.table(spark, sf, "documents")


def doc_claims(spark, sf):
    return extract.extract_claims(docs(spark, sf))


def joined(column) -> F.Column:
    return F.array_join(column, "|")


# --- text -----------------------------------------------------------------------

@query
def keyword_top10(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.keywords(F.col("text"), 10)).alias("keywords"))


@query
def keyword_overlap(spark, sf):
    return docs(spark, sf).select("doc_id", X.keyword_overlap(
        B.headline(F.col("text")), F.col("text")).alias("overlap"))


@query
def sentence_list(spark, sf):
    return X.unnest(docs(spark, sf), X.sentences(F.col("text")), "doc_id", value="sentence", position="sentence_no")


@query
def title_similarity_steps(spark, sf):
    """Similarity of every title to its first third: a subsequence, so the
    exact value is known in closed form."""
    p = B.papers(spark, sf)
    part = F.left("title", F.floor(F.length("title") / 3).cast("int"))
    return p.select("doc_id", F.round(X.title_similarity(F.col("title"), part), 9).alias("similarity"))


@query
def author_forms(spark, sf):
    a = F.get("authors", 0)
    return B.papers(spark, sf).where(F.size("authors") > 0).select(
        "doc_id", X.last_name(a).alias("last_name"), X.author_initials_first(a).alias("initials_first"),
        X.author_last_initials(a).alias("last_initials"), X.family_given(a).alias("family_given"))


# --- identity ---------------------------------------------------------------------

@query
def doi_normalise(spark, sf):
    raw = F.concat(
        F.element_at(F.array(F.lit(" https://doi.org/"), F.lit("DOI:"), F.lit("http://doi.org/"), F.lit("")),
                     (F.col("doc_id") % 4 + 1).cast("int")),
        F.lit("10.1000/AB"), F.col("doc_id").cast("string"),
        F.element_at(F.array(F.lit("."), F.lit(";,"), F.lit(" ")), (F.col("doc_id") % 3 + 1).cast("int")))
    return docs(spark, sf).select("doc_id", normalize_doi(raw).alias("doi"))


@query
def paper_ids(spark, sf):
    return B.papers(spark, sf).select("doc_id", paper_id_of().alias("paper_id"))


@query
def bibtex_keys(spark, sf):
    return B.papers(spark, sf).select(
        "doc_id", bibtex_key(F.col("title"), F.col("year"), F.col("authors")).alias("bibtex_key"))


# --- claims -----------------------------------------------------------------------

@query
def claim_extraction(spark, sf):
    return doc_claims(spark, sf).select(
        "doc_id", F.col("claim_no").cast("bigint").alias("claim_no"), "claim_id", "original_text", "paragraph_id", "sentence_id",
        F.coalesce("char_start", F.lit(-1)).alias("char_start"), F.coalesce("char_end", F.lit(-1)).alias("char_end"),
        "split_from_compound")


@query
def claim_classes(spark, sf):
    """Type and citation need of every extracted claim."""
    df = extract.detect_citation_need(extract.classify_claims(doc_claims(spark, sf)))
    return df.select("doc_id", F.col("claim_no").cast("bigint").alias("claim_no"), "claim_type", "citation_need")


@query
def claim_class_counts(spark, sf):
    df = extract.detect_citation_need(extract.classify_claims(doc_claims(spark, sf)))
    return df.groupBy("claim_type", "citation_need").agg(F.count(F.lit(1)).alias("n"))


_TAILS = (
    "The prevalence rate was 23.5% in 2019.", "Trust is defined as a belief held by students in China.",
    "This algorithm improves accuracy of teachers.", "A seminal study appeared in 1998 in Europe.",
    "The conceptual model explains adoption.", "Firms should adopt it and must report.",
    "Results suggest it was found to grow.", "Currently it is widely used by hospital staff since 2015.",
    "In this paper we propose it.", "The details are shown below.", "Previous studies exist.",
    "学生使用生成式人工智能提升学习效果。", "Generative AI helps students in critical thinking.",
    "Deep learning detects fraud in UK companies.", "E-learning acceptance results in use (2020).",
)


def tailed_claims(spark, sf):
    """Headlines followed by a sentence that exercises one branch each; the
    sentence follows from the document's number."""
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (F.col("doc_id") % len(_TAILS) + 1).cast("int"))
    return docs(spark, sf).select("doc_id", F.concat_ws(" ", B.headline(F.col("text")), tail).alias("original_text"))


@query
def claim_type_branches(spark, sf):
    t = F.col("original_text")
    return tailed_claims(spark, sf).select(
        "doc_id", C.claim_type(t).alias("claim_type"), C.citation_need(t).alias("citation_need"))


@query
def claim_facets(spark, sf):
    t = F.col("original_text")
    return tailed_claims(spark, sf).select(
        "doc_id", *[C.facet(t, n).alias(n) for n in ("population", "geography", "time")])


def normalized(spark, sf):
    claims = tailed_claims(spark, sf).withColumn("claim_id", F.col("doc_id").cast("string"))
    return extract.classify_claims(extract.normalize_claims(claims))


@query
def claim_concepts(spark, sf):
    return normalized(spark, sf).select(
        "doc_id", joined("search_concepts").alias("concepts"), joined("synonyms").alias("synonyms"))


@query
def claim_queries(spark, sf):
    df = extract.generate_queries(normalized(spark, sf))
    return X.unnest(df, "queries", "doc_id", value="q", position="query_no").select(
        "doc_id", "query_no", "q.type", "q.query")


@query
def search_budget(spark, sf):
    df = extract.generate_queries(extract.detect_citation_need(normalized(spark, sf)))
    return extract.planned_searches(df, 10).select("claim_id", "query_no", "type", "budget")


# --- scores -----------------------------------------------------------------------

@query
def year_scores(spark, sf):
    p = B.papers(spark, sf)
    return p.select("doc_id", S.recency(F.col("year"), YEAR).alias("recency"),
                    S.originality(F.col("year"), YEAR).alias("originality"))


@query
def authority_scores(spark, sf):
    p = B.papers(spark, sf).withColumn("tier", (F.col("doc_id") % 10) / 10)
    return p.select("doc_id", S.authority(F.col("citation_count")).alias("authority"),
                    S.method_authority(F.col("citation_count"), F.col("tier")).alias("method_authority"))


@query
def support_bands(spark, sf):
    """Level bands and the cap on title-only evidence, over all events."""
    score = F.col("value") / 100
    claim = F.when(F.col("event_id") % 3 == 0, F.lit("It was published in 2020.")).otherwise(F.lit("It works."))
    return B.table(spark, sf, "events").select(
        "event_id", S.support_level(score).alias("level"), S.cap_metadata_only(score, claim).alias("capped"),
        S.py_round(score, 2).alias("rounded"))


@query
def composite_scores(spark, sf):
    p = B.papers(spark, sf).withColumn("support", (F.col("doc_id") % 101) / 100).withColumn(
        "kind", F.element_at(F.array(*[F.lit(k) for k in ("DEFINITION", "HISTORICAL", "METHOD", "EMPIRICAL")]),
                             (F.col("doc_id") % 4 + 1).cast("int")))
    score = S.composite(S.profile_name(F.col("kind")), F.col("support"), (F.col("doc_id") % 10) / 10,
                        S.recency(F.col("year"), YEAR), F.col("year"), F.col("citation_count"), F.lit(1.0), YEAR)
    return p.select("doc_id", S.profile_name(F.col("kind")).alias("profile"), score.alias("composite"))


@query
def contradiction_flags(spark, sf):
    claim = F.when(F.col("doc_id") % 2 == 0, F.lit("It improves recall.")).otherwise(F.lit("It exists."))
    proof = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("It does not improve recall."))
                        .when(F.col("doc_id") % 3 == 1, F.lit("There was no significant effect.")))
    return docs(spark, sf).select("doc_id", S.contradicts(claim, proof).alias("contradictory"))


# --- venues -----------------------------------------------------------------------

def venue_papers(spark, sf):
    """Papers at listed and unlisted venues."""
    names = ("Oncotarget", "Nature", "Proc. of ICML", "machine letters", "学报", "", "Plos One", "Journal X")
    return B.papers(spark, sf).withColumn("venue", F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int")))


@query
def blacklist_anti(spark, sf):
    kept = quality.drop_blacklisted(venue_papers(spark, sf), files.read_blacklist(spark))
    return kept.select("doc_id", "venue", "publisher", "issn_l")


def source_table(spark, sf):
    """Venue statistics as the source lookup returns them."""
    s = B.table(spark, sf, "supplier")
    return s.select(F.lit(None).cast("string").alias("issn"), F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("venue"),
                    F.col("s_suppkey").alias("rank"), (F.col("s_suppkey") % 13).cast("double").alias("citedness"))


@query
def venue_tiers(spark, sf):
    mixed = B.papers(spark, sf).withColumn("issn_l", F.lit(None).cast("string")).unionByName(
        venue_papers(spark, sf).withColumn("doc_id", -F.col("doc_id") - 1))
    return quality.tier_scores(mixed, files.read_conferences(spark), source_table(spark, sf)).select("doc_id", "tier")


# --- sources ----------------------------------------------------------------------

@query
def inverted_index_abstract(spark, sf):
    return docs(spark, sf).select("doc_id", mappers.inverted_abstract(word_index(F.col("text"))).alias("abstract"))


@query
def jats_strip(spark, sf):
    raw = F.concat(F.lit("<jats:p>"), F.replace("text", F.lit(". "), F.lit(".</jats:p> <jats:p>")), F.lit("</jats:p>"))
    return docs(spark, sf).select("doc_id", mappers.strip_jats(raw).alias("abstract"))


@query
def crossref_mapped(spark, sf):
    extra = {"container-title": F.array(F.lit("Journal")), "type": F.lit("journal-article"), "abstract": F.lit("<jats:p>A</jats:p>"),
             "is-referenced-by-count": F.lit(7).cast("bigint"), "volume": F.lit("1"), "issue": F.lit("2"), "page": F.lit("3-4"),
             "publisher": F.lit("P"), "ISSN": F.array(F.lit("1")), "language": F.lit("en"), "subject": F.array(F.lit("s"))}
    works = B.crossref_works(spark, sf)
    for name, value in extra.items():
        works = works.withColumn(name, value)
    return mappers.map_crossref(works).select("doi", "title", joined("authors").alias("authors"), "year", "venue_type", "abstract", "url")


@query
def openalex_mapped(spark, sf):
    raw = docs(spark, sf).select(
        "doc_id", F.concat(F.lit("https://doi.org/10.1/"), "doc_id").alias("doi"), B.headline(F.col("text")).alias("title"),
        F.lit("alt").alias("display_name"), (2000 + F.col("doc_id") % 20).cast("int").alias("publication_year"),
        F.element_at(F.array(F.lit("article"), F.lit("preprint"), F.lit("conference-paper"), F.lit("report")), (F.col("doc_id") % 4 + 1).cast("int")).alias("type"),
        F.col("lang").alias("language"), F.col("n_chars").alias("cited_by_count"),
        F.array(F.struct(F.struct(F.concat(F.lit("Ann B. "), "source").alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.col("source").alias("display_name"), F.lit(None).cast("string").alias("issn_l"),
                          F.lit(None).cast("array<string>").alias("issn"), F.lit("host").alias("host_organization_name")).alias("source")).alias("primary_location"),
        F.struct((F.col("doc_id") % 2 == 0).alias("is_oa"), F.lit("gold").alias("oa_status"), F.lit(None).cast("string").alias("oa_url")).alias("open_access"),
        F.struct(F.lit("1").alias("volume"), F.lit("2").alias("issue"), F.lit("3").alias("first_page"),
                 F.when(F.col("doc_id") % 3 == 0, F.lit("9")).alias("last_page")).alias("biblio"),
        word_index(F.col("text")).alias("abstract_inverted_index"))
    return mappers.map_openalex(raw, keep=("doc_id",)).select(
        "doc_id", "title", joined("authors").alias("authors"), "year", "venue", "venue_type", "doi", "pages", "is_oa",
        F.length("abstract").alias("abstract_chars"))


def source_responses(spark, sf):
    """Search responses of two sources for one query per venue, ranked."""
    p = B.papers(spark, sf)
    place = W.partitionBy("journal").orderBy("doc_id")
    people = F.transform("authors", lambda a: F.struct(a.alias("name")))
    ranked = lambda keep: p.where(keep).withColumn("rank", F.row_number().over(place) - 1).withColumn("query", F.col("journal"))
    s2 = ranked("source = 'semantic_scholar'").select(
        "query", "rank", "title", "year", "venue", "abstract", F.col("citation_count").alias("citationCount"),
        F.struct(F.col("doi").alias("DOI")).alias("externalIds"), people.alias("authors"))
    pop = ranked("source <> 'semantic_scholar'").select(
        "query", "rank", F.col("doc_id").cast("string").alias("uid"), "title", people.alias("authors"), "year",
        F.col("venue").alias("source"), "publisher", "doi", "abstract", "volume", "issue",
        F.lit("1").alias("startpage"), F.lit(None).cast("string").alias("endpage"), F.col("citation_count").alias("cites"))
    return {"semantic_scholar": s2, "publish_or_perish": pop}


@query
def source_union(spark, sf):
    """Candidates of two sources within budget, page limit and years."""
    searches = B.papers(spark, sf).select(F.col("journal").alias("claim_id"), F.col("journal").alias("query"), F.lit(10).alias("budget")).distinct()
    found = retrieve.union_sources(searches, source_responses(spark, sf), ["claim_id"], (2005, 2020))
    return found.select("claim_id", F.col("ord").cast("bigint").alias("ord"), "title", "year", "source", joined("authors").alias("authors"),
                        "venue_type", F.coalesce("doi", F.lit("")).alias("doi"), "pages", "citation_count")


@query
def retrieval(spark, sf):
    """The same candidates deduplicated per claim, filtered and enriched."""
    searches = B.papers(spark, sf).select(F.col("journal").alias("claim_id"), F.col("journal").alias("query"), F.lit(10).alias("budget")).distinct()
    found = retrieve.search_all(searches, source_responses(spark, sf), files.read_blacklist(spark), files.read_conferences(spark),
                                source_table(spark, sf), YEAR, scope=("claim_id",), years=(2005, 2020))
    return found.select("claim_id", "paper_id", "title", "source", "tier_score", "recency_score", F.col("merged_from").cast("bigint").alias("merged_from"))


@query
def page_titles(spark, sf):
    """Title element of every web page, cleaned like a title."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return B.table(spark, sf, "pages").select("page_id", X.normalize_title(title).alias("title"))


# --- deduplication ----------------------------------------------------------------

@query
def dedup_doi_merge(spark, sf):
    merged = dedup.merge_by_doi(B.papers(spark, sf))
    return merged.select("doi_key", F.col("n").cast("bigint").alias("n"), "title", joined("authors").alias("authors"),
                         F.coalesce("year", F.lit(-1)).alias("year"), "venue", "citation_count", "source", joined("source_apis").alias("source_apis"), "is_oa",
                         F.length("abstract").alias("abstract_chars"), "publisher", "volume", "pages")


@query
def dedup_papers(spark, sf):
    out = dedup.deduplicate(B.papers(spark, sf))
    return out.select("paper_id", F.col("ord").cast("bigint").alias("ord"), "doi_first", F.col("merged_from").cast("bigint").alias("merged_from"), "source")


@query
def dedup_copies(spark, sf):
    """Exact copies among the documents, as DOI-less papers of one source."""
    p = B.papers(spark, sf).withColumn("doi", F.sha2(F.concat(X.normalize_title(F.col("abstract")), "language"), 256))
    return dedup.merge_by_doi(p).select("doi_key", F.col("n").cast("bigint").alias("n"), F.col("ord").cast("bigint").alias("ord"))


# --- verification -----------------------------------------------------------------

def verified(spark, sf):
    return verify.verify_papers(
        B.papers(spark, sf), B.crossref_works(spark, sf), B.title_hits(spark, sf, "semantic_scholar"),
        B.openalex_works(spark, sf), B.title_hits(spark, sf, "openalex"))


@query
def verification(spark, sf):
    d = F.col("verification_details")
    return verified(spark, sf).select(
        "doc_id", "verification_status", F.coalesce(d["year_match"].cast("string"), F.lit("")).alias("year_match"),
        F.coalesce(d["doi_status"], F.lit("")).alias("doi_status"),
        F.coalesce(F.size(d["conflict_reasons"]), F.lit(0)).alias("reasons"),
        F.coalesce(F.array_join(d["matched_sources"], "+"), F.lit("")).alias("matched"),
        joined("authors").alias("authors"))


@query
def verdict_counts(spark, sf):
    return verify.verdict_counts(verified(spark, sf))


@query
def kept_rejected(spark, sf):
    kept, rejected = verify.split_by_verdict(verified(spark, sf))
    return kept.select("doc_id", F.lit("kept").alias("part")).unionByName(rejected.select("doc_id", F.lit("rejected").alias("part")))


@query
def latest_verdicts(spark, sf):
    """Last write wins over an append-only log: events, one paper per user."""
    log = B.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", F.lit("other")).otherwise(F.lit("verification")).alias("event"),
        F.col("user_id").cast("string").alias("paper_id"), F.col("event_type").alias("verdict"), "value", F.col("event_id").alias("ord"))
    return logs.latest_verdicts(log).select("paper_id", "verdict", "value")


# --- evidence ---------------------------------------------------------------------

@query
def evidence_sources(spark, sf):
    p = B.papers(spark, sf)
    s2 = p.where("doi IS NOT NULL AND doc_id % 4 = 0").select(
        "doi", F.concat(F.lit("  summary of "), "title").alias("abstract"))
    arxiv = p.where("doc_id % 15 = 5").select(F.concat(F.lit("a"), "doc_id").alias("arxiv_id"), F.concat(
        F.lit("<entry><summary> On\n "), "title", F.lit(" </summary></entry>")).alias("response"))
    p = p.withColumn("url", F.when(F.col("doc_id") % 15 == 5, F.concat(F.lit("http://arxiv.org/abs/a"), "doc_id")).otherwise(F.col("url")))
    got = evidence.fetch_evidence(p, B.openalex_works(spark, sf), s2, arxiv)
    return got.select("doc_id", "evidence_level", "evidence_source", F.length("evidence_text").alias("evidence_chars"))


# --- support and ranking ------------------------------------------------------------

def keyworded(spark, sf):
    p = B.papers(spark, sf)
    return (p.withColumn("evidence_text", F.substring(X.strip(F.col("abstract")), 1, evidence.MAX_EVIDENCE_CHARS))
            .withColumn("evidence_level", F.when(F.col("abstract") == "", F.lit("METADATA_ONLY")).otherwise(F.lit("ABSTRACT")))
            .withColumn("evidence_kw", X.keywords(F.col("evidence_text"), 50))
            .withColumn("title_kw", X.keywords(F.col("title"), 50)))


@query
def support_scores(spark, sf):
    """Support of every paper for the claim its own title makes."""
    p = keyworded(spark, sf).withColumn("claim_text", F.concat_ws(" ", "title", F.reverse("language"), F.lit("improves reliability")))
    return support.score_support(p).select("doc_id", "support_score", "support_level", "scoring_method")


def scored_pairs(spark, sf, min_coverage: float):
    """Scored claim-paper pairs that may hold the given share of the claim's
    keywords, with the verdicts of the papers' authors taken from `labels`."""
    claims = B.claims(spark, sf).withColumn("claim_kw", X.keywords(F.col("original_text"), 50))
    claims = extract.detect_citation_need(extract.classify_claims(claims))
    labels = B.table(spark, sf, "labels").select("doc_id", "quality")
    # The keywords are read several times, so they are written once.
    papers = keyworded(spark, sf)
    # Of a paper's texts, only two facts enter the pairs: whether there is any
    # evidence, and whether it denies something.
    light = papers.select(
        "doc_id", "evidence_kw", "title_kw", "evidence_level", S.negates(F.col("evidence_text")).alias("evidence_negates"),
        F.when(F.col("evidence_text") != "", F.lit("held")).otherwise(F.lit("")).alias("evidence_text"),
        F.lit(None).cast("string").alias("abstract"), *[c for c in papers.columns if c not in (
            "doc_id", "evidence_kw", "title_kw", "evidence_level", "evidence_text", "abstract")])
    kw = cut_lineage(light)
    claims = broadcast_checked(cut_lineage(claims.withColumn("claim_asserts", S.asserts(F.col("original_text")))))
    pairs = support.keyword_pairs(claims, kw.select("doc_id", "evidence_kw"), min_coverage)
    full = (pairs.join(claims.withColumnRenamed("original_text", "claim_text"), "claim_id")
            .join(kw, "doc_id").join(labels, "doc_id", "left"))
    scored = support.score_support(full.drop("support_score"))
    return (scored.withColumn("verification_status", F.when(F.col("quality") == 0, F.lit("UNVERIFIED")).otherwise(F.lit("VERIFIED")))
            .withColumn("tier_score", F.lit(0.4)).withColumn("recency_score", S.recency(F.col("year"), YEAR)))


@query
def support_top1(spark, sf):
    """Best supported link of every claim, or none: claims x papers by rare
    keywords, coverage, gates, greedy choice."""
    selected, _ = rank.rank_all(scored_pairs(spark, sf, support.gate_coverage()), YEAR)
    best = selected.where("pick = 1").select("claim_id", "doc_id", "support_score", "support_level", "composite_score")
    none = F.col("doc_id").isNull()
    return B.claims(spark, sf).select("claim_id").join(best, "claim_id", "left").select(
        "claim_id", F.coalesce("doc_id", F.lit(-1)).cast("bigint").alias("doc_id"),
        F.coalesce("support_score", F.lit(-1.0)).alias("support_score"),
        F.coalesce("support_level", F.lit("")).alias("support_level"),
        F.coalesce("composite_score", F.lit(-1.0)).alias("composite_score"),
        F.when(none, F.lit("NO_SUPPORT")).otherwise(F.lit("SELECTED")).alias("selection_status"))


@query
def gate_reasons(spark, sf):
    """Pairs whose score passes the gate, with the first gate that stops them."""
    gated = rank.with_gate(scored_pairs(spark, sf, support.gate_coverage()).where("support_score >= 0.6"))
    return gated.select("claim_id", "doc_id", "support_score", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


def topic_pairs(spark, sf):
    """Candidates per source: the papers of a source compete for its claim."""
    p = B.papers(spark, sf).withColumn("claim_id", F.col("journal")).withColumn("tier_score", (F.col("doc_id") % 10) / 10)
    return (p.withColumn("support_score", (F.col("doc_id") % 41) / 40).withColumn("recency_score", S.recency(F.col("year"), YEAR))
            .withColumn("support_level", S.support_level(F.col("support_score")))
            .withColumn("verification_status", F.when(F.col("doc_id") % 7 == 0, F.lit("CONFLICT")).otherwise(F.lit("VERIFIED")))
            .withColumn("venue", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")))
            .withColumn("citation_need", F.lit("REQUIRED"))
            .withColumn("claim_type", F.when(F.ascii(F.reverse("journal")) % 2 == 0, F.lit("CURRENT_STATE")).otherwise(F.lit("METHOD")))
            .withColumn("evidence_level", F.lit("ABSTRACT")).withColumn("evidence_source", F.lit("search_result"))
            .withColumn("evidence_text", F.col("abstract")).withColumn("support_reasoning", F.lit("r")))


@query
def greedy_selection(spark, sf):
    selected, _ = rank.rank_all(topic_pairs(spark, sf), YEAR)
    return selected.select("claim_id", "doc_id", "pick", "composite_score")


@query
def topk_first_pick(spark, sf):
    selected, _ = rank.rank_all(topic_pairs(spark, sf), YEAR)
    return selected.where("pick = 1").select("claim_id", "doc_id", "composite_score")


@query
def rejected_pairs(spark, sf):
    _, rejected = rank.rank_all(topic_pairs(spark, sf), YEAR)
    return rejected.groupBy("claim_id", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def claim_links(spark, sf):
    selected, _ = rank.rank_all(topic_pairs(spark, sf), YEAR)
    return rank.claim_links(selected).select(
        "claim_id", "paper_id", "doi", "support_level", "selection_status", F.length("evidence_text").alias("evidence_chars"))


# --- citations --------------------------------------------------------------------

def _entries(spark, sf, style):
    return B.papers(spark, sf).select("doc_id", cite.citation_entry(
        PaperColumns(), style, F.col("doc_id") + 1).alias("entry"))


@query
def ieee_entries(spark, sf):
    return _entries(spark, sf, "ieee")


@query
def apa_entries(spark, sf):
    return _entries(spark, sf, "apa7")


@query
def nature_entries(spark, sf):
    return _entries(spark, sf, "nature")


@query
def vancouver_entries(spark, sf):
    return _entries(spark, sf, "vancouver")


@query
def gbt_entries(spark, sf):
    return _entries(spark, sf, "gb-t-7714")


@query
def bibtex_entries(spark, sf):
    known = B.papers(spark, sf).where("doc_id % 6 = 0").select("doi")
    return references.bibtex_entries(B.papers(spark, sf), existing=known).select(
        F.col("ord").cast("bigint").alias("ord"), "bibtex_key", "entry")


@query
def apa_markers(spark, sf):
    return references.marker_texts(B.papers(spark, sf)).select("doc_id", "marker", "narrative")


@query
def year_suffixes(spark, sf):
    """Code point of every suffix; 0 for none."""
    return references.year_suffixes(B.papers(spark, sf)).select("doc_id", F.ascii("suffix").alias("suffix_code"))


@query
def reference_list(spark, sf):
    listed = references.style_entries(B.papers(spark, sf), "apa")
    return listed.select("position", "doc_id", "entry")


@query
def citation_numbers(spark, sf):
    plan = B.table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("paper_idx"))
    return references.citation_numbers(plan).select("position", "paper_idx", "citation_number")


# --- audit ------------------------------------------------------------------------

def final_papers(spark, sf):
    return B.papers(spark, sf).where("doc_id % 3 = 0")


def verdict_log(spark, sf):
    """Verdicts of the labelled papers, in two runs."""
    lab = B.table(spark, sf, "labels").join(B.papers(spark, sf), "doc_id")
    verdict = F.when(F.col("quality") == 1, F.lit("VERIFIED")).when(F.col("toxic") == 1, F.lit("CONFLICT")).otherwise(F.lit("LIKELY_REAL"))
    first = F.struct(verdict.alias("verdict"), F.col("ord").alias("ord"))
    second = F.struct(F.lit("UNVERIFIED").alias("verdict"), (F.col("doc_id") + F.lit(10 ** 9)).alias("ord"))
    runs = lab.select(paper_id_of().alias("paper_id"), F.array(first, F.when(F.col("doc_id") % 4 == 0, second)).alias("runs"))
    return X.unnest(runs, "runs", "paper_id", value="r").select(F.lit("verification").alias("event"), "paper_id", "r.verdict", "r.ord")


@query
def verdict_findings(spark, sf):
    found = audit.verdict_findings(final_papers(spark, sf), verdict_log(spark, sf), allow_likely_real=False)
    return found.groupBy("check", "paper", "detail").agg(F.count(F.lit(1)).alias("n"))


@query
def orphan_dois(spark, sf):
    refs = B.papers(spark, sf).where("doc_id % 5 <> 0").select(cite.apa_entry(PaperColumns()).alias("text"))
    return audit.orphan_doi_findings(final_papers(spark, sf), refs).select("level", "check", "detail")


@query
def chain_gaps(spark, sf):
    ev = B.papers(spark, sf).where("doc_id % 2 = 0").select(paper_id_of().alias("paper_id"))
    found = audit.chain_findings(final_papers(spark, sf), verdict_log(spark, sf), ev)
    return found.groupBy("check", "detail").agg(F.count(F.lit(1)).alias("n"))


def marked_documents(spark, sf):
    """Whole documents that cite at their end: their own marker, a numbered one,
    and one that no paper has."""
    p = B.papers(spark, sf, "text")
    return p.select("doc_id", F.concat(
        F.col("text"), F.lit(" "), cite.apa_in_text(PaperColumns()), F.lit(" and ["), F.col("doc_id").cast("string"), F.lit("] or (Nobody"),
        (F.col("doc_id") % 3).cast("string"), F.lit(", 1999).")).alias("text"))


@query
def marker_findings(spark, sf):
    some = B.papers(spark, sf).where("year > 2010")
    found = audit.marker_findings(marked_documents(spark, sf), some)
    return found.groupBy("level", "detail").agg(F.count(F.lit(1)).alias("n"))


@query
def reference_gaps(spark, sf):
    refs = B.papers(spark, sf).where("doc_id % 4 <> 1").select(cite.apa_entry(PaperColumns()).alias("text"))
    return audit.reference_entry_findings(final_papers(spark, sf), refs).select("level", "check", "detail")


@query
def audit_fold(spark, sf):
    refs = B.papers(spark, sf).where("doc_id % 4 <> 1").select(cite.apa_entry(PaperColumns()).alias("text"))
    found = audit.orphan_doi_findings(final_papers(spark, sf), refs).unionByName(
        audit.reference_entry_findings(final_papers(spark, sf), refs))
    return audit.fold(found)


@query
def entailment_review(spark, sf):
    links = keyworded(spark, sf).select(F.col("doc_id").cast("string").alias("claim_id"), paper_id_of().alias("paper_id"), "evidence_text",
                                        F.lit(0.9).alias("support_score"), F.lit("DIRECT").alias("support_level"))
    claims = docs(spark, sf).select(F.col("doc_id").cast("string").alias("claim_id"), B.headline(F.reverse("text")).alias("half"), "text").select(
        "claim_id", F.concat_ws(" ", B.headline(F.col("text")), F.lit("reliability accuracy"), "half").alias("original_text"),
        F.lit("").alias("normalized_claim"))
    papers = B.papers(spark, sf).withColumn("evidence_text", F.lit("")).withColumn("abstract", F.lit(""))
    return audit.review_links(links, claims, papers).select("claim_id", "entailment_verdict", "entailment_reason", "review_method")


# --- documents --------------------------------------------------------------------

@query
def citation_spans(spark, sf):
    marked = X.unnest(marked_documents(spark, sf), documents.citation_spans(F.col("text")), "doc_id", value="s")
    return marked.select("doc_id", "s.start", "s.end", F.col("s.text").alias("marker"))


@query
def sentence_offsets(spark, sf):
    """Where a marker goes, for every sentence of every paragraph."""
    paragraphs = X.unnest(docs(spark, sf), F.split("text", "\n"), "doc_id", value="para", position="paragraph_id")
    return X.unnest(paragraphs, documents.sentence_insert_offsets(F.col("para")), "doc_id", "paragraph_id",
                    value="offset", position="sentence_id")


def latex_documents(spark, sf):
    return docs(spark, sf).select("doc_id", F.concat(
        F.lit("\\documentclass{article}\n\\begin{document}\n\\section{Intro}\n"), F.replace(F.replace("text", F.lit("%"), F.lit("")), F.lit("\\"), F.lit("")),
        F.lit("\n\\section{Method} Known \\cite{old"), F.col("source"), F.lit("}. More text.\n\\end{document}\n")).alias("text"))


@query
def latex_insertions(spark, sf):
    plan = docs(spark, sf).select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("method").alias("section"), F.lit(0).alias("sentence_index"), F.lit("new1").alias("key")),
        F.struct(F.lit(2).alias("ord"), F.lit("Intro").alias("section"), F.lit(900000).alias("sentence_index"), F.lit("new2").alias("key")),
        F.struct(F.lit(3).alias("ord"), F.lit("Method").alias("section"), F.lit(1).alias("sentence_index"), F.lit("new1").alias("key")),
        F.struct(F.lit(4).alias("ord"), F.lit("Intro").alias("section"), F.lit(0).alias("sentence_index"), F.concat(F.lit("old"), F.col("source")).alias("key")))).alias("p")).select("doc_id", "p.*")
    _, report = documents.apply_latex_plan(latex_documents(spark, sf), plan)
    return report.select("doc_id", "ord", "key", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def latex_texts(spark, sf):
    """Plain text of LaTeX documents."""
    return latex_documents(spark, sf).select("doc_id", files.latex_body(F.col("text")).alias("body"))


CATALOG.update(relations.QUERIES)
CATALOG.update(branches.QUERIES)
