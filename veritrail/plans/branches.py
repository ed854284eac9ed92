"""Queries on the stages and branches that the others do not reach, with SQL in
branches_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cite
from ..functions import claims as C
from ..functions import scores as S
from ..functions import text as X
from ..functions.ids import paper_id_of
from ..operators import audit, dedup, documents, extract, rank, references, report, retrieve, support, verify
from ..sources import mappers
from . import bridge as B
from .relations import cited_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def papers(spark, sf):
    return B.papers(spark, sf).withColumn("paper_id", paper_id_of())


# --- judges and hints ---------------------------------------------------------------------

def judged_pairs(spark, sf):
    p = papers(spark, sf)
    return p.select(
        "doc_id", F.col("doc_id").cast("string").alias("claim_id"), "paper_id", "title", "doi", "year", "authors", "venue", "abstract",
        F.lit("It works.").alias("claim_text"), F.col("abstract").alias("evidence_text"),
        F.when(F.col("abstract") == "", F.lit("METADATA_ONLY")).otherwise(F.lit("ABSTRACT")).alias("evidence_level"))


@query
def judged_scores(spark, sf):
    """A judge's answers among other text; every third is none, and levels are
    missing in part. Title-only evidence is capped."""
    pairs = judged_pairs(spark, sf)
    number = (F.col("doc_id") % 13 / 10).cast("string")
    level = F.when(F.col("doc_id") % 2 == 0, F.lit("direct")).otherwise(F.lit(""))
    content = F.when(F.col("doc_id") % 3 != 2, F.concat(
        F.lit('Well: {"support_score": '), number, F.lit(', "support_level": "'), level, F.lit('", "reasoning": "read"} so it is.')))
    judged = pairs.select("claim_id", "paper_id", F.coalesce(content, F.lit("no verdict")).alias("content"))
    out = support.score_support(pairs, judged=judged).where("scoring_method = 'llm'")
    return out.select("doc_id", "support_score", "support_level", "support_reasoning")


@query
def applied_judgments(spark, sf):
    """Two judgments per paper, of which the later counts."""
    pairs = judged_pairs(spark, sf)
    given = pairs.where("doc_id % 2 = 0").select("claim_id", "paper_id", F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit(0.9).alias("support_score")),
        F.struct(F.lit(2).alias("ord"), (F.col("doc_id") % 10 / 8).alias("support_score")))).alias("j")).select(
        "claim_id", "paper_id", "j.ord", "j.support_score", F.lit("").alias("support_level"), F.lit("why").alias("reasoning"))
    out = support.apply_judgments(pairs, given).where("scoring_method = 'agent_llm'")
    return out.select("doc_id", "support_score", "support_level", "support_reasoning")


@query
def pending_judgments(spark, sf):
    out = support.pending_judgments(judged_pairs(spark, sf))
    return out.select("claim_id", "claim", "paper_id", F.array_join("authors", "|").alias("authors"), "evidence_level",
                      F.length("evidence_text").alias("evidence_chars"))


@query
def judged_entailment(spark, sf):
    """A judge's verdicts on links, odd ones read as WEAK, the rest by overlap."""
    p = judged_pairs(spark, sf)
    said = F.element_at(F.array(*[F.lit(v) for v in ("pass", "FAIL", "unsure", "Weak")]), (F.col("doc_id") % 4 + 1).cast("int"))
    judged = p.where("doc_id % 5 <> 4").select("claim_id", "paper_id", F.concat(F.lit('{"verdict": "'), said, F.lit('", "reason": "r"}')).alias("content"))
    claims = p.select("claim_id", F.col("claim_text").alias("original_text"), F.lit("").alias("normalized_claim"))
    out = audit.review_links(p.select("claim_id", "paper_id", "evidence_text"), claims, B.papers(spark, sf).withColumn("evidence_text", F.lit("")), judged)
    return out.groupBy("entailment_verdict", "review_method").agg(F.count(F.lit(1)).alias("n"))


@query
def hinted_claims(spark, sf):
    """Claims with an English hint for every other one."""
    claims = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), B.headline(F.col("text")).alias("original_text"))
    hints = claims.where("claim_id % 2 = 0").select("claim_id", F.concat(F.lit("  Teachers in China use claim "), "claim_id").alias("hint"))
    return extract.normalize_claims(claims, hints).select("claim_id", "normalized_claim", "population", "geography")


# --- verification cache and audit ----------------------------------------------------------

@query
def cached_verdicts(spark, sf):
    """Every third paper with a DOI has a verdict in the cache."""
    p = B.papers(spark, sf)
    kind = verify.verify_papers(p.limit(0), **_registry(spark, sf)).schema["verification_details"].dataType
    cache = p.where("doc_id % 3 = 0 AND doi IS NOT NULL").select(F.upper("doi").alias("doi")).distinct().select(
        "doi", F.lit("CONFLICT").alias("verdict"), F.lit(None).cast(kind).alias("details"), F.lit(False).alias("authors_backfilled"),
        F.array().cast("array<string>").alias("authors"))
    out = verify.verify_with_cache(p, cache, **_registry(spark, sf))
    return out.select("doc_id", "verification_status", "verification_cached")


def _registry(spark, sf):
    return {"crossref": B.crossref_works(spark, sf), "s2_search": B.title_hits(spark, sf, "semantic_scholar"),
            "openalex": B.openalex_works(spark, sf), "openalex_search": B.title_hits(spark, sf, "openalex")}


def _gate_parts(spark, sf):
    from .catalog import final_papers, marked_documents, verdict_log
    refs = B.papers(spark, sf).where("doc_id % 4 <> 1").select(cite.apa_entry(cite.PaperColumns()).alias("text"))
    return marked_documents(spark, sf), final_papers(spark, sf), refs, verdict_log(spark, sf)


@query
def bibliographic_gate(spark, sf):
    """The whole gate by level and check: its four parts together."""
    found = audit.bibliography_findings(*_gate_parts(spark, sf), allow_likely_real=False)
    return found.groupBy("level", "check").agg(F.count(F.lit(1)).alias("n"))


@query
def whole_audit(spark, sf):
    """Gates, chain and run files in one row, flattened."""
    docs, final, refs, log = _gate_parts(spark, sf)
    p = judged_pairs(spark, sf)
    claims = p.select("claim_id", F.col("claim_text").alias("original_text"), F.lit("").alias("normalized_claim"))
    ev = B.papers(spark, sf).where("doc_id % 2 = 0").select(paper_id_of().alias("paper_id"))
    present = B.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("bytes"))
    final = final.withColumn("evidence_text", F.lit(""))
    out = audit.full_audit(docs, final, refs, log, ev, claims, p.select("claim_id", "paper_id", "evidence_text"), present, strict=True)
    return out.select("overall", F.explode("gates").alias("gate", "g")).select(
        "overall", "gate", F.col("g.overall").alias("gate_overall"), "g.fails", "g.weak")


# --- documents ------------------------------------------------------------------------------

def word_paragraphs(spark, sf):
    """Every line as a paragraph of two runs; some are headings."""
    lines = X.unnest(B.table(spark, sf, "documents").withColumn("path", F.col("doc_id").cast("string")), F.split("text", "\n"), "doc_id", "path",
                     value="line", position="paragraph_id")
    half = F.floor(F.length("line") / 2).cast("int")
    style = F.when(F.col("paragraph_id") % 7 == 0, F.lit("Heading 2")).when(F.col("paragraph_id") % 11 == 4, F.lit("Title")).otherwise(F.lit("Normal"))
    return lines.select("doc_id", "path", "paragraph_id", style.alias("style"),
                        F.array(F.left("line", half), F.substring("line", half + 1, F.length("line"))).alias("runs"))


@query
def word_structure(spark, sf):
    """Sections of paragraphs, and whether they hold references."""
    out = documents.docx_structure(word_paragraphs(spark, sf))
    return out.select("doc_id", "paragraph_id", "is_heading", "heading_level", F.coalesce("section", F.lit("")).alias("section"),
                      F.coalesce("section_start", F.lit(-1)).alias("section_start"), F.coalesce("section_end", F.lit(-1)).alias("section_end"),
                      documents.section_priority(F.coalesce("section", F.lit(""))).alias("priority"))


@query
def word_references(spark, sf):
    """Paragraphs of reference sections: every seventh line heads one in the
    documents of even number."""
    p = word_paragraphs(spark, sf).withColumn("runs", F.when(
        (F.col("paragraph_id") % 7 == 0) & (F.col("doc_id") % 2 == 0), F.array(F.lit("References"))).otherwise(F.col("runs")))
    found = documents.existing_references(documents.docx_structure(p)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    heads = documents.find_heading(p, " references ").select(F.col("path").cast("bigint").alias("doc_id"), F.col("paragraph_id").alias("heading"))
    return heads.join(found, "doc_id", "left").select("doc_id", "heading", F.coalesce("n", F.lit(0)).alias("n"))


@query
def word_insertions(spark, sf):
    """A marker in the first sentence of every document's first paragraph, twice,
    and one in a sentence that is not there."""
    paragraphs = word_paragraphs(spark, sf)
    item = lambda ord_, sentence: F.struct(F.lit(ord_).alias("ord"), F.lit(sentence).alias("sentence_index"))
    plan = paragraphs.where("paragraph_id = 0").select("path", "paragraph_id", F.explode(F.array(item(1, 0), item(2, 0), item(3, 900))).alias("i")).select(
        "path", "paragraph_id", "i.ord", "i.sentence_index", F.lit(" [77]").alias("marker"), F.lit("keep").alias("existing"))
    changed, reports = documents.apply_docx_plan(paragraphs, plan)
    first = changed.where("paragraph_id = 0").select("path", F.array_join("runs", "").alias("text"))
    return reports.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "status"))), lambda x: x["status"]), "|").alias("statuses")).join(
        first, "path").select(F.col("path").cast("bigint").alias("doc_id"), "statuses", "text")


@query
def closing_markers(spark, sf):
    """A marker in front of the closing mark of every line, and the command in use."""
    lines = X.unnest(B.table(spark, sf, "documents"), F.split("text", "\n"), "doc_id", value="line", position="line_no")
    tex = F.concat("line", F.element_at(F.array(*[F.lit(c) for c in (" \\citet{a}", " \\cite{a} \\parencite{b}", " \\textcite{c}", "")]), (F.col("line_no") % 4 + 1).cast("int")))
    return lines.select("doc_id", "line_no", documents.insert_before_end(F.col("line"), F.lit(" [1]")).alias("text"),
                        documents.citation_command(tex).alias("command"))


# --- references -------------------------------------------------------------------------------

@query
def last_reference_number(spark, sf):
    return references.numeric_markers_max(cited_documents(spark, sf))


@query
def bibliography_items(spark, sf):
    """Items of papers that are not listed yet, numbered behind the listed ones."""
    p = papers(spark, sf)
    known = p.where("doc_id % 5 = 0").select(F.concat(F.lit("x \\bibitem[1]{"), "paper_id", F.lit("} y")).alias("text"))
    out = references.bibitems(B.papers(spark, sf), "ieee", references.bibitem_keys(known), start=7)
    return out.select(F.col("ord").cast("bigint").alias("ord"), "key", "item")


@query
def apa_list_with_suffixes(spark, sf):
    listed = references.year_suffixes(B.papers(spark, sf))
    out = references.apa_reference_list(listed, suffix="suffix")
    return out.select(F.col("ord").cast("bigint").alias("ord"), "sort_name", "sort_year", "entry")


@query
def two_paper_lists(spark, sf):
    """Two lists, the second behind the first, merged into one without duplicates."""
    p = B.papers(spark, sf)
    out = dedup.deduplicate_pairs(p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1"))
    return out.select("paper_id", F.col("ord.ord").cast("bigint").alias("ord"), F.col("merged_from").cast("bigint").alias("merged_from"), "source")


def many_authors(spark, sf):
    """Up to 25 authors, Chinese ones among them, at journals and proceedings."""
    n = (F.col("doc_id") % 26).cast("int")
    family = F.array(*[F.lit(f) for f in B.FAMILY_NAMES])
    names = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                        lambda i: F.concat(F.lit("Ann Bo "), F.element_at(family, (i + F.col("doc_id").cast("int")) % 10 + 1)))
    return B.papers(spark, sf).withColumn("authors", names).withColumn("venue", F.when(
        F.col("doc_id") % 3 == 0, F.lit("Proceedings of X")).otherwise(F.lit("Journal Y"))).withColumn("journal", F.col("venue"))


@query
def long_author_lists(spark, sf):
    a = F.col("authors")
    return many_authors(spark, sf).select(
        "doc_id", cite.ieee_authors(a).alias("ieee"), cite.apa_authors(a).alias("apa"), cite.nature_authors(a).alias("nature"),
        cite.vancouver_authors(a).alias("vancouver"))


@query
def proceedings_entries(spark, sf):
    p = cite.PaperColumns()
    return many_authors(spark, sf).select("doc_id", cite.ieee_entry(p).alias("ieee"), F.substring_index(
        cite.bibtex_entry(p, F.lit("k")), "\n", 1).alias("bibtex_kind"))


@query
def combined_markers(spark, sf):
    """Markers of one venue and year as one, words without hedges, close years."""
    p = references.marker_texts(B.papers(spark, sf))
    close = S.years_close(F.col("year"), (2000 + F.col("doc_id") % 25).cast("int"))
    hedged = F.concat_ws(" ", F.lit("It may seem that"), "title", F.lit("often works"))
    return p.select("doc_id", cite.apa_combine(F.array("marker", F.lit("(Lee, 2020)"))).alias("combined"),
                    C.strip_hedges(hedged).alias("plain"), close.alias("close"))


# --- selection and sources ------------------------------------------------------------------------

@query
def distinct_selected(spark, sf):
    from .catalog import YEAR, topic_pairs
    selected, _ = rank.rank_all(topic_pairs(spark, sf), YEAR)
    return rank.distinct_papers(selected).select("paper_id", "claim_id", "doc_id")


@query
def support_buckets(spark, sf):
    from .catalog import topic_pairs
    return report.report_buckets(topic_pairs(spark, sf))


@query
def web_mapped(spark, sf):
    """Web hits of two services as papers."""
    p = B.papers(spark, sf)
    person = lambda a: F.struct(F.split_part(F.replace(a, F.lit(","), F.lit("")), F.lit(" "), F.lit(1)).alias("first_name"), F.lit("Exa").alias("last_name"))
    exa = p.select("doc_id", F.col("title"), F.col("url"), F.lit("h").alias("highlight"), F.struct(
        F.lit("").alias("title"), F.transform("authors", person).alias("authors"), F.col("venue").alias("journal"), F.lit("").alias("venue"),
        F.lit("").alias("year"), F.concat(F.coalesce("year", F.lit(1990)).cast("string"), F.lit("-05-01")).alias("publishedDate"), F.col("doi").alias("doi"),
        F.lit(None).cast("string").alias("description"), F.lit("s").alias("summary"), F.lit("1").alias("volume"), F.lit("P").alias("publisher")).alias("metadata"))
    scholar = p.select("doc_id", F.col("url").alias("pub_url"), F.struct(
        "title", F.array(F.lit(" Ann Lee ")).alias("author"), F.coalesce(F.col("year").cast("string"), F.lit("NA")).alias("pub_year"), F.lit("").alias("venue"),
        F.lit(None).cast("string").alias("doi"), F.lit("a").alias("abstract")).alias("bib"))
    columns = ["doc_id", "source", "title", F.array_join("authors", "|").alias("authors"), F.coalesce("year", F.lit(-1)).alias("year"), "venue_type",
               F.coalesce("doi", F.lit("")).alias("doi"), "abstract"]
    return mappers.map_exa(exa, keep=("doc_id",)).select(*columns).unionByName(mappers.map_google_scholar(scholar, keep=("doc_id",)).select(*columns))


@query
def typed_search(spark, sf):
    """A source asked for its types within years: limits count what passes."""
    p = B.papers(spark, sf)
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("article", "book", "preprint", "dataset")]), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = p.select(
        F.col("journal").alias("query"), F.col("doc_id").alias("rank"), F.concat(F.lit("W"), "doc_id").alias("id"), "doi", "title",
        F.lit(None).cast("string").alias("display_name"), F.col("year").alias("publication_year"), kinds.alias("type"), "language",
        F.col("citation_count").alias("cited_by_count"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.struct(F.col("journal").alias("display_name"), F.lit(None).cast("string").alias("issn_l"), F.lit(None).cast("array<string>").alias("issn"),
                          F.lit(None).cast("string").alias("host_organization_name")).alias("source")).alias("primary_location"),
        F.struct(F.lit(False).alias("is_oa"), F.lit(None).cast("string").alias("oa_status"), F.lit(None).cast("string").alias("oa_url")).alias("open_access"),
        F.struct(*[F.lit(None).cast("string").alias(c) for c in ("volume", "issue", "first_page", "last_page")]).alias("biblio"),
        F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"))
    searches = p.select(F.col("journal").alias("claim_id"), F.col("journal").alias("query"), F.lit(5).alias("budget")).distinct()
    out = retrieve.source_candidates(searches, "openalex", raw, 0, ["claim_id"], (2004, 2022))
    return out.select("claim_id", F.col("ord").cast("bigint").alias("ord"), "title", "year", "venue_type")
