"""Integrity checks over the whole chain, as anti-joins into one findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.ids import normalize_doi, paper_id_of
from ..functions.text import bind, coverage, first_author, keywords, strip, text_or_empty, unnest
from ..session import cut_lineage
from .contain import contained_fragments
from .keys import first_per_key, last_per_key
from .logs import latest_verdicts
from .support import SUPPORT_KEYWORDS

# Marker patterns, acceptable verdicts, required artifacts.
NUMERIC_MARKER = r"(?U)\[\s*\d+(?:\s*[,-]\s*\d+)*\s*\]"
APA_MARKER = r"(?U)\([^()]*?(?:19|20)\d{2}[a-z]?(?:[^()]*?;[^()]*?)*\)"
DOI_LINK = r"(?U)doi\.org/([^\s\)\]\},]+)"
REQUIRED_ARTIFACTS = {
    "claims.jsonl": "claim extraction",
    "search_log.jsonl": "retrieval log",
    "evidence_log.jsonl": "evidence retrieval",
    "verification_log.jsonl": "paper verification",
    "support_log.jsonl": "support scoring",
    "final_papers.json": "final selection",
}
SHOWN_FINDINGS = 50
_WORD = r"(?U)[\p{L}\p{N}_]+"


def _finding(level: str, check: str, paper: Column, detail: Column) -> list[Column]:
    return [F.lit(level).alias("level"), F.lit(check).alias("check"), paper.cast("string").alias("paper"),
            detail.alias("detail")]



def with_paper_id(papers: DataFrame) -> DataFrame:
    if "paper_id" not in papers.columns:
        return papers.withColumn("paper_id", paper_id_of())
    return papers.withColumn("paper_id", F.coalesce(F.nullif("paper_id", F.lit("")), paper_id_of()))


def verdict_findings(final: DataFrame, log: DataFrame, allow_likely_real: bool = True,
                     order: str = "ord") -> DataFrame:
    """Final papers without a verification record, or with a bad verdict."""
    ok = list(S.ACCEPTED_VERDICTS) if allow_likely_real else ["VERIFIED"]
    latest = latest_verdicts(log, order).select("paper_id", F.lit(True).alias("_in"), "verdict")
    joined = with_paper_id(final).join(latest, "paper_id", "left")
    missing = F.col("_in").isNull()
    bad = ~F.coalesce(F.col("verdict").isin(*ok), F.lit(False))
    return joined.where(missing | bad).select(
        F.lit("FAIL").alias("level"),
        F.when(missing, F.lit("verification_log")).otherwise(F.lit("verification_verdict")).alias("check"),
        F.col("title").alias("paper"),
        F.when(missing, F.lit("no verification log entry")).otherwise(
            F.concat(F.lit("verdict '"), F.coalesce("verdict", F.lit("None")), F.lit("' not acceptable"))).alias("detail"))


def orphan_doi_findings(final: DataFrame, references: DataFrame, text: str = "text") -> DataFrame:
    """DOIs in the reference texts that no final paper has."""
    links = F.regexp_extract_all(F.col(text), F.lit(DOI_LINK), F.lit(1))
    listed = (unnest(references, links, value="d").select(normalize_doi(F.col("d")).alias("doi"))
              .where("doi IS NOT NULL").distinct())
    known = final.select(normalize_doi(F.col("doi")).alias("doi")).where("doi IS NOT NULL").distinct()
    return listed.join(known, "doi", "left_anti").select(*_finding(
        "FAIL", "reference_doi_orphan", F.lit(None),
        F.concat(F.lit("reference lists DOI "), "doi", F.lit(" not in final_papers"))))


def document_markers(documents: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(marker_no, marker, kind) of the citation markers in a document's text."""
    found = F.concat(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(APA_MARKER), F.lit(0)),
                    lambda m: F.struct(F.lit("apa").alias("kind"), m.alias("marker"))),
        F.transform(F.regexp_extract_all(F.col(text), F.lit(NUMERIC_MARKER), F.lit(0)),
                    lambda m: F.struct(F.lit("numeric").alias("kind"), m.alias("marker"))))
    keep = [key] if key else []
    return (unnest(documents, found, *keep, value="m", position="marker_no")
            .select(*keep, "marker_no", "m.kind", "m.marker"))


def mapped_markers(markers: DataFrame, final: DataFrame) -> DataFrame:
    """Distinct marker texts that name a final paper: its first author's last
    name as a whole word, and its year (an unknown year is in every marker).

    The first word of the name has to be a word of the marker, so that is the
    join key; papers and markers are reduced to their distinct forms first."""
    first = strip(F.substring_index(first_author(F.col("authors")), ",", 1))
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit(""))
    names = (final.select(first.alias("name"), year.alias("year")).where("name <> ''").distinct()
             .withColumn("word", F.lower(F.regexp_extract("name", _WORD, 0))).where("word <> ''"))
    texts = markers.select("marker").distinct()
    words = unnest(texts, F.array_distinct(F.regexp_extract_all(F.lower("marker"), F.lit(_WORD), F.lit(0))),
                   "marker", value="word")
    pattern = F.concat(F.lit(r"(?iU)\b\Q"), "name", F.lit(r"\E\b"))
    return (words.join(names, "word")
            .where(F.contains("marker", F.col("year")) & F.regexp_like("marker", pattern))
            .select("marker").distinct())


def marker_findings(documents: DataFrame, final: DataFrame, text: str = "text") -> DataFrame:
    # Read twice, but found once: the texts are long, their markers short.
    markers = cut_lineage(document_markers(documents, text).select("marker"))
    return markers.join(mapped_markers(markers, final), "marker", "left_anti").select(*_finding(
        "WEAK", "citation_in_document", F.lit(None),
        F.concat(F.lit("marker '"), F.substring("marker", 1, 50), F.lit("' not mapped to any final paper"))))


def reference_entry_findings(final: DataFrame, references: DataFrame, text: str = "text") -> DataFrame:
    """Final papers whose title (60 characters) is in no reference entry. With
    no reference texts at all there is nothing to check."""
    head = F.lower(F.substring(text_or_empty(F.col("title")), 1, 60))
    papers = final.select(head.alias("fragment")).where("fragment <> ''")
    found = contained_fragments(papers, references.select(F.lower(text).alias("body")))
    some = references.limit(1).agg(F.count(F.lit(1)).alias("c")).scalar() > 0
    return papers.where(some).join(found, "fragment", "left_anti").select(*_finding(
        "WEAK", "reference_entry", F.lit(None),
        F.concat(F.lit("'"), F.substring("fragment", 1, 40), F.lit("...' missing from reference list"))))


def bibliography_findings(documents: DataFrame, final: DataFrame, references: DataFrame, log: DataFrame,
                          allow_likely_real: bool = True, order: str = "ord") -> DataFrame:
    """All findings of the bibliographic gate."""
    return (verdict_findings(final, log, allow_likely_real, order)
            .unionByName(orphan_doi_findings(final, references))
            .unionByName(marker_findings(documents, final))
            .unionByName(reference_entry_findings(final, references)))


def fold(findings: DataFrame) -> DataFrame:
    """One row: overall, fails, weak."""
    level = F.col("level")
    return findings.agg(
        F.when(F.count_if(level == "FAIL") > 0, F.lit("FAIL"))
        .when(F.count_if(level == "WEAK") > 0, F.lit("WEAK")).otherwise(F.lit("PASS")).alias("overall"),
        F.count_if(level == "FAIL").alias("fails"), F.count_if(level == "WEAK").alias("weak"))


def shown_findings(findings: DataFrame) -> DataFrame:
    """The first findings in a fixed order: the report shows at most fifty."""
    return findings.orderBy("level", "check", "paper", "detail").limit(SHOWN_FINDINGS)


# --- chain ---------------------------------------------------------------------

def run_artifacts(spark: SparkSession, run_dir: str) -> DataFrame:
    """(name, bytes) of the files and folders of a run; only sizes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(run_dir)
    inside = F.split_part(F.col("path"), F.lit(run_dir.rstrip("/") + "/"), F.lit(-1))
    return found.select(F.split_part(inside, F.lit("/"), F.lit(1)).alias("name"), "length").groupBy("name").agg(
        F.sum("length").alias("bytes"))


def artifact_findings(present: DataFrame) -> DataFrame:
    """`present`: (name, bytes) of the files of a run. Missing and empty ones fail."""
    spark = present.sparkSession
    required = spark.createDataFrame(list(REQUIRED_ARTIFACTS.items()), "name STRING, purpose STRING")
    there = present.where("bytes > 0").select("name").distinct()
    return required.join(there, "name", "left_anti").select(*_finding(
        "FAIL", "artifact_missing", F.lit(None), F.concat("name", F.lit(" ("), "purpose", F.lit(")"))))


def artifact_presence(present: DataFrame) -> DataFrame:
    spark = present.sparkSession
    required = spark.createDataFrame([(n,) for n in REQUIRED_ARTIFACTS], "name STRING")
    there = present.where("bytes > 0").select("name").distinct().withColumn("present", F.lit(True))
    return required.join(there, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def chain_findings(final: DataFrame, verification: DataFrame, evidence: DataFrame) -> DataFrame:
    """Final papers without a verification or an evidence record."""
    papers = with_paper_id(final)
    title = F.substring(text_or_empty(F.col("title")), 1, 50)
    verified = verification.where("event = 'verification'").select("paper_id").distinct()
    evidenced = evidence.where("paper_id IS NOT NULL").select("paper_id").distinct()
    gap = lambda known, what: papers.join(known, "paper_id", "left_anti").select(*_finding(
        "FAIL", "chain_gap", F.col("title"), F.concat(title, F.lit(f" lacks {what} record"))))
    return gap(verified, "verification").unionByName(gap(evidenced, "evidence"))


# --- entailment ------------------------------------------------------------------

def _unusable(evidence: Column) -> Column:
    return F.length(strip(evidence)) < S.ENTAILMENT_MIN_CHARS


def entailment_verdict(claim_kw: Column, evidence_kw: Column, evidence: Column) -> Column:
    """{verdict, reason} from keyword coverage alone, which is computed once."""
    return _entailment_verdict(claim_kw, evidence_kw, _unusable(evidence))


def _entailment_verdict(claim_kw: Column, evidence_kw: Column, unusable: Column) -> Column:
    result = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))

    def judged(score: Column) -> Column:
        shown = F.format_string("%.2f", S.py_round(score, 2))
        text = lambda tail: F.concat(F.lit("heuristic overlap "), shown, F.lit(tail))
        return (F.when(score >= S.ENTAILMENT_PASS, result("PASS", text("")))
                .when(score >= S.ENTAILMENT_WEAK, result("WEAK", text(" — weak topical link")))
                .otherwise(result("FAIL", text(" — no substantive link"))))

    score = bind(claim_kw, lambda a: bind(evidence_kw, lambda b: coverage(a, b)))
    return F.when(unusable, result("FAIL", F.lit("no usable evidence text to review"))).otherwise(bind(score, judged))


def review_links(links: DataFrame, claims: DataFrame, papers: DataFrame,
                 judged: DataFrame | None = None) -> DataFrame:
    """Second opinion on every link, blind to the scores. `judged` (claim_id,
    paper_id, content) are answers of an external judge.

    Evidence is read where it lies, so keywords meet in the joins and not texts;
    a paper's own text is fetched only for links without evidence."""
    by_claim = last_per_key(claims.select(
        "claim_id", F.coalesce(F.nullif("original_text", F.lit("")), F.col("normalized_claim"), F.lit("")).alias("_claim"),
        "claim_no" if "claim_no" in claims.columns else F.lit(0).alias("claim_no")), ["claim_id"], ["claim_no", "_claim"])
    by_claim = by_claim.select("claim_id", "_claim", keywords(F.col("_claim"), SUPPORT_KEYWORDS).alias("_claim_kw"))
    df = links.drop("support_score", "support_level")
    keys = ["paper_id", "claim_id"] if judged is None else ["claim_id", "paper_id"]
    kept = keys + [c for c in df.columns if c not in keys]
    method, unread, by_judge = F.lit("heuristic"), F.lit(True), None
    if judged is not None:
        found = F.nullif(F.regexp_extract(text_or_empty(F.col("content")), r"(?s)\{.*\}", 0), F.lit(""))
        answers = judged.select("claim_id", "paper_id", F.from_json(found, "verdict STRING, reason STRING").alias("_j"))
        df = df.join(answers.where("_j IS NOT NULL"), ["claim_id", "paper_id"], "left")
        said = F.upper(F.coalesce(F.col("_j.verdict"), F.lit("WEAK")))
        by_judge = F.struct(F.when(said.isin("PASS", "WEAK", "FAIL"), said).otherwise(F.lit("WEAK")).alias("verdict"),
                            text_or_empty(F.col("_j.reason")).alias("reason"))
        unread = F.col("_j").isNull()
        method = F.when(unread, method).otherwise(F.lit("llm"))
    read = lambda text: F.struct(keywords(text, SUPPORT_KEYWORDS).alias("kw"), _unusable(text).alias("unusable"))
    none = F.coalesce(F.col("evidence_text"), F.lit("")) == ""
    own = df.where(~none).withColumn("_read", F.when(unread, read(F.col("evidence_text"))))
    bare = df.where(none)
    by_paper = first_per_key(with_paper_id(papers).select(
        "paper_id", F.coalesce(F.nullif("evidence_text", F.lit("")), F.col("abstract"), F.lit("")).alias("_fallback"))
        .join(bare.where(unread).select("paper_id").distinct(), "paper_id", "left_semi"), ["paper_id"], ["_fallback"])
    by_paper = by_paper.select("paper_id", read(F.col("_fallback")).alias("_read"))
    lent = bare.join(by_paper, "paper_id", "left").withColumn("_read", F.coalesce("_read", read(F.lit(""))))
    df = own.unionByName(lent).join(by_claim, "claim_id", "left").withColumn("_claim", text_or_empty(F.col("_claim")))
    empty = F.array().cast("array<string>")
    verdict = _entailment_verdict(F.coalesce("_claim_kw", empty), F.col("_read.kw"), F.col("_read.unusable"))
    if by_judge is not None:
        verdict = F.when(unread, verdict).otherwise(by_judge)
    return (df.withColumn("_v", verdict).withColumn("review_method", method)
            .withColumn("claim_text", F.substring("_claim", 1, 500))
            .withColumn("entailment_verdict", F.col("_v.verdict")).withColumn("entailment_reason", F.col("_v.reason"))
            .select(*kept, "review_method", "claim_text", "entailment_verdict", "entailment_reason"))


def review_summary(reviewed: DataFrame) -> DataFrame:
    v = F.col("entailment_verdict")
    return reviewed.agg(
        F.when(F.count_if(v == "FAIL") > 0, F.lit("FAIL")).when(F.count_if(v == "WEAK") > 0, F.lit("WEAK"))
        .otherwise(F.lit("PASS")).alias("overall"),
        *[F.count_if(v == name).alias(name) for name in ("PASS", "WEAK", "FAIL")])


def full_audit(documents: DataFrame, final: DataFrame, references: DataFrame, verification: DataFrame,
               evidence: DataFrame, claims: DataFrame, links: DataFrame, present: DataFrame | None = None,
               strict: bool = False, order: str = "ord") -> DataFrame:
    """One row: overall verdict, and per gate its verdict and counts."""
    gate_a = fold(bibliography_findings(documents, final, references, verification, not strict, order))
    gate_b = review_summary(review_links(links, claims, final))
    chain = chain_findings(final, verification, evidence)
    if present is not None:
        chain = chain.unionByName(artifact_findings(present))
    chain_row = fold(chain)
    rows = (gate_a.select(F.lit("8A_bibliographic").alias("gate"), "overall", "fails", "weak")
            .unionByName(gate_b.select(F.lit("8B_entailment").alias("gate"), "overall",
                                       F.col("FAIL").alias("fails"), F.col("WEAK").alias("weak")))
            .unionByName(chain_row.select(F.lit("chain").alias("gate"), "overall", "fails", "weak")))
    worst = F.max(F.when(F.col("overall") == "FAIL", 2).when(F.col("overall") == "WEAK", 1).otherwise(0))
    gates = F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", F.struct("overall", "fails", "weak")))))
    return rows.agg(F.element_at(F.array(F.lit("PASS"), F.lit("WEAK"), F.lit("FAIL")), worst + 1).alias("overall"),
                    gates.alias("gates"))
