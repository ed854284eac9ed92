"""Command line: one sub-command per stage, tables by path.

python -m veritrail.plans.cli extract-claims notes.md --output claims
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scores as S
from ..functions.cite import NUMBERED_STYLES
from ..operators import audit, documents, evidence, extract, logs, rank, references, report, retrieve, support, verify
from ..session import build_session, cut_lineage
from ..sources import captured, files

STAGED = schemas.PAPERS + """, paper_id STRING, ord BIGINT, claim_id STRING, claim_text STRING, verification_status STRING,
  evidence_level STRING, evidence_source STRING, evidence_text STRING, support_level STRING,
  support_reasoning STRING, scoring_method STRING"""


def _papers(spark: SparkSession, path: str, *envelopes: str) -> DataFrame:
    """Papers with `ord`: the given positions if every row has one, else the
    places in the input."""
    df = files.read_records(spark, path, STAGED, (envelopes or ("papers",))[0], "_place")
    if df.where("ord IS NULL").limit(1).count():
        df = df.withColumn("ord", F.col("_place"))
    elif df.groupBy("ord").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: the same ord stands at several papers")
    return df.drop("_place")


def _out(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _status(overall: Column) -> Column:
    return F.when(overall == "FAIL", F.lit("blocked")).when(overall == "WEAK", F.lit("review")).otherwise(F.lit("clear"))


def _exit_code(summary: DataFrame) -> int:
    """1 when an audit failed, for shells."""
    return int(summary.first()["overall"] == "FAIL")


def extract_claims(spark, a):
    docs = (spark.createDataFrame([(a.input, "text")], "text STRING, source_format STRING") if a.text
            else files.read_documents(spark, a.input)).withColumn("doc_id", F.lit(a.input) if a.text else F.col("path"))
    claims = extract.extract_claims(docs, compound=not a.no_compound_split, noise_filter=not a.no_filter,
                                    source_format=F.col("source_format"))
    logs.write_claims(claims, a.output)


def classify_claims(spark, a):
    logs.write_claims(extract.classify_claims(files.read_claims(spark, a.input)), a.output)


def detect_need(spark, a):
    logs.write_claims(extract.detect_citation_need(files.read_claims(spark, a.input)), a.output)


def normalize_claims(spark, a):
    hints = spark.read.schema("claim_id STRING, hint STRING").json(a.hints) if a.hints else None
    logs.write_claims(extract.normalize_claims(files.read_claims(spark, a.input), hints), a.output)


def generate_queries(spark, a):
    logs.write_by_claim(extract.generate_queries(files.read_claims(spark, a.input)), a.output)


def search_all(spark, a):
    """Candidates of all sources that are given, without duplicates, blacklisted
    ones and rows outside the years. A source is rows of raw records with query
    and rank, or a folder of captured pages."""
    searches = spark.read.schema("claim_id STRING, query_no INT, query STRING, budget INT").json(a.input)
    given = {"openalex": (a.openalex, schemas.OPENALEX_WORK), "crossref": (a.crossref, schemas.CROSSREF_WORK),
             "semantic_scholar": (a.semantic_scholar, schemas.S2_PAPER), "publish_or_perish": (a.publish_or_perish, schemas.POP_RECORD)}

    def rows(name, path, schema):
        if a.pages and name in captured.RECORDS:
            return captured.captured(spark, path, name, schema).drop("page")
        return spark.read.schema("query STRING, rank BIGINT, " + schema).json(path)

    responses = {name: rows(name, path, schema) for name, (path, schema) in given.items() if path}
    if not responses:
        raise ValueError("no source is given")
    years = tuple(int(y) for y in a.years.split("-")) if a.years else None
    venues = (spark.read.schema("issn STRING, venue STRING, rank BIGINT, citedness DOUBLE").json(a.venue_sources) if a.venue_sources
              else spark.createDataFrame([], "issn STRING, venue STRING, rank BIGINT, citedness DOUBLE"))
    found = retrieve.search_all(searches, responses, files.read_blacklist(spark), files.read_conferences(spark), venues,
                                a.current_year, years=years)
    _out(found, a.output)
    if a.log:
        logs.append_log(retrieve.search_log(found), a.log)


def verify_papers(spark, a):
    raw = lambda path, extra="": spark.read.schema(extra).json(path)
    hit = "query_title STRING, rank INT, "
    registry = {"crossref": raw(a.crossref, schemas.CROSSREF_WORK), "s2_search": raw(a.s2_search, hit + schemas.S2_PAPER),
                "openalex": raw(a.openalex, schemas.OPENALEX_WORK), "openalex_search": raw(a.openalex_search, hit + schemas.OPENALEX_WORK)}
    papers = _papers(spark, a.input)
    out = verify.verify_and_keep(papers, a.cache, **registry) if a.cache else verify.verify_papers(papers, **registry)
    kept, rejected = verify.split_by_verdict(out)
    _out(kept, f"{a.output}/kept")
    _out(rejected, f"{a.output}/rejected")
    if a.log:
        logs.append_log(verify.verification_log(out), a.log)


def fetch_evidence(spark, a):
    out = evidence.fetch_evidence(
        _papers(spark, a.input, "kept"), spark.read.schema(schemas.OPENALEX_WORK).json(a.openalex),
        spark.read.schema("doi STRING, abstract STRING").json(a.semantic_scholar),
        spark.read.schema("arxiv_id STRING, response STRING").json(a.arxiv))
    _out(out, a.output)
    if a.log:
        logs.append_log(evidence.evidence_log(out), a.log)


def score_support(spark, a):
    pairs = _papers(spark, a.input, "kept")
    if a.claim:
        pairs = pairs.withColumn("claim_text", F.lit(a.claim)).withColumn("claim_id", F.lit(a.claim_id))
    if a.pending:
        return _out(support.pending_judgments(pairs), a.output)
    if a.judgments:
        judged = spark.read.schema(schemas.JUDGMENTS + ", ord BIGINT").json(a.judgments)
        scored = support.apply_judgments(pairs, judged)
    else:
        scored = support.score_support(pairs)
    _out(scored, a.output)
    if a.report_md:
        report.write_reports(report.support_report_lines(scored, a.threshold, a.high_rigor), a.report_md)
    if a.log:
        logs.append_log(support.support_log(scored), a.log)


def rank_candidates(spark, a):
    claims = files.read_claims(spark, a.claims).select("claim_id", "claim_type", "citation_need")
    pairs = _papers(spark, a.input).join(claims, "claim_id")
    selected, rejected = rank.rank_all(pairs, a.current_year, a.threshold)
    _out(rank.distinct_papers(selected), f"{a.output}/papers")
    _out(rank.claim_links(selected), f"{a.output}/links")
    _out(rejected, f"{a.output}/rejected")


def format_citations(spark, a):
    listed = references.style_entries(_papers(spark, a.input), a.style)
    listed.select("position", "entry").write.mode("overwrite").json(a.output)


def format_bibtex(spark, a):
    entries = references.bibtex_entries(
        _papers(spark, a.input), existing=files.read_bib_dois(spark, a.existing) if a.existing else None)
    entries.orderBy("ord").select("entry").write.mode("overwrite").text(a.output, lineSep="\n\n")


def search_local(spark, a):
    _out(files.scan_local_papers(spark, a.input), a.output)


def audit_pipeline(spark, a):
    docs = files.read_documents(spark, a.document)
    refs = spark.read.text(a.references).withColumnRenamed("value", "text")
    log = logs.read_verification_log(spark, a.verification_log)
    ev = files.read_jsonl(spark, a.evidence_log, schemas.EVIDENCE_LOG)
    links = files.read_jsonl(spark, a.links, schemas.LINKS)
    final, claims = _papers(spark, a.input), files.read_claims(spark, a.claims)
    present = audit.run_artifacts(spark, a.run_dir) if a.run_dir else None
    out = cut_lineage(audit.full_audit(docs, final, refs, log, ev, claims, links, present, strict=a.strict))
    found = audit.bibliography_findings(docs, final, refs, log, not a.strict).unionByName(audit.chain_findings(final, log, ev))
    if present is not None:
        found = found.unionByName(audit.artifact_findings(present))
    _out(audit.shown_findings(found), f"{a.output}/findings")
    _out(audit.review_links(links, claims, final), f"{a.output}/links")
    policy = F.struct(F.lit(a.strict).alias("strict"), F.lit(not a.strict).alias("likely_real_accepted"))
    logs.write_report(out.withColumn("policy", policy).withColumn("status", _status(F.col("overall"))), f"{a.output}/summary")
    return _exit_code(out)


def insert_latex(spark, a):
    docs = spark.read.text(a.input, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    plan = spark.read.schema(schemas.LATEX_INSERTIONS + ", doc_id STRING, ord INT").json(a.plan)
    changed, reports = documents.apply_latex_plan(docs, plan, command=a.command_name or None)
    _out(reports, f"{a.output}/report")
    if not a.dry_run:
        _out(changed, f"{a.output}/documents")


def insert_docx(spark, a):
    source = spark.read.format("binaryFile").load(a.input)
    plan = spark.read.schema(schemas.INSERTIONS + ", path STRING, ord INT").json(a.plan)
    changed, reports = documents.apply_docx_plan(files.read_docx_paragraphs(spark, a.input), plan, dry_run=a.dry_run)
    _out(reports, f"{a.output}/report")
    if not a.dry_run:
        documents.render_docx(source, changed).write.mode("overwrite").parquet(f"{a.output}/documents")


def _for_each(documents_: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries of a reference list for each of the given files. The list is
    what one document gets, so it is one value."""
    listed = entries.agg(F.collect_list(F.struct(*entries.columns))).scalar()
    return documents_.select("*", F.explode(listed).alias("_e")).select(*documents_.columns, "_e.*")


def update_references(spark, a):
    papers = _papers(spark, a.input)
    if a.mode == "bibtex":
        return logs.append_bibtex(papers, references.bibtex_entries(papers), a.output)
    if a.mode == "thebibliography":
        docs = spark.read.text(a.existing, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
        numbered = a.style in NUMBERED_STYLES
        start = references.numeric_markers_max(docs).first()["last_number"] + 1 if numbered else 1
        items = references.bibitems(papers, a.style, references.bibitem_keys(docs), start=start)
        return _out(references.insert_bibitems(docs, _for_each(docs.select("doc_id"), items)), a.output)
    if a.mode == "docx":
        source = spark.read.format("binaryFile").load(a.existing)
        paragraphs = files.read_docx_paragraphs(spark, a.existing)
        entry = F.regexp_replace("entry", r"^\[\d+\]", "{n}") if a.style in NUMBERED_STYLES else F.col("entry")
        entries = references.style_entries(papers, a.style).select(F.col("position").alias("ord"), entry.alias("entry"))
        added = references.word_additions(paragraphs, _for_each(paragraphs.select("path").distinct(), entries))
        return documents.render_docx(source, paragraphs, added).write.mode("overwrite").parquet(a.output)
    existing = spark.read.text(a.existing).withColumnRenamed("value", "text")
    start = references.numeric_markers_max(existing).first()["last_number"] + 1
    entries = references.style_entries(papers, a.style, start=start)
    references.new_reference_entries(entries, existing).select("position", "entry").write.mode("overwrite").json(a.output)


def audit_bibliography(spark, a):
    refs = spark.read.text(a.references).withColumnRenamed("value", "text")
    found = audit.bibliography_findings(files.read_documents(spark, a.document), _papers(spark, a.input), refs,
                                        logs.read_verification_log(spark, a.verification_log), not a.strict)
    _out(audit.shown_findings(found), f"{a.output}/findings")
    summary = cut_lineage(audit.fold(found))
    logs.write_report(summary.withColumn("status", _status(F.col("overall"))), f"{a.output}/summary")
    return _exit_code(summary)


def audit_entailment(spark, a):
    reviewed = audit.review_links(files.read_jsonl(spark, a.links, schemas.LINKS), files.read_claims(spark, a.claims),
                                  _papers(spark, a.input))
    _out(reviewed, f"{a.output}/links")
    summary = cut_lineage(audit.review_summary(reviewed))
    logs.write_report(summary.withColumn("status", _status(F.col("overall"))), f"{a.output}/summary")
    return _exit_code(summary)


# name -> (function, options). An option is (flag, default); a bool is a switch
# and None is a required value.
COMMANDS = {
    "extract-claims": (extract_claims, {"--text": False, "--no-compound-split": False, "--no-filter": False}),
    "classify-claims": (classify_claims, {}),
    "detect-citation-need": (detect_need, {}),
    "normalize-claims": (normalize_claims, {"--hints": ""}),
    "generate-queries": (generate_queries, {}),
    "search-local": (search_local, {}),
    "search-all": (search_all, {"--openalex": "", "--crossref": "", "--semantic-scholar": "", "--publish-or-perish": "", "--pages": False,
                                "--years": "", "--venue-sources": "", "--current-year": 2026, "--log": ""}),
    "verify-papers": (verify_papers, {"--crossref": None, "--s2-search": None, "--openalex": None,
                                      "--openalex-search": None, "--cache": "", "--log": ""}),
    "fetch-evidence": (fetch_evidence, {"--openalex": None, "--semantic-scholar": None, "--arxiv": None, "--log": ""}),
    "score-support": (score_support, {"--claim": "", "--claim-id": "", "--pending": False, "--judgments": "",
                                      "--report-md": "", "--threshold": S.SUPPORT_THRESHOLD, "--high-rigor": False, "--log": ""}),
    "rank-candidates": (rank_candidates, {"--claims": None, "--threshold": S.SUPPORT_THRESHOLD, "--current-year": 2026}),
    "format-citations": (format_citations, {"--style": "ieee"}),
    "format-bibtex": (format_bibtex, {"--existing": ""}),
    "insert-latex": (insert_latex, {"--plan": None, "--command-name": "", "--dry-run": False}),
    "insert-docx": (insert_docx, {"--plan": None, "--dry-run": False}),
    "update-references": (update_references, {"--mode": "bibtex", "--style": "apa", "--existing": ""}),
    "audit-bibliography": (audit_bibliography, {"--document": None, "--references": None, "--verification-log": None, "--strict": False}),
    "audit-entailment": (audit_entailment, {"--links": None, "--claims": None}),
    "audit-pipeline": (audit_pipeline, {"--document": None, "--references": None, "--verification-log": None,
                                        "--evidence-log": None, "--links": None, "--claims": None, "--run-dir": "", "--strict": False}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritrail")
    subs = top.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = subs.add_parser(name)
        sub.add_argument("input")
        sub.add_argument("--output", "-o", required=True)
        for flag, default in options.items():
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, default=default, required=default is None,
                                 type=type(default) if default is not None else str)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command and returns its exit code: 1 when an audit failed."""
    args = parser().parse_args(argv)
    return COMMANDS[args.command][0](spark or build_session(), args) or 0


if __name__ == "__main__":
    sys.exit(main())
