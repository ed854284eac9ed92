"""The command line from a text file to ranked papers, on files."""

import io
import json
import zipfile
from xml.etree import ElementTree

from veritrail.operators import audit
from veritrail.plans import cli


def test_commands_run_end_to_end(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args), spark)
    (tmp_path / "notes.md").write_text("Students use many tools every single day.\nTrust is defined as a stable belief.\n")
    run("extract-claims", at("notes.md"), "-o", at("claims.jsonl"))
    run("classify-claims", at("claims.jsonl"), "-o", at("typed.jsonl"))
    run("detect-citation-need", at("typed.jsonl"), "-o", at("need.jsonl"))
    run("normalize-claims", at("need.jsonl"), "-o", at("norm.jsonl"))
    run("generate-queries", at("norm.jsonl"), "-o", at("queries"))
    claims = {r.claim_id: r for r in spark.read.json(at("norm.jsonl")).collect()}
    assert claims["C002"].claim_type == "DEFINITION" and claims["C001"].population == "students"
    assert spark.read.json(at("queries")).count() == 2

    paper = {"title": "Trust as a stable belief", "authors": ["Lee, Ann"], "year": 2020, "doi": "10.1/a", "ord": 1, "claim_id": "C002",
             "claim_text": "Trust is defined as a stable belief.", "verification_status": "VERIFIED", "evidence_level": "ABSTRACT",
             "evidence_text": "Trust is defined here as a stable belief of people.", "venue": "V", "tier_score": 0.4}
    (tmp_path / "papers.jsonl").write_text(json.dumps(paper) + "\n")
    run("score-support", at("papers.jsonl"), "-o", at("scored.jsonl"), "--log", at("support_log.jsonl"), "--report-md", at("report"))
    run("rank-candidates", at("scored.jsonl"), "-o", at("final"), "--claims", at("norm.jsonl"))
    links = spark.read.json(at("final/links")).collect()
    assert [(r.claim_id, r.support_level) for r in links] == [("C002", "DIRECT")]
    run("format-citations", at("papers.jsonl"), "-o", at("refs"), "--style", "apa")
    assert spark.read.json(at("refs")).first().entry == "Lee, A. (2020). Trust as a stable belief. *V*. https://doi.org/10.1/a"
    run("update-references", at("papers.jsonl"), "-o", at("bib"))
    run("update-references", at("papers.jsonl"), "-o", at("bib"))
    assert "".join(r.value for r in spark.read.text(at("bib")).collect()).count("@article") == 1
    sizes = {r.name for r in audit.artifact_presence(audit.run_artifacts(spark, str(tmp_path))).where("present").collect()}
    assert sizes == {"claims.jsonl", "support_log.jsonl"}


def test_search_and_cache(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    run = lambda *args: cli.main(list(args), spark)
    work = lambda i, title, year, kind="article": {"id": f"W{i}", "title": title, "publication_year": year, "type": kind, "doi": f"https://doi.org/10.1/{i}",
                                                    "authorships": [{"author": {"display_name": "Ann Lee"}}]}
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/1.json").write_text(json.dumps({"query": "trust", "results": [
        work(1, "Trust in tools", 2020), work(2, "Trust before", 1990), work(3, "A data set", 2020, "dataset"), work(1, "Trust in tools", 2020)]}))
    (tmp_path / "searches.json").write_text(json.dumps({"claim_id": "C001", "query_no": 0, "query": "trust", "budget": 10}))
    assert run("search-all", at("searches.json"), "-o", at("found"), "--openalex", at("pages"), "--pages", "--years", "2000-2025", "--log", at("log")) == 0
    found = spark.read.json(at("found")).collect()
    assert [(r.claim_id, r.title, r.merged_from) for r in found] == [("C001", "Trust in tools", 2)]
    assert spark.read.json(at("log")).first().event == "search_result"

    (tmp_path / "crossref.json").write_text(json.dumps({"DOI": "10.1/1", "title": ["Trust in tools"], "author": [{"given": "Ann", "family": "Lee"}], "issued": {"date-parts": [[2020]]}}))
    (tmp_path / "none.json").write_text("")
    tables = ("--crossref", at("crossref.json"), "--s2-search", at("none.json"), "--openalex", at("none.json"), "--openalex-search", at("none.json"))
    run("verify-papers", at("found"), "-o", at("v1"), *tables, "--cache", at("cache"))
    (tmp_path / "crossref.json").write_text("")
    run("verify-papers", at("found"), "-o", at("v2"), *tables, "--cache", at("cache"))
    for name, cached in (("v1", False), ("v2", True)):
        kept = spark.read.json(at(f"{name}/kept")).collect()
        assert [(r.verification_status, r.verification_cached) for r in kept] == [("LIKELY_REAL", cached)]


def test_references_into_documents(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    papers = [{"title": t, "authors": ["Lee, Ann"], "year": 2020, "venue": "V", "ord": i} for i, t in enumerate(("Old work", "New work"))]
    (tmp_path / "papers.jsonl").write_text("\n".join(map(json.dumps, papers)))
    (tmp_path / "paper.tex").write_text("Text [4].\n\\begin{thebibliography}{9}\n\\bibitem{k} [4] Known\n\\end{thebibliography}\n")
    cli.main(["update-references", at("papers.jsonl"), "-o", at("tex"), "--mode", "thebibliography", "--style", "ieee", "--existing", at("paper.tex")], spark)
    text = spark.read.json(at("tex")).first().text
    assert "} [5] A. Lee" in text and "} [6] A. Lee" in text and text.rstrip().endswith("\\end{thebibliography}")

    body = lambda *paras: ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(
        f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>" if h else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for h, t in paras) + "</w:body></w:document>")
    for name, paras in (("bare", [(False, "Only text.")]), ("listed", [(True, "References"), (False, "[3] A. Lee, \"Old work,\" *V*, 2020.")])):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as archive:
            archive.writestr("word/document.xml", body(*paras))
        cli.main(["update-references", at("papers.jsonl"), "-o", at(name), "--mode", "docx", "--style", "ieee", "--existing", at(f"{name}.docx")], spark)
        spark.read.parquet(at(name)).select("content").first()
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(bytes(spark.read.parquet(at(name)).first().content))) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
        lines = ["".join(t.text or "" for t in para.iter(f"{w}t")) for para in root.iter(f"{w}p")]
        if name == "bare":
            assert lines[1] == "References" and [x[:3] for x in lines[2:]] == ["[1]", "[2]"]
        else:
            assert [x[:3] for x in lines if x.startswith("[")] == ["[3]", "[4]"] and "New work" in lines[-1]


def test_audit_says_so(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "papers.jsonl").write_text(json.dumps({"title": "Trust", "authors": ["Lee, Ann"], "year": 2020, "doi": "10.1/a", "ord": 1}))
    (tmp_path / "doc.md").write_text("Trust matters (Lee, 2020).")
    (tmp_path / "refs.txt").write_text("Lee, A. (2020). Trust. https://doi.org/10.1/a")
    (tmp_path / "v.jsonl").write_text("")
    for name in ("e.jsonl", "links.jsonl", "claims.jsonl"):
        (tmp_path / name).write_text("")
    common = ("--document", at("doc.md"), "--references", at("refs.txt"), "--verification-log", at("v.jsonl"))
    assert cli.main(["audit-bibliography", at("papers.jsonl"), "-o", at("a"), *common], spark) == 1
    assert spark.read.json(at("a/summary")).first().status == "blocked"
    code = cli.main(["audit-pipeline", at("papers.jsonl"), "-o", at("b"), *common, "--evidence-log", at("e.jsonl"), "--links", at("links.jsonl"),
                     "--claims", at("claims.jsonl"), "--run-dir", at("papers.jsonl")], spark)
    row = spark.read.json(at("b/summary")).first()
    assert code == 1 and (row.overall, row.status, row.policy.strict) == ("FAIL", "blocked", False)
    assert {r.check for r in spark.read.json(at("b/findings")).collect()} >= {"verification_log", "artifact_missing", "chain_gap"}
