import io
import json
import zipfile

from pyspark.sql import functions as F

from veritrail import schemas
from veritrail.operators import audit, documents, evidence, extract, keys, logs, quality, rank, references, report, support, verify
from veritrail.sources import files, mappers
from veritrail.streaming import logs as streams

from test_functions import UTAUT


def test_extraction_offsets_and_numbers(spark):
    text = "\n第一段足够长的中文句子在这里。 The second sentence is long enough.\n\nStudents use many tools every single day but teachers still prefer the classic printed books."
    rows = extract.extract_claims(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("claim_no").collect()
    assert [r.claim_id for r in rows] == ["C001", "C002", "C003", "C004"]
    for r in rows[:2]:
        assert text[r.char_start:r.char_end] == r.original_text
    assert [r.sentence_id for r in rows] == [0, 0, 0, 1] and rows[3].split_from_compound and rows[3].char_start is None
    assert [r.paragraph_id for r in rows] == [1, 1, 3, 3]


def test_verification_scenarios(spark):
    authors = "array<struct<given:string,family:string,name:string>>"
    parts = "struct<`date-parts`:array<array<int>>>"
    work = lambda doi, title, year: (doi, [title], [("Ann", "Smith", None)], ([[year]],), None, None, None)
    crossref = spark.createDataFrame(
        [work("10.1/A", "A good title", 2017), work("10.1/b", "A good title", 2017), work("10.1/c", "Quite another thing", 2017)],
        f"DOI string, title array<string>, author {authors}, issued {parts}, `published-print` {parts}, `published-online` {parts}, published {parts}")
    s2 = spark.createDataFrame([("A good title", 0, "A good title", 2019, [("Ann Smith",)]), ("No doi paper", 0, "No doi paper", 2020, [])],
                               "query_title string, rank int, title string, year int, authors array<struct<name:string>>")
    oa_schema = "doi string, title string, display_name string, publication_year int, authorships array<struct<author:struct<display_name:string>>>"
    oa = spark.createDataFrame([("https://doi.org/10.1/a", "A good title", None, 2017, [(("Ann Smith",),)])], oa_schema)
    oas = spark.createDataFrame([("No doi paper", 0, "No doi paper", None, 2020, [])],
                                oa_schema.replace("doi string", "query_title string, rank int"))
    papers = spark.createDataFrame([
        ("p1", "10.1/a", "A good title", 2017, ["Smith"]), ("p2", "10.1/B", "A good title", 2017, ["Ann Smith"]),
        ("p3", "10.1/c", "A good title", 2018, ["Bo Lee"]), ("p4", "10.9/none", "A good title", 2017, []),
        ("p5", None, "No doi paper", 2020, []), ("p6", None, "Unknown", 2020, [])],
        "id string, doi string, title string, year int, authors array<string>")
    out = verify.verify_papers(papers, crossref, s2, oa, oas).cache()
    got = {r.id: r for r in out.collect()}
    assert {k: r.verification_status for k, r in got.items()} == {
        "p1": "VERIFIED", "p2": "LIKELY_REAL", "p3": "CONFLICT", "p4": "UNVERIFIED", "p5": "LIKELY_REAL", "p6": "UNVERIFIED"}
    assert got["p1"].authors == ["Smith, Ann"]
    reasons = got["p3"].verification_details.conflict_reasons
    assert reasons[0].startswith("title mismatch (0.") and reasons[1:] == [
        "year mismatch (claimed 2018, real 2017)", "first-author mismatch (claimed 'lee', real 'smith')"]
    assert verify.verdict_counts(out).first().asDict() == {"VERIFIED": 1, "LIKELY_REAL": 2, "UNVERIFIED": 2, "CONFLICT": 1}
    empty = verify.refresh_cache(out.limit(0).select(F.col("doi"), F.lit("x").alias("verdict"), F.col("verification_details").alias("details"),
                                                     "authors_backfilled", "authors", F.current_timestamp().alias("cached_at")), out).cache()
    again = verify.verify_with_cache(papers, empty, crossref=crossref.limit(0), s2_search=s2.limit(0), openalex=oa.limit(0), openalex_search=oas.limit(0))
    second = {r.id: (r.verification_status, r.verification_cached) for r in again.collect()}
    assert second["p1"] == ("VERIFIED", True) and second["p3"] == ("CONFLICT", True) and second["p5"] == ("UNVERIFIED", False)


def test_support_golden(spark):
    # A published abstract with its known score.
    title = "Consumer Acceptance and Use of Information Technology: Extending the Unified Theory of Acceptance and Use of Technology1"
    abstract = (
        "This paper extends the unified theory of acceptance and use of technology (UTAUT) to study acceptance and use "
        "of technology in a consumer context. Our proposed UTAUT2 incorporates three constructs into UTAUT: hedonic mot"
        "ivation, price value, and habit. Individual differences—namely, age, gender, and experience—are hypothesized t"
        "o moderate the effects of these constructs on behavioral intention and technology use. Results from a two-stag"
        "e online survey, with technology use data collected four months after the first survey, of 1,512 mobile Intern"
        "et consumers supported our model. Compared to UTAUT, the extensions proposed in UTAUT2 produced a substantial "
        "improvement in the variance explained in behavioral intention (56 percent to 74 percent) and technology use (4"
        "0 percent to 52 percent). The theoretical and managerial implications of these results are discussed.")
    pair = spark.createDataFrame([(UTAUT, title, abstract, "", "ABSTRACT")],
                                 "claim_text string, title string, evidence_text string, abstract string, evidence_level string")
    r = support.score_support(pair).first()
    assert (r.support_score, r.support_level, r.scoring_method) == (0.66, "PARTIAL", "heuristic")


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, ord long, title string, doi string, year int, authors array<string>, venue string, support_score double, "
                                 "support_level string, verification_status string, tier_score double, recency_score double, citation_count long, claim_type string, citation_need string")


def test_gates_and_greedy_choice(spark):
    row = lambda o, score, level, author, venue: ("c", o, f"t{o}", f"10.1/{o}", 2020, [author], venue, score, level, "VERIFIED", 0.5, 0.5, 5, "CURRENT_STATE", "REQUIRED")
    pairs = _pairs(spark, [row(0, .85, "CONTRADICTORY", "a", "v"), row(1, .61, "PARTIAL", "a", "v"), row(2, .70, "PARTIAL", "a", "w"),
                           row(3, .69, "PARTIAL", "a", "x"), row(4, .66, "PARTIAL", "b", "y")])
    selected, rejected = rank.rank_all(pairs, 2026)
    assert [r.ord for r in selected.orderBy("pick").collect()] == [2, 4, 3]
    assert {r.ord: r.reject_reason for r in rejected.collect()} == {0: "blocked_level", 1: "outranked"}


def test_running_number_on_hot_key(spark):
    df = spark.range(2000).select((F.col("id") % 997).alias("o"), "id", F.when(F.col("id") < 1500, "hot").otherwise("b").alias("k"))
    rows = keys.running_number(df, "n", ["o", "id"], ["k"]).collect()
    for k in ("hot", "b"):
        group = sorted((r.o, r.id, r.n) for r in rows if r.k == k)
        assert [g[2] for g in group] == list(range(1, len(group) + 1))


def test_citation_numbers_and_suffixes(spark):
    plan = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "position int, paper_idx int")
    assert {(r.position, r.citation_number) for r in references.citation_numbers(plan).collect()} == {(0, 1), (1, 2), (2, 1)}
    p = spark.createDataFrame([(0, ["Smith, A"], 2020), (1, ["Smith, B"], 2020), (2, ["Lee, C"], 2020)], "ord long, authors array<string>, year int")
    assert [r.suffix for r in references.year_suffixes(p).orderBy("ord").collect()] == ["a", "b", ""]


def test_blacklist_and_tier(spark):
    p = spark.createDataFrame([("Oncotarget", "", None, "journal"), ("x", "MDPI AG", None, "journal"), ("Nature", "", None, "journal"), ("y", "", "1932-6203", "journal"),
                               ("", "", None, "conference")], "venue string, publisher string, issn_l string, venue_type string").withColumn("issn", F.array().cast("array<string>"))
    kept = quality.drop_blacklisted(p, files.read_blacklist(spark))
    assert {r.venue for r in kept.collect()} == {"Nature", ""}
    sources = spark.createDataFrame([(None, "Nature", 0, 40.0)], "issn string, venue string, rank int, citedness double")
    tiers = quality.tier_scores(kept, files.read_conferences(spark), sources)
    assert {r.venue: r.tier for r in tiers.collect()} == {"Nature": 0.95, "": 0.8}


def test_evidence_chain(spark):
    p = spark.createDataFrame([("a", None, "own text", None, None), ("b", "10.1/b", "", None, None), ("c", "10.1/c", None, None, None),
                               ("d", None, "", "http://arxiv.org/abs/1.2", None), ("e", None, "", None, "venue")],
                              "title string, doi string, abstract string, url string, venue string")
    oa = spark.createDataFrame([("10.1/b", {"world": [1], "hello": [0, 2]})], "doi string, abstract_inverted_index map<string,array<int>>")
    s2 = spark.createDataFrame([("10.1/C", " two ")], "doi string, abstract string")
    ax = spark.createDataFrame([("1.2", "<summary>\n a  b </summary>")], "arxiv_id string, response string")
    got = {r.title: (r.evidence_level, r.evidence_source, r.evidence_text) for r in evidence.fetch_evidence(p, oa, s2, ax).collect()}
    assert got == {"a": ("ABSTRACT", "search_result", "own text"), "b": ("ABSTRACT", "openalex", "hello world hello"),
                   "c": ("ABSTRACT", "semantic_scholar", "two"), "d": ("SUMMARY", "arxiv_api", "a b"), "e": ("METADATA_ONLY", "title_metadata", "")}


def test_markers_need_whole_words(spark):
    final = spark.createDataFrame([(["Smith, A"], 2020), (["van der Berg, B"], 2019)], "authors array<string>, year int")
    docs = spark.createDataFrame([("See (Smithson, 2020), (SMITH & Co, 2020), (Van der Berg, 2019) and [3].",)], "text string")
    assert {r.detail for r in audit.marker_findings(docs, final).collect()} == {
        "marker '(Smithson, 2020)' not mapped to any final paper", "marker '[3]' not mapped to any final paper"}


def test_full_audit_row(spark):
    final = spark.createDataFrame([("A title of some length", "10.1/a", ["Smith, A"], 2020, "claim words appear in this evidence text here", "")],
                                  "title string, doi string, authors array<string>, year int, evidence_text string, abstract string")
    pid = audit.with_paper_id(final).first().paper_id
    log = spark.createDataFrame([("verification", pid, "CONFLICT", 1), ("verification", pid, "VERIFIED", 2)], "event string, paper_id string, verdict string, ord int")
    ev = spark.createDataFrame([(pid,)], "paper_id string")
    claims = spark.createDataFrame([("C001", "claim words appear", "")], "claim_id string, original_text string, normalized_claim string")
    links = spark.createDataFrame([("C001", pid, "", 0.9, "DIRECT")], "claim_id string, paper_id string, evidence_text string, support_score double, support_level string")
    refs = spark.createDataFrame([("Smith, A. (2020). A title of some length. https://doi.org/10.1/a",)], "text string")
    docs = spark.createDataFrame([("It holds (Smith, 2020).",)], "text string")
    row = audit.full_audit(docs, final, refs, log, ev, claims, links).first()
    assert row.overall == "PASS" and set(row.gates) == {"8A_bibliographic", "8B_entailment", "chain"}
    assert audit.full_audit(docs, final, refs.limit(0), log.where("ord = 1"), ev.limit(0), claims, links).first().overall == "FAIL"


def test_docx_plan_and_rewrite(spark, tmp_path):
    para = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    xml = ('<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
           + para("First one. Sec", "ond one here.") + para("Known (Lee, 2019).") + "</w:body></w:document>")
    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", xml)
    paras = files.read_docx_paragraphs(spark, str(path)).cache()
    name = paras.first().path
    plan = spark.createDataFrame(
        [(name, 0, 1, "(Smith, 2020)", None, 1), (name, 0, 1, "(Smith, 2020)", None, 2), (name, 1, 0, "(X, 2001)", "flag", 3),
         (name, 1, 0, "(X, 2001)", "supplement", 4), (name, 9, 0, "(X, 2001)", None, 5), (name, 0, 0, "[9]", None, 6)],
        "path string, paragraph_id int, sentence_index int, marker string, existing string, ord int")
    changed, reports = documents.apply_docx_plan(paras, plan)
    assert {r.ord: r.status for r in reports.collect()} == {
        1: "inserted", 2: "skipped_existing", 3: "flag", 4: "supplemented", 5: "skip", 6: "skipped_existing"}
    runs = {r.paragraph_id: r.runs for r in changed.collect()}
    assert runs[0] == ["First one. Sec", "ond one here(Smith, 2020)."] and runs[1] == ["Known (Lee, 2019)(X, 2001)."]
    source = spark.read.format("binaryFile").load(str(path))
    added = spark.createDataFrame([(name, 1, "Smith, A. (2020). T.")], "path string, ord int, entry string")
    content = documents.render_docx(source, changed, added).first().content
    text = zipfile.ZipFile(io.BytesIO(bytes(content))).read("word/document.xml").decode()
    assert "ond one here(Smith, 2020)." in text and "Smith, A. (2020). T." in text


def test_latex_plan(spark):
    tex = "\\begin{document}\n\\section{Intro}\nOne here. Two there.\n\\section{Method} Known \\cite{old}. End.\n\\end{document}"
    docs = spark.createDataFrame([(1, tex)], "doc_id int, text string")
    plan = spark.createDataFrame([(1, 1, "intro", 0, "k1"), (1, 2, "Method", 0, "old"), (1, 3, "none", 1, "k2"), (1, 4, "Method", 9, "k3"), (1, 5, "", 0, ""), (1, 6, "Method", 0, "k1")],
                                 "doc_id int, ord int, section string, sentence_index int, key string")
    changed, reports = documents.apply_latex_plan(docs, plan)
    assert {r.ord: r.status for r in reports.collect()} == {1: "inserted", 2: "skipped_existing", 3: "inserted", 4: "skip", 5: "skip", 6: "skipped_existing"}
    assert "One here.\\cite{k1} Two there.\n\\cite{k2}\\section{Method}" in changed.first().text


def test_support_report(spark, tmp_path):
    rows = [("C1", "claim", 0, "T1", 2020, ["A B"], "V", "10.1/x", "ABSTRACT", "openalex", "text", "", 0.8, "DIRECT", "r", "heuristic"),
            ("C1", "claim", 1, "T2", None, [], None, None, "METADATA_ONLY", None, "", "", 0.74, "PARTIAL", "r [capped: METADATA_ONLY]", "llm"),
            ("C1", "claim", 2, "T3", 2019, [], None, None, "ABSTRACT", None, "neg", "", 0.1, "CONTRADICTORY", "r", "heuristic")]
    df = spark.createDataFrame(rows, "claim_id string, claim_text string, ord int, title string, year int, authors array<string>, venue string, doi string, evidence_level string, "
                               "evidence_source string, evidence_text string, abstract string, support_score double, support_level string, support_reasoning string, scoring_method string")
    lines = report.support_report_lines(df, at=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    text = "\n".join(r.text for r in lines.orderBy("section", "position").collect())
    assert "| 1 | T1 | 2020 | ABSTRACT | 0.80 | DIRECT | ✅ 可引用 |" in text and "- 通过（≥0.60）: **2** 篇" in text
    assert "### 3. T3（2019）" in text and "  - T2 → 0.74 PARTIAL" in text
    report.write_reports(lines, str(tmp_path / "md"))
    parts = sorted((tmp_path / "md" / "claim_id=C1").glob("part-*"))
    assert "".join(p.read_text() for p in parts).rstrip("\n") == text.rstrip("\n")
    assert report.report_buckets(df).first().asDict() == {"claim_id": "C1", "passed": 2, "rejected": 0, "contradictory": 1, "insufficient": 0}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"claim_id":"C1","original_text":"x"}\n\nbroken{\n{"claim_id":"C2","original_text":"y"}\n')
    (tmp_path / "b.json").write_text('[{"claim_id":"C1"},\n{"claim_id":"C2"}]')
    (tmp_path / "c.json").write_text('{"claims":[{"claim_id":"C1"},{"claim_id":"C2"}]}')
    (tmp_path / "d.json").write_text('{"claim_id":"C1"}\n{"claim_id":"C2"}\n')
    for name in ("a.jsonl", "b.json", "c.json", "d.json"):
        assert sorted(r.claim_id for r in files.read_claims(spark, str(tmp_path / name)).collect()) == ["C1", "C2"], name
    assert files.read_claims(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "x.tex").write_text("\\documentclass{a}\n\\begin{document}Some \\textbf{bold} text % note\nand 5\\% more.\\end{document}")
    assert files.read_documents(spark, str(tmp_path / "x.tex")).first().text.split() == ["Some", "text", "and", "5\\%", "more."]
    bib = spark.createDataFrame([("doi = {10.1/A}, DOI={https://doi.org/10.1/b}",)], "value string")
    assert sorted(r.doi for r in files.bib_dois(bib).collect()) == ["10.1/a", "10.1/b"]


def test_mappers(spark):
    crossref = spark.read.schema(schemas.CROSSREF_WORK).json(spark.sparkContext.parallelize([json.dumps({
        "DOI": "10.1/A", "title": ["T"], "container-title": ["J"], "type": "proceedings-article", "author": [{"given": "A", "family": "B"}, {"family": "C"}, {}],
        "published-print": {"date-parts": [[2011, 2]]}, "abstract": "<jats:p> x</jats:p> "})]))
    r = mappers.map_crossref(crossref).first()
    assert (r.doi, r.authors, r.year, r.venue_type, r.abstract, r.url) == ("10.1/a", ["B, A", "C"], 2011, "conference", "x", "https://doi.org/10.1/a")
    pop = spark.createDataFrame([("u", "", [], 1, "s", "p", "", "", None, None, "1", None, 3), ("u", "T", [("Ann Lee",)], 1, "", "p", " 10/x ", "", None, None, "1", "9", 3)],
                                schemas.POP_RECORD)
    rows = mappers.map_publish_or_perish(pop).collect()
    assert len(rows) == 1 and (rows[0].authors, rows[0].venue, rows[0].doi, rows[0].pages, rows[0].citation_count) == (["Lee, Ann"], "p", "10/x", "1-9", 3)


def test_log_stream_keeps_the_last_record(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "latest")
    src.mkdir()
    line = lambda pid, verdict, at: json.dumps({"timestamp": f"2026-01-01T00:00:{at:02d}Z", "event": "verification", "paper_id": pid, "verdict": verdict})
    (src / "1.json").write_text("\n".join([line("p1", "UNVERIFIED", 1), line("p1", "UNVERIFIED", 1), line("p2", "VERIFIED", 1)]))

    def drain():
        stream = streams.read_log_stream(spark, str(src), schemas.VERIFICATION_LOG)
        streams.upsert_latest(stream, out, str(tmp_path / "ck"), available_now=True).awaitTermination(60)
        return {r.paper_id: r.verdict for r in streams.latest_table(spark, out).collect()}

    assert drain() == {"p1": "UNVERIFIED", "p2": "VERIFIED"}
    (src / "2.json").write_text(line("p1", "VERIFIED", 5))
    assert drain() == {"p1": "VERIFIED", "p2": "VERIFIED"}
    stream = streams.distinct_events(streams.read_log_stream(spark, str(src), schemas.VERIFICATION_LOG), ("event", "paper_id", "verdict"))
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 3


def test_bibitems(spark):
    papers = spark.createDataFrame([(1, "T", ["Lee, A"], 2020, "V", "10.1/a", "k1"), (2, "U", ["Lee, A"], 2021, "V", None, "k2")],
                                   "ord int, title string, authors array<string>, year int, venue string, doi string, bibtex_key string")
    tex = spark.createDataFrame([(1, "\\begin{thebibliography}{9}\n\\bibitem{k1} Old\n\\end{thebibliography}")], "doc_id int, text string")
    items = references.bibitems(papers, "ieee", references.bibitem_keys(tex), start=2).withColumn("doc_id", F.lit(1))
    text = references.insert_bibitems(tex, items).first().text
    assert text.count("\\bibitem{k1}") == 1 and '\\bibitem{k2} [3] A. Lee, "U," *V*, 2021.\n\\end{thebibliography}' in text


def test_judgments(spark):
    pairs = spark.createDataFrame([("c", "claim", "T", "10.1/a", 2020, ["A B"], "V", "ABSTRACT", "e", ""), ("c", "claim", "U", "10.1/b", 2020, ["A B"], "V", "METADATA_ONLY", "", "")],
                                  "claim_id string, claim_text string, title string, doi string, year int, authors array<string>, venue string, evidence_level string, evidence_text string, abstract string")
    ids = {r.doi: r.paper_id for r in support.pending_judgments(pairs).collect()}
    judged = spark.createDataFrame([(ids["10.1/a"], 0.3, "", "old", 1), (ids["10.1/a"], 1.7, "direct", "new", 2), (ids["10.1/b"], 0.9, "DIRECT", "b", 3)],
                                   "paper_id string, support_score double, support_level string, reasoning string, ord int")
    got = {r.doi: (r.support_score, r.support_level, r.support_reasoning, r.scoring_method) for r in support.apply_judgments(pairs, judged).collect()}
    assert got["10.1/a"] == (1.0, "DIRECT", "new", "agent_llm")
    assert got["10.1/b"] == (0.74, "PARTIAL", "b [capped: METADATA_ONLY]", "agent_llm")
