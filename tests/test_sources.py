"""Local files and the optional web sources."""

import pytest

from veritrail import schemas
from veritrail.plans import cli
from veritrail.sources import files, mappers


def test_local_papers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep_learning-notes.txt").write_text("x")
    (tmp_path / "skip.bin").write_text("x")
    r = files.scan_local_papers(spark, str(tmp_path)).collect()
    assert [(x.title, x.year, x.source, x.citation_count, x.authors) for x in r] == [("Deep Learning Notes", None, "local_file", 0, [])]
    assert r[0].local_path == str(tmp_path / "sub" / "deep_learning-notes.txt")


def test_web_mappers(spark):
    exa = spark.createDataFrame([("t", "u", "h", (None, None, None, "2019-05-01", "J", None, None, "s", None, None, [("Ann B.", "Lee")]))], schemas.EXA_RESULT)
    r = mappers.map_exa(exa).first()
    assert (r.title, r.year, r.venue_type, r.abstract, r.authors, r.source_layer) == ("t", 2019, "journal", "h", ["Lee, Ann B."], "web")
    rows = [("u1", ("A", ["Ann Lee"], "2010", "V", None, "x")), ("u2", ("B", [], "n/a", None, None, None)), ("u3", ("C", [], "2020", None, None, None))]
    hits = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "rank int, " + schemas.SCHOLAR_RESULT)
    page = mappers.scholar_page(hits, 2, 2015)
    assert [(x.title, x.year) for x in mappers.map_google_scholar(page).collect()] == [("B", None)]


def test_every_command_has_a_parser():
    assert len(cli.COMMANDS) == 18
    for name in cli.COMMANDS:
        required = [x for flag, default in cli.COMMANDS[name][1].items() if default is None for x in (flag, "x")]
        assert cli.parser().parse_args([name, "in", "-o", "out", *required]).command == name


def test_record_forms_and_positions(spark, tmp_path):
    import json
    papers = [{"title": t} for t in ("b", "a", "b")]
    forms = {
        "lines.jsonl": "\n".join(map(json.dumps, papers)) + "\nnot json\n",
        "lines.json": "\n".join(map(json.dumps, papers)),
        "array.json": json.dumps(papers), "pretty.json": json.dumps(papers, indent=2),
        "wrapped.json": json.dumps({"kept": papers}),
        # One paper per line inside an object: the rejected one stays out.
        "split.json": '{"kept":[\n' + ",\n".join(map(json.dumps, papers)) + '\n],"rejected":[\n{"title": "no"}\n]}',
    }
    for name, text in forms.items():
        (tmp_path / name).write_text(text)
        got = files.read_records(spark, str(tmp_path / name), "title STRING, year INT", "kept", "at").orderBy("at").collect()
        assert [(r["title"], r["at"]) for r in got] == [("b", 1), ("a", 2), ("b", 3)], name
    assert files.read_records(spark, str(tmp_path / "none.json"), "title STRING", "kept", "at").count() == 0
    (tmp_path / "same.jsonl").write_text('{"title": "a", "ord": 1}\n{"title": "b", "ord": 1}\n')
    with pytest.raises(ValueError, match="same ord"):
        cli._papers(spark, str(tmp_path / "same.jsonl"))


def test_limits_count_what_passes(spark):
    from veritrail.operators import retrieve
    searches = spark.createDataFrame([("C1", "q", 2)], "claim_id string, query string, budget int")
    hits = [("q", i, f"t{y}", y) for i, y in enumerate((1990, 1991, 2010, 2011, 2012))]
    s2 = spark.createDataFrame(hits, "query string, rank int, title string, year int").selectExpr(
        "*", "'v' venue", "'' abstract", "1L citationCount", "named_struct('DOI', string(null)) externalIds",
        "array(named_struct('name', 'A B')) authors")
    found = retrieve.source_candidates(searches, "semantic_scholar", s2, 0, ["claim_id"], (2000, 2020))
    assert sorted(r["title"] for r in found.collect()) == ["t2010", "t2011"]
    tagged = s2.selectExpr("*", "IF(year = 2011, array('Physics'), array('Law')) fieldsOfStudy")
    found = retrieve.source_candidates(searches, "semantic_scholar", tagged, 0, ["claim_id"], None, ["Law"])
    assert sorted(r["title"] for r in found.collect()) == ["t1990", "t1991"]


def test_gate_cut_loses_no_pair():
    from veritrail.operators import support
    for k in range(1, 51):
        for c in range(k + 1):
            if round(min(1.0, c / k * 0.75 + 0.25), 2) >= 0.6:
                assert c >= support.gate_coverage() * k
