"""Trimming and running sums give what the patterns and a plain loop give."""

from itertools import accumulate

from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import audit, documents


def test_strip_removes_what_the_space_pattern_matches(spark):
    chars = spark.range(1, 0x10000).where("id < 55296 OR id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    inner = F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c")
    old = F.regexp_replace(inner, rf"(?U)^{X.SPACE}+|{X.SPACE}+\z", "")
    assert chars.where(~X.strip(inner).eqNullSafe(old)).count() == 0
    assert "regexp_replace" not in chars.select(X.strip(inner))._jdf.queryExecution().optimizedPlan().toString()


def test_running_sums_make_only_the_moves_they_need(spark):
    rows = [(n, list(range(1, n + 1))) for n in (0, 1, 2, 3, 4, 5, 8, 9, 100, 1025)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, a array<int>")
    got = {r.n: r.s for r in df.select("n", X.running_sums(F.col("a")).alias("s")).collect()}
    assert got == {n: None if a is None else list(accumulate(a)) for n, a in rows}
    assert "pow" not in df.select(X.running_sums(F.col("a")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_match_over_two_lines_has_the_sentence_of_its_first_line(spark):
    df = spark.createDataFrame([(1, "One. Two. Three [1,\n2] four. Five [3]."), (2, "\n\n [4]")], "doc_id int, text string")
    got = documents.span_sections(df)
    assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in got.collect()) == [(1, 0, 2), (1, 1, 1), (2, 2, 0)]
    assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_sentences_of_a_plan_are_found_once_per_document(spark):
    docs = spark.createDataFrame([(1, "\\section{A}\nOne. Two here.  Three.\n\\section{B}\nFour \\cite{k}. \\emph{Five}.")],
                                 "doc_id int, text string")
    plan = spark.createDataFrame([(1, 1, "b", 1, "x"), (1, 2, "A", 2, "y"), (1, 3, "A", 0, "x"), (1, 4, "A", 9, "z"), (1, 5, "A", 0, "k")],
                                 "doc_id int, ord int, section string, sentence_index int, key string")
    changed, report = documents.apply_latex_plan(docs, plan)
    assert [(r.ord, r.status) for r in report.orderBy("ord").collect()] == [
        (1, "inserted"), (2, "inserted"), (3, "skipped_existing"), (4, "skip"), (5, "skipped_existing")]
    assert changed.first().text == "\\section{A}\nOne. Two here.  Three.\n\\cite{y}\\section{B}\nFour \\cite{k}. \\emph{Five}.\\cite{x}"
    assert report._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_a_review_counts_the_words_of_a_text_once(spark):
    df = spark.createDataFrame([("Teachers measure reliability.", "teachers measure reliability of tests in many schools"),
                                ("Teachers measure reliability.", "short")], "claim string, evidence string")
    out = df.select(audit.entailment_verdict(X.keywords(F.col("claim"), 50), X.keywords(F.col("evidence"), 50), F.col("evidence")).alias("v"))
    assert [tuple(r.v) for r in out.collect()] == [("PASS", "heuristic overlap 1.00"), ("FAIL", "no usable evidence text to review")]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2
