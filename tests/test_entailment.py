"""Keywords are what a plain count gives; a review moves keywords, not texts."""

import re
from collections import Counter

from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import audit


def test_keywords_are_what_a_plain_count_gives(spark):
    texts = ["", "the of and", "Beta alpha beta ALPHA gamma", "zeta " * 300 + "alpha beta " * 300 + "gamma", "one-two One-Two abc ab", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    column = X.keywords(F.col("t"), 3)
    got = {r.id: r.k for r in df.select("id", column.alias("k")).collect()}
    for n, t in enumerate(texts):
        found = [w for w in re.findall(r"\b[A-Za-z][A-Za-z\-]{2,}\b", (t or "").lower()) if w not in X.STOPWORDS]
        counts, first = Counter(found), {w: i for i, w in reversed(list(enumerate(found)))}
        assert got[n] == sorted(counts, key=lambda w: (-counts[w], first[w]))[:3]
    assert "array_sort" not in df.select(column)._jdf.queryExecution().analyzed().toString()


def test_review_moves_keywords_and_needed_papers_only(spark):
    body = "graph kernels measure similarity between labelled graphs"
    links = spark.createDataFrame(
        [("C1", "p1", body), ("C1", "p2", ""), ("C1", "p3", None), ("C2", "p2", ""), ("C3", "p9", " "), ("C1", "p1", body), (None, None, "")],
        "claim_id string, paper_id string, evidence_text string")
    claims = spark.createDataFrame([("C1", "graph kernels measure similarity"), ("C2", "graph of unrelated neurons firing together")],
                                   "claim_id string, original_text string").withColumn("normalized_claim", F.lit(""))
    papers = spark.createDataFrame([("p2", body), ("p2", body + " z"), ("p1", "unused"), ("p3", "tiny")], "paper_id string, abstract string").withColumn(
        "evidence_text", F.lit("")).withColumn("doi", F.lit("")).withColumn("title", F.lit("")).withColumn("year", F.lit(1)).withColumn(
        "authors", F.array(F.lit("A")))
    judged = spark.createDataFrame([("C1", "p2", 'so {"verdict": "weak", "reason": "r"}'), ("C2", "p2", "none")], "claim_id string, paper_id string, content string")
    plain = audit.review_links(links, claims, papers)
    rows = lambda df: sorted((str(r.claim_id), str(r.paper_id), r.entailment_verdict, r.review_method) for r in df.collect())
    expected = [("C1", "p1", "PASS", "heuristic"), ("C1", "p1", "PASS", "heuristic"), ("C1", "p2", "PASS", "heuristic"),
                ("C1", "p3", "FAIL", "heuristic"), ("C2", "p2", "WEAK", "heuristic"), ("C3", "p9", "FAIL", "heuristic"), ("None", "None", "FAIL", "heuristic")]
    assert rows(plain) == expected
    assert plain.columns == ["paper_id", "claim_id", "evidence_text", "review_method", "claim_text", "entailment_verdict", "entailment_reason"]
    expected[2] = ("C1", "p2", "WEAK", "llm")
    assert rows(audit.review_links(links, claims, papers, judged)) == expected
    # The evidence of a link is read before any join, so no text is joined.
    plan = audit.review_summary(plain)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[:plan.index("Join LeftOuter")]
    assert "Join LeftSemi" in plan
