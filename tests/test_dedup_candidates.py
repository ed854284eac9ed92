"""Titles that share common pieces only are no candidates."""

import random

from pyspark.sql import functions as F

from veritrail.operators import dedup


def test_common_pieces_make_no_candidates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(6))
    titles = sorted({f"the station {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(400)})
    near = [t[:-1] + ("x" if t[-1] != "x" else "y") for t in titles[:20]] + ["学习" * 150 + "甲", "学习" * 150 + "乙"]
    rows = [(f"n{i:03d}", t, "smith", True, len(t)) for i, t in enumerate(titles + near)]
    nodes = spark.createDataFrame(rows, "node string, title string, last string, open boolean, n int").withColumn(
        "id", F.substring("node", 2, 9).cast("bigint"))
    assert dedup.title_candidates(nodes).count() < 4_000  # of 89,000 pairs
    found = {(r.a, r.b) for r in dedup.similar_titles(nodes.drop("id")).collect()}
    ordered = {frozenset(p) for p in found}
    assert {frozenset((f"n{i:03d}", f"n{len(titles) + i:03d}")) for i in range(20)} <= ordered
    assert frozenset((f"n{len(rows) - 2:03d}", f"n{len(rows) - 1:03d}")) in ordered
