"""Titles meet in cells and leave them only if they are similar; groups of
connected titles are replayed, and large ones resolved in rounds, alike."""

import random

from pyspark.sql import functions as F

from test_dedup import changing_records, frame, in_order
from veritrail.functions.text import indel_ratio, lcs_length
from veritrail.operators import dedup, titles


def test_few_candidates_of_common_syllables(spark):
    """The titles share characters and pieces, so counts alone leave thousands."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(2))
    made = sorted({" ".join(word() for _ in range(9)) for _ in range(600)})
    rows = [(i, t, "", True, len(t)) for i, t in enumerate(made)]
    nodes = spark.createDataFrame(rows, "id bigint, title string, last string, open boolean, n int")
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1:] if indel_ratio(a[1], b[1]) >= 0.9}
    for size in (20_000, 150):
        got = [(r.a, r.b) for r in dedup.title_candidates(nodes, (), size).collect()]
        assert len(got) == len(set(got)) < 100 and want <= set(got)


def test_common_subsequence_of_many_pairs():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c学é") for _ in range(rng.choice([1, 5, 63, 64, 65, 128, 200]))) for _ in range(60)]
    held = titles._Titles(texts)
    pairs = titles.np.array([(i, j) for i in range(60) for j in range(60)]).T
    assert titles._lcs(held, *pairs).tolist() == [lcs_length(texts[i], texts[j]) for i, j in pairs.T]


def test_groups_are_replayed(spark, monkeypatch):
    """No rounds for groups of ordinary size; the same result as in rounds."""
    rows = changing_records(7, 24)
    papers = frame(spark, rows)
    shape = lambda out: sorted((r.ord, r.merged_from, r.title, r.year, r.source) for r in out.collect())
    with monkeypatch.context() as m:
        m.setattr(dedup, "GROUP_WORK", 100)
        assert shape(dedup.deduplicate(papers)) == in_order(rows)
    def refuse(*_):
        raise AssertionError("resolved in rounds")
    monkeypatch.setattr(dedup, "resolve_first_match", refuse)
    assert shape(dedup.deduplicate(papers)) == in_order(rows)


def test_records_of_one_position(spark):
    """Records at one position do not see each other, whichever way they are resolved."""
    near = spark.createDataFrame([("t", "t"), ("t", "u"), ("u", "t"), ("u", "u")], "mine string, theirs string")
    rows = spark.createDataFrame(
        [("a", 1, "t", 2000), ("b", 1, "u", 2001), ("c", 2, "u", 2000), ("d", None, "t", 2000), ("e", None, "t", 0)],
        "row_key string, at int, tkey string, year int").select(
        "row_key", F.struct(F.lit(1).alias("tier"), "at").alias("pos"), "tkey", F.lit("x").alias("last"), "year", F.lit(1).alias("year_quality"),
        F.lit(1).alias("authors_quality"), F.lit("exa").alias("source"), F.array().cast("array<string>").alias("source_apis"), F.lit(False).alias("has_doi"))
    found = [{tuple(r)[:2] for r in way(rows, near).collect()} for way in (dedup._in_groups, dedup.resolve_first_match)]
    assert found[0] == found[1] == {("d", "d"), ("a", "d"), ("b", "d"), ("c", "d")}
