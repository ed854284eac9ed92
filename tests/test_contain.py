"""Fragments in texts and markers of documents, found without meeting pairs."""

import random

import pytest

from veritrail.operators import audit, contain


@pytest.mark.parametrize("pieces", [contain._PIECES, 0])
def test_fragments_are_those_that_some_text_holds(spark, monkeypatch, pieces):
    monkeypatch.setattr(contain, "_PIECES", pieces)
    rng = random.Random(7)
    bodies = ["".join(rng.choice("ab é") for _ in range(n)) for n in (0, 1, 5, 30, 90, 200)] + ["the same start of many titles " + c for c in "abcdef"] + [None]
    whole = [b for b in bodies if b]
    parts = [b[i:i + n] for b in whole for i in (0, 3, 17) for n in (1, 2, 3, 4, 7, 8, 9, 23, 24, 25, 60)]
    parts += [p + "b" for p in parts] + ["the same start of many titles " + c for c in "uvwxyz"] + [""]
    fragments = spark.createDataFrame([(p,) for p in parts], "fragment string")
    texts = spark.createDataFrame([(b,) for b in bodies] * 2, "body string")
    out = contain.contained_fragments(fragments, texts)
    found = [r.fragment for r in out.collect()]
    assert len(found) == len(set(found))
    assert set(found) == {p for p in parts if p and any(p in b for b in whole)}
    # Pairs of a fragment and a text are not tested one by one.
    assert "Contains(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_markers_are_found_once(spark):
    docs = spark.createDataFrame([(1, "x (Lee, 2020) y [1] (Lee, 2020)"), (2, "(Kim, 2001) [1]"), (3, None)], "doc_id int, text string")
    final = spark.createDataFrame([(["Lee, A."], 2020)], "authors array<string>, year int")
    out = audit.marker_findings(docs, final)
    assert sorted(r.detail for r in out.collect()) == sorted(
        f"marker '{m}' not mapped to any final paper" for m in ("[1]", "(Kim, 2001)", "[1]"))
    assert "regexp_extract_all(text" not in out._jdf.queryExecution().optimizedPlan().toString()
