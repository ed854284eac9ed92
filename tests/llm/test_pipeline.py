"""The pipeline's stages, each against a plain version on its own input."""

from pathlib import Path

import pytest

import corpus_pipeline
from veritrail.llm import mixing

from . import brute
from .conftest import SF, pairs

pytestmark = pytest.mark.skipif(not Path(SF).exists() or not Path("/opt/tokenizers").exists(), reason="no shared tables")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, all_docs):
    docs = all_docs
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    good = [r for r in docs.collect() if not brute.quality(r["text"])["base_failed"]]
    left = rows(kept)
    assert set(left) <= {tuple(r) for r in good} and len(left) > 0.7 * len(good)

    lines = corpus_pipeline.drop_lines(spark, kept, SF).cache()
    want = sorted([(i, d) for i, _, _, d in brute.line_dedup(pairs(kept))], key=repr)
    assert sorted([(i, brute.sha(t or "")) for i, t in pairs(lines)], key=repr) == want
    assert lines.where("n_chars <> length(text)").count() == 0

    single = corpus_pipeline.near_duplicates(spark, lines, SF).cache()
    classes = brute.ngram(pairs(lines), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert sorted(i for i, _ in pairs(single)) == sorted({c for i, _, c in classes if i == c})

    mixed = corpus_pipeline.mix_sources(spark, single, SF).cache()
    copies = {r["_row"]["doc_id"]: r["copies"] for r in mixing.plan(single).collect()}
    count = {}
    for i, _ in pairs(mixed):
        count[i] = count.get(i, 0) + 1
    assert count == {i: c for i, c in copies.items() if c}
    for stage in (kept, lines, single, mixed):
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes

    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    tokens, windows = {}, {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        windows[r["sequence_id"]] = windows.get(r["sequence_id"], 0) + r["length"]
    size = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert tokens == {i: size[i] * count[i] for i in count} and max(windows.values()) <= 2048
    for df in (kept, lines, single, mixed):
        df.unpersist()


def test_run_and_empty(spark, all_docs):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = all_docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_copies_are_of_five_words(spark, all_docs):
    words = [f"w{i}" for i in range(95)]
    copy = ["other" if i in (30, 60) else w for i, w in enumerate(words)]  # five words 0.80, four words 0.84
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, "another text altogether")]
    near = spark.createDataFrame(rows, "doc_id long, text string")
    assert [len({c for _, _, c in brute.ngram(rows, *k)}) for k in ((4, 85), (5, 80))] == [3, 2]
    assert sorted(i for i, _ in pairs(corpus_pipeline.near_duplicates(spark, near, SF))) == [1, 3]
    got = corpus_pipeline.near_duplicates(spark, all_docs, SF)
    want = brute.ngram(pairs(all_docs), 5, 80)
    assert sorted((i for i, _ in pairs(got)), key=repr) == sorted((i for i, _, c in want if i == c), key=repr)
