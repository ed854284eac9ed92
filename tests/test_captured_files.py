"""Captured pages in many files, and several in a file."""

import json

from veritrail.sources import captured


def test_many_pages_take_few_partitions(spark, tmp_path):
    pages = [{"query": f"q{p}", "results": [{"id": f"W{p}-{i}"} for i in range(3)]} for p in range(400)]
    for p, page in enumerate(pages[:300]):
        (tmp_path / f"p{p:03d}.json").write_text(json.dumps(page))
    (tmp_path / "rest.json").write_text("\n".join(map(json.dumps, pages[300:])) + "\n")
    df = captured.captured(spark, f"file://{tmp_path}", "openalex", "id STRING")
    assert df.rdd.getNumPartitions() <= (captured.PER_SLOT + 1) * spark.sparkContext.defaultParallelism
    rows = df.collect()
    assert sorted((r.query, r["rank"], r.id) for r in rows) == sorted((f"q{p}", i, f"W{p}-{i}") for p in range(400) for i in range(3))
    assert {r.page for r in rows} == {f"p{p:03d}.json" for p in range(300)} | {f"rest.json:{i}" for i in range(100)}
