"""Registered queries against their SQL, and the shape of the others."""

import math
from pathlib import Path

import duckdb
import pytest

from veritrail.llm.queries import ORACLES, QUERIES

from .conftest import SF

pytestmark = pytest.mark.skipif(not Path(SF).exists() or not Path("/opt/tokenizers").exists(), reason="no shared tables")


def canonical(frame):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    columns = sorted(frame.columns)
    return columns, sorted((tuple(cell(v.item() if hasattr(v, "item") else v) for v in row)
                            for row in frame[columns].itertuples(index=False)), key=repr)


#: The smallest table holds no secrets.
LARGER = {"op10_secret_scan": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con, folder = duckdb.connect(), LARGER.get(name, SF)
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    assert canonical(QUERIES[name](spark, folder).toPandas()) == canonical(con.execute(ORACLES[name]).df())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_toxicity", {"doc_id", "held_out", "score", "predicted"}),
    ("op2_embedding_near_dedup", {"vec_id", "n_links", "component_id", "kept"}),
    ("op4_suffix_dedup", {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}),
    ("op5_pack_sequences", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    ("op6_token_files", {"doc_id", "start", "n_tokens", "ids_crc32"}),
    ("op7_quality_rules", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept"})])
def test_columns(spark, name, columns):
    result = QUERIES[name](spark, SF)
    assert columns <= set(result.columns)
    table = "embeddings" if "vec_id" in columns else "documents"
    if "sequence_id" not in columns:
        assert result.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
