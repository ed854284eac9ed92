"""Every catalog query against its SQL on the smallest shared tables."""

import math
from pathlib import Path

import duckdb
import pytest

from veritrail.plans.catalog import CATALOG
from veritrail.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    columns = sorted(frame.columns)
    rows = [tuple(cell(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].itertuples(index=False)]
    return columns, sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert canonical(CATALOG[name](spark, SF).toPandas()) == canonical(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(CATALOG) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert CATALOG[name](spark, SF).count() > 0
