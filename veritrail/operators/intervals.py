"""Joins on overlapping ranges: spans in sections, events within an hour.

Both sides are cut into bins of one width along the axis and meet by (keys, bin),
an equi-join; the exact test follows. A pair that shares several bins is kept in
the first of them only, so nothing has to be made distinct. The bins also split a
hot key: what meets in one task is what lies in one bin. A range gives as many
rows as bins it touches, so the width should be near that of the shorter side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _bin(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(width)).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[Column, Column],
                 right_range: tuple[Column, Column], width: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Pairs of rows with equal keys and overlapping ranges.

    Ranges are numbers from (included) to (excluded, or included if `closed`); an
    empty or null one overlaps with nothing. Of the right side, columns besides
    the keys are kept; names must differ from the left ones. `how` is inner or
    left; a left row without a partner then stays once."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    def binned(df: DataFrame, at: tuple[Column, Column], side: str) -> DataFrame:
        begin, end = at
        rows = df.withColumn(f"_{side}0", begin).withColumn(f"_{side}1", end)
        valid = F.col(f"_{side}0") <= F.col(f"_{side}1") if closed else F.col(f"_{side}0") < F.col(f"_{side}1")
        first = _bin(F.col(f"_{side}0"), width)
        bins = F.sequence(first, _bin(F.col(f"_{side}1"), width))
        return rows.where(valid).withColumn(f"_{side}b", first).withColumn("_bin", F.explode(bins))

    # Row numbers are used twice and must not change in between.
    mine = cut_lineage(left.withColumn("_row", F.monotonically_increasing_id())) if how == "left" else left
    meets = F.col("_l0") < F.col("_r1"), F.col("_r0") < F.col("_l1")
    if closed:
        meets = F.col("_l0") <= F.col("_r1"), F.col("_r0") <= F.col("_l1")
    met = (binned(mine, left_range, "l").join(binned(right, right_range, "r"), [*keys, "_bin"])
           .where((F.col("_bin") == F.greatest("_lb", "_rb")) & meets[0] & meets[1])
           .drop("_bin", "_lb", "_rb", "_l0", "_l1", "_r0", "_r1"))
    if how == "inner":
        return met
    alone = mine.join(met.select("_row"), "_row", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True).drop("_row")
