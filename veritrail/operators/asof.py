"""As-of join: every row with the last row of the other side before it.

Both sides are merged in one order and cut into ranges; inside a range the value
in force is a running last value. A range that begins in the middle of a key takes
over what the ranges before it ended with: one row per range, not per key. A hot
key is thus as many tasks as it fills ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_checked, cut_lineage


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str | Column],
              right_order: Sequence[str | Column], values: Sequence[str], inclusive: bool = True) -> DataFrame:
    """All rows of `left` with the `values` of the last row of `right` that has the
    same keys and comes before it (or at the same place, if `inclusive`).

    The orders are columns of equal types. Of right rows at one place, the one
    with the greatest values counts. Null keys are a key; null places come first.
    Values are null where nothing came before."""
    columns = [c for c in left.columns]
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])

    def placed(df: DataFrame, order: Sequence[str | Column], tag: int) -> DataFrame:
        at = F.struct(*[(o if isinstance(o, Column) else F.col(f"`{o}`")).alias(f"o{i}") for i, o in enumerate(order)])
        payload = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
        value = F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
        return df.select(key.alias("k"), at.alias("at"), F.lit(tag).alias("tag"),
                         *([payload.alias("row")] if df is left else [value.alias("value")]))

    # Inclusive: right rows stand before left ones of the same place.
    both = placed(left, left_order, 1 if inclusive else 0).unionByName(
        placed(right, right_order, 0 if inclusive else 1), allowMissingColumns=True)
    sort = ["k", "at", "tag", "value"]
    # The number spreads equal left rows over ranges.
    both = both.withColumn("n", F.monotonically_increasing_id())
    merged = cut_lineage(both.repartitionByRange(*sort, "n").sortWithinPartitions(*sort, "n").drop("n")
                         .withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)))
    behind = broadcast_checked(_carried(merged))
    local = F.last("value", ignorenulls=True).over(
        W.partitionBy("p", "k").orderBy("m").rowsBetween(W.unboundedPreceding, 0))
    out = merged.withColumn("_local", local).where(F.col("row").isNotNull()).join(behind, "p", "left")
    found = F.coalesce("_local", F.when(F.col("k").eqNullSafe(F.col("carry_k")), F.col("carry")))
    return out.withColumn("_v", found).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)],
                                              *[F.col(f"_v.v{i}").alias(v) for i, v in enumerate(values)])


def _carried(merged: DataFrame) -> DataFrame:
    """(p, carry_k, carry): the last value in the ranges before each range. It
    holds in p only for the key it belongs to, which can be p's first one."""
    ends = merged.where(F.col("value").isNotNull()).groupBy("p").agg(F.max_by(F.struct("k", "value"), "m").alias("end"))
    # A range without any value still has to take over from those before it.
    whole = merged.select("p").distinct().join(ends, "p", "left")
    before = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    return whole.withColumn("end", F.last("end", ignorenulls=True).over(before)).select(
        "p", F.col("end.k").alias("carry_k"), F.col("end.value").alias("carry"))
