"""Small relational helpers that stay parallel on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order. An aggregate, so copies
    of a hot key already combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
            .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last write wins: the last row of every key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
            .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]))


def running_number(df: DataFrame, name: str, order: Sequence[str | Column],
                   keys: Sequence[str] = ()) -> DataFrame:
    """1, 2, 3, ... per key (or over everything) without putting a key into one
    task: rows are range partitioned by (key, order), numbered inside each
    range, and shifted by the counts of the ranges before it. The ranges are
    written once, so numbering and counting see the same ones."""
    ranked = df.withColumn("_o", F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order]))
    ranges = cut_lineage(ranked.repartitionByRange(*keys, "_o").withColumn("_p", F.spark_partition_id()))
    part = ["_p", *keys]
    counts = ranges.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*part, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(W.partitionBy(*part).orderBy("_o"))
    null_safe = None
    for c in part:
        test = F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
        null_safe = test if null_safe is None else null_safe & test
    return (ranges.withColumn("_n", local).alias("r").join(shift.alias("s"), null_safe)
            .select("r.*", (F.col("_n") + F.col("_shift")).cast("bigint").alias(name))
            .drop("_o", "_p", "_n"))
