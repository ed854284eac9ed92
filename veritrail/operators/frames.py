"""Counts over ranges of years and places in a distribution, per venue.

Rows are counted by value first, so what a window sees is one row per venue and
value: a venue with a third of all rows is a few thousand counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .keys import running_number


def trailing_counts(rows: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """(keys, value, n, trailing): rows at every value and within the `width`
    values that end with it. Null values are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys).orderBy(value).rangeBetween(1 - width, 0)
    return counts.withColumn("trailing", F.sum("n").over(w))


def percent_ranks(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, percent_rank, cume_dist) of every value among the rows of
    its keys: the share of rows below it (of all but one), and up to it."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto, total = F.sum("n").over(w), F.sum("n").over(W.partitionBy(*keys))
    ranked = counts.withColumn("_upto", upto).withColumn("_total", total)
    return ranked.select(*keys, value, "n", F.when(F.col("_total") > 1, (F.col("_upto") - F.col("n")) / (F.col("_total") - 1)).otherwise(
        F.lit(0.0)).alias("percent_rank"), (F.col("_upto") / F.col("_total")).alias("cume_dist"))


def tiles(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "tile") -> DataFrame:
    """The rows with the number, from 1 to n, of the equal part they fall into
    within their keys; the first parts hold one row more. Rows are numbered by
    ranges, so no key needs one task."""
    numbered = running_number(rows, "_at", order, keys)
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_size"))
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_{k}"))
    base, extra, at = F.expr(f"_size div {n}"), F.col("_size") % n, F.col("_at") - 1
    large = extra * (base + 1)
    tile = F.when(at < large, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - large) / F.greatest(base, F.lit(1)))) + 1
    return numbered.join(sizes, test).withColumn(name, tile.cast("int")).drop("_at", "_size", *[f"_{k}" for k in keys])
