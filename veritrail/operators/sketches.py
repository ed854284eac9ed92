"""Mergeable sketches kept by day: distinct papers and score quantiles.

One row per key and day holds a HyperLogLog and a quantile sketch as binary
columns. They are stored like any table and merged on reading, so a report over
months reads days, not rows, and a day that is written again replaces its own rows
only. Sketches combine before the shuffle; a hot key is one sketch per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the buckets of a distinct count: its standard error is about 1.04 / sqrt(2**12).
LG_BUCKETS = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG_BUCKETS / 2)
#: Size parameter of the quantile sketch and the rank error that goes with it (99 %).
QUANTILE_K = 400
RANK_ERROR = 0.008


def daily(rows: DataFrame, keys: Sequence[str], day: Column, item: Column, score: Column) -> DataFrame:
    """(keys, day, papers, scores, n): sketches of the distinct items and of the
    scores of every key and day. Null items and scores count nowhere."""
    return rows.withColumn("day", day).groupBy(*keys, "day").agg(
        F.hll_sketch_agg(item.cast("string"), F.lit(LG_BUCKETS)).alias("papers"),
        F.kll_sketch_agg_double(score.cast("double"), F.lit(QUANTILE_K)).alias("scores"), F.count(F.lit(1)).alias("n"))


def store(sketches: DataFrame, path: str) -> None:
    """Replaces the days that `sketches` holds, and no others."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Stored sketches of the days asked for; other days are not read."""
    rows = spark.read.parquet(path)
    if first_day:
        rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
    return rows.where(F.col("day") <= F.lit(last_day).cast("date")) if last_day else rows


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several days as one per key; merging in parts is the same."""
    return sketches.groupBy(*keys).agg(
        F.hll_union_agg("papers").alias("papers"), F.kll_merge_agg_double("scores").alias("scores"), F.sum("n").alias("n"))


def report(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys, n, distinct, quantiles): the estimates of merged sketches."""
    return sketches.select(
        *keys, "n", F.hll_sketch_estimate("papers").alias("distinct"),
        F.kll_sketch_get_quantile_double("scores", F.array(*map(F.lit, quantiles))).alias("quantiles"))
