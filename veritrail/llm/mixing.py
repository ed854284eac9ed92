"""Mixing of sources to target weights.

Words are counted and summed per source; the targets follow from the weights,
and a document is emitted floor(target / source size) times plus once more when
its seeded hash falls below the fraction. DataFrame operations only.

Defined cases: a null text counts 0 words; a null source is a source of its own,
after all others; a source without words has target 0 and none of its documents
are emitted; rows with equal ids draw alike; an empty table gives an empty mix.
Other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source. Sharing by weight
    with a ceiling has one solution: target = least(weight * level, ceiling).
    With the sources in order of ceiling / weight, the level at which exactly
    those before a source are at their ceiling is a running sum; the level is
    that of the first source that stays below its ceiling."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (
        (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ceiling = F.col("source_size") * F.lit(float(most))
    order = W.orderBy(ceiling / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    levels = weighted.withColumn("level", (total - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0)))
                                 / F.sum("w").over(rest)).withColumn("free", F.col("level") * F.col("w") < ceiling)
    first_free = F.min(F.when(F.col("free"), F.struct((ceiling / F.col("w")).alias("at"), F.col("level"))))
    level = first_free.over(W.partitionBy())["level"]
    return levels.withColumn("lv", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("lv") * F.col("w"), ceiling), ceiling).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from a hash of the seed and the key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """All rows of `docs` as a struct `_row`, with size, source_size, target and
    the number of copies to emit. One pass sums the sources (a row per source
    and task is shuffled), one assigns; texts are not shuffled while the source
    table is small enough to broadcast."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{source}`").alias("_source"), words(F.col(f"`{text}`")).alias("size"))
    sums = docs.select(F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"))
    targets = source_targets(stored(sums.groupBy("source").agg(F.sum("size").alias("source_size"))),
                             weights, share, most)
    targets = broadcast_checked(stored(targets.withColumnRenamed("source", "_name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate"))
    copies = whole + (draw(F.col(f"_row.`{doc_id}`"), seed) < F.col("rate") - whole).cast("bigint")
    return (rows.join(targets, F.col("_source").eqNullSafe(F.col("_name")))
            .withColumn("rate", F.least(rate, F.lit(float(most))))
            .select("_row", "size", "source_size", "target", copies.alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is emitted, columns unchanged."""
    copies = plan(docs, **options).where("copies > 0")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
