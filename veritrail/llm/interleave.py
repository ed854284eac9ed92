"""Sharding by proportional stratified interleaving. DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; the fractional
rank (rank - 1/2) / source size spreads every source evenly over [0, 1), so
cutting the rows in that order at equal counts gives shards that all hold the
sources in the proportions of the whole. Counts of two shards differ by at most
one, and a shard's share of a source by less than two rows.

Both orders come from range partitions that are numbered each for itself and
shifted by the counts before them, so a source that holds a third of all rows is
spread over tasks like the others. Sorting moves no texts unless they are to be
carried along (`carry`).

Defined cases: a null text has no bytes, a null source is a source of its own
(first among ties), a null doc_id draws as the empty string; rows with equal ids
and equal texts are interchangeable; with fewer rows than shards some shards are
empty; an empty table gives no rows. Other columns, clashing names included, stay
out of the way and are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_checked
from .common import stored

SHARDS = 24
SEED = "shard-1"
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: This method cuts at equal counts.
LAW = "rows"


def numbered(df: DataFrame, name: str, order: list[Column], key: str | None = None) -> DataFrame:
    """1, 2, 3, ... in the given order, over all rows or within each key. Sorted
    ranges are written once with running ids, whose upper bits are the range; one
    row per range and key then shifts them. No row moves after the range sort."""
    sorting = F.struct(*([F.col(key).alias("k")] if key else []), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranged = df.withColumn("_o", sorting).repartitionByRange("_o").sortWithinPartitions("_o")
    ranges = stored(ranged.drop("_o").withColumn("_m", F.monotonically_increasing_id())).withColumn(
        "_p", F.shiftright("_m", 33))
    keys = [F.col(key).alias("_k")] if key else []
    counts = ranges.groupBy(F.col("_p").alias("_q"), *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    before = (W.partitionBy("_k") if key else W.partitionBy()).orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.withColumn("_shift", F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first"))
    same = F.col("_p") == F.col("_q")
    if key:
        same = same & F.col(key).eqNullSafe(F.col("_k"))
    return (ranges.join(broadcast_checked(shift), same)
            .withColumn(name, (F.col("_m") + F.col("_shift") + 1).cast("bigint"))
            .drop("_m", "_p", "_q", "_k", "_c", "_first", "_shift"))


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           seed: str = SEED, carry: bool = False) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row, and with
    `carry` the row itself as struct `_row`."""
    body = F.col(f"`{text}`")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"), draw.alias("draw"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []))
    own = [F.col(c) for c in ("draw", "doc_id", "text_crc32", "size")]
    ranked = numbered(rows, "rank", own, key="source")
    sizes = stored(rows.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("total", F.sum("n").over(W.partitionBy())))
    ranked = ranked.join(broadcast_checked(sizes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("share", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("n")).cast("double"))
    placed = numbered(ranked, "place", [F.col("share"), F.col("source"), F.col("rank")])
    cut = placed.withColumn("shard", F.expr(f"cast((place - 1) * {shards} div total as int)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return cut.withColumn("slot", (F.col("place") - 1 - first).cast("bigint")).drop(
        "draw", "rank", "n", "share", "place", "total")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, **options) -> DataFrame:
    """Writes the rows to one folder per shard, in the order of their slots, and
    returns the number of rows and bytes of every shard. Columns are those of
    docs; a shard is written by several tasks, each a run of slots."""
    placed = stored(assign(docs, shards, carry=True, **options))
    out = placed.select(*[F.col(f"_row.`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)],
                        F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    out = out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot")
    name = "shard_no"
    while name in docs.columns:
        name += "_"
    out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("_shard").alias(name)).write.partitionBy(
        name).parquet(folder)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def digests(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The columns of the query; grown_shard is null because equal counts cannot
    hold when a shard is added without moving rows among the others."""
    return assign(docs, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
