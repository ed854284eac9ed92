"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least member of u's closed neighbourhood. Least by
    aggregation and join: no neighbourhood is ever gathered in one place."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _to_least(down)
    links = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        star.select(F.col("u"), F.col("m").alias("v")))
    return links.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its
    least node. Each round is written to the checkpoint folder, so a lost
    executor repeats one round at most."""
    work = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        work = cut_lineage(_small_star(_large_star(work)))
        now = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    members = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionAll(heads)
