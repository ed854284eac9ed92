"""Tables with a row per key, in hash buckets of the key.

A version of a table is a manifest that names, for every bucket, the folder that
holds it. A merge reads and writes the buckets its keys fall into and leaves the
others where they are, so what it costs follows from the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .keys import last_per_key

#: Buckets of a new table.
BUCKETS = 64


def _versions(spark: SparkSession, target: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    marker = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest/{n}/_SUCCESS")
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(marker(n)))


def _manifest(spark: SparkSession, target: str, version: int) -> dict[int, int]:
    """bucket -> version whose folder holds it; a row per bucket."""
    rows = spark.read.schema("bucket INT, version BIGINT").json(f"{target}/manifest/v={version}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _read_buckets(spark: SparkSession, target: str, parts: dict[int, int], schema) -> DataFrame:
    paths = [f"{target}/data/v={v}/bucket={b}" for b, v in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_table(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The newest complete version of a table (or the one asked for)."""
    versions = _versions(spark, target)
    if not versions:
        raise FileNotFoundError(f"no table at {target}")
    parts = _manifest(spark, target, versions[-1] if version is None else version)
    parts.pop(-1, None)
    paths = [f"{target}/data/v={v}/bucket={b}" for b, v in sorted(parts.items())]
    return spark.read.parquet(*paths)


def upsert(rows: DataFrame, target: str, keys: Sequence[str], order: Sequence[str], version: int | None = None,
           buckets: int = BUCKETS) -> int:
    """Merges rows into the table: the last row per key stays. Only the buckets
    that the rows' keys fall into are read and written; a manifest, complete when
    its success mark is there, names the version of every bucket. The same
    version again gives the same table, since it starts from those before it.
    Returns the version. The number of buckets is that of the table's first
    version; `order` decides between versions too, equal places go to the newer."""
    spark = rows.sparkSession
    older = [v for v in _versions(spark, target) if version is None or v < version]
    version = version if version is not None else (older[-1] + 1 if older else 0)
    parts = _manifest(spark, target, older[-1]) if older else {}
    buckets = parts.pop(-1, buckets)
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")
    fresh = cut_lineage(rows.withColumn("_batch", F.lit(version).cast("bigint")).withColumn("bucket", bucket))
    hit = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most `buckets` numbers
    if not hit and older:
        return older[-1]
    held = _read_buckets(spark, target, {b: v for b, v in parts.items() if b in hit}, fresh.drop("bucket").schema)
    both = held.withColumn("bucket", bucket).unionByName(fresh)
    last = last_per_key(both, ["bucket", *keys], [*order, "_batch"])
    last.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/v={version}")
    parts.update(dict.fromkeys(hit, version))
    listed = [(b, v) for b, v in sorted(parts.items())] + [(-1, buckets)]
    spark.createDataFrame(listed, "bucket INT, version BIGINT").coalesce(1).write.mode("overwrite").json(
        f"{target}/manifest/v={version}")
    return version
