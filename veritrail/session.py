"""Session settings the operators rely on, and the shared-folder checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Broadcast only below this many rows and bytes; above it joins shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "veritrail", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings above. Master and parallelism stay with
    spark-submit unless they are given (tests and the bench give them)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; a larger side is returned
    as it is, so the join falls back to Spark's shuffle joins. The check reads at
    most max_rows + 1 rows of the (expected small) side; their texts and arrays
    are counted as they are written out."""
    wide = [c for c, kind in df.dtypes if kind.startswith(("string", "binary", "array", "map", "struct"))]
    size = F.lit(8 * len(df.columns))
    if wide:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide]))), F.lit(0))
    rows, held = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size.cast("bigint"))).first()
    return F.broadcast(df) if rows <= max_rows and (held or 0) <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than the cluster has slots, so
    that per-row work uses all of them. Large inputs already have more
    partitions than that and are returned as they are, without a shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names. One is chosen here only in a single process
    (local tests); a cluster without one is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veritrail-ckpt-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name that all executors share."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
