"""Log folders as streams: deduplicated events and a last-write-wins table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import BUCKETS, latest_table, upsert

__all__ = ["distinct_events", "latest_table", "read_log_stream", "upsert_latest"]


def read_log_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """JSON log files as they arrive; `event_time` is the parsed time stamp."""
    reader = spark.readStream.schema(schema).option("mode", "DROPMALFORMED")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("event_time", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def distinct_events(stream: DataFrame, keys: Sequence[str] = ("event", "paper_id"),
                    delay: str = "1 day") -> DataFrame:
    """A stage that runs again appends the same rows again; within the delay
    only the first of them passes. State is bounded by the watermark."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("paper_id",),
                  order: Sequence[str] = ("timestamp",), available_now: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last record per key of a stream in a table. A micro-batch is a
    version of its own number, so one that is repeated after a failure writes the
    same again, and what it writes follows from its size, not from the table's."""

    def merge(batch: DataFrame, number: int) -> None:
        upsert(batch, target, keys, order, version=number, buckets=buckets)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
