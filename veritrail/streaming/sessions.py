"""Sessions of log events: runs of one user's events without a long gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

GAP = "30 minutes"


def sessions(events: DataFrame, keys: Sequence[str] = ("user_id",), time: str = "event_time", gap: str = GAP,
             delay: str | None = None) -> DataFrame:
    """(keys, session_start, session_end, n, first_event, last_event) per session;
    it ends a gap after its last event. An event less than a gap after the one
    before belongs to the same session.

    On a stream, `delay` is how late an event may come: a session is given out,
    and its state dropped, once the watermark has passed its end; later rows are
    dropped and counted (see `late_rows`). The batch form needs none."""
    rows = events.withWatermark(time, delay) if delay else events
    return rows.groupBy(*keys, F.session_window(F.col(time), gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_event"), F.max(time).alias("last_event")).select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "first_event", "last_event")


def write_sessions(events: DataFrame, target: str, checkpoint: str, delay: str, available_now: bool = False,
                   **options) -> StreamingQuery:
    """Appends every finished session to the table at `target` once. A query that
    starts again goes on from its checkpoint."""
    writer = (sessions(events, delay=delay, **options).writeStream.outputMode("append").format("parquet")
              .option("checkpointLocation", checkpoint).option("path", target))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the batches that
    the query still reports."""
    return sum(int(state.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress
               for state in progress["stateOperators"])
