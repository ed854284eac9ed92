"""Searches with the verifications that follow within an hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import overlap_join

WITHIN_SECONDS = 3600


def followed_within(found: DataFrame, checked: DataFrame, keys: Sequence[str] = ("paper_id",),
                    found_time: str = "found_at", checked_time: str = "checked_at",
                    seconds: int = WITHIN_SECONDS, delays: tuple[str, str] | None = None) -> DataFrame:
    """Every row of `found` with each row of `checked` of the same keys that comes
    at its time or up to `seconds` later; without any, once with nulls.

    With `delays` (how late rows of either side may come) both sides are streams:
    each side is kept only as long as the other may still bring a partner, and
    unmatched rows come out when that time has passed. Without, both are tables
    and meet by (keys, hour), so a hot paper is spread over its hours. Other
    columns need different names on both sides."""
    if delays is None:
        def at(column: str):
            return F.unix_micros(F.col(column).cast("timestamp"))
        return overlap_join(found, checked, keys, (at(found_time), at(found_time) + seconds * 1_000_000),
                            (at(checked_time), at(checked_time)), seconds * 1_000_000, how="left", closed=True)
    left = found.withWatermark(found_time, delays[0]).alias("l")
    renamed = checked
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_{k}")
    right = renamed.withWatermark(checked_time, delays[1]).alias("r")
    test = (F.col(checked_time) >= F.col(found_time)) & (
        F.col(checked_time) <= F.col(found_time) + F.expr(f"INTERVAL {seconds} SECONDS"))
    for k in keys:
        test = test & (F.col(f"l.{k}") == F.col(f"r._{k}"))
    return left.join(right, test, "left").drop(*[f"_{k}" for k in keys])
