"""Append-only event logs and other sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.files import read_bib_dois, read_jsonl
from .keys import last_per_key


def utc_stamp(at: Column | None = None) -> Column:
    return F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def append_log(rows: DataFrame, path: str) -> None:
    """Append JSON lines; keys are written in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def write_claims(claims: DataFrame, path: str) -> None:
    """Replace the claim table, so a second run leaves no duplicates."""
    claims.write.mode("overwrite").json(path)


def write_by_claim(rows: DataFrame, path: str, key: str = "claim_id") -> None:
    """One folder per claim. The salt spreads a hot claim over several files."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("paper_id", "query")] or [key]), F.lit(16)))
    spread.repartition(key, "_salt").drop("_salt").write.mode("overwrite").partitionBy(key).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Small reports as JSON, one object per row."""
    report.write.mode("overwrite").json(path)


def latest_verdicts(log: DataFrame, order: str = "ord") -> DataFrame:
    """Most recent verification record of every paper."""
    rows = log.where((F.col("event") == "verification") & F.col("paper_id").isNotNull()
                     & (F.col("paper_id") != ""))
    return last_per_key(rows, ["paper_id"], [order])


def read_verification_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with `ord`: time stamp, then position in the file."""
    log = read_jsonl(spark, path, schemas.VERIFICATION_LOG)
    return log.withColumn("ord", F.struct("timestamp", F.monotonically_increasing_id().alias("line")))


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def count_cube(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Counts of every combination of the columns with all partial and grand
    totals, in one pass. `level` has a bit per column, the first one highest: 1
    where the column is totalled, so a total is told from a null value."""
    return df.cube(*columns).agg(F.count(F.lit(1)).alias(name), F.grouping_id(*columns).alias("level"))


def append_bibtex(papers: DataFrame, entries: DataFrame, path: str) -> None:
    """Append entries (doi, entry) whose DOI the .bib folder does not hold yet."""
    known = read_bib_dois(papers.sparkSession, path)
    (entries.join(known, "doi", "left_anti").select(F.concat("entry", F.lit("\n")).alias("value"))
     .write.mode("append").text(path))
