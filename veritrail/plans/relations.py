"""Queries on joins, windows, totals, sketches and versions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof, documents, extract, frames, logs, sketches, tables
from ..session import broadcast_checked, cut_lineage, shared_folder
from ..sources import captured
from ..streaming import joins, sessions
from . import bridge as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def events(spark, sf):
    return B.table(spark, sf, "events")


# --- joins ----------------------------------------------------------------------------

def cited_documents(spark, sf):
    """Documents that cite behind every full stop."""
    marker = F.concat(F.lit(" ["), (F.col("doc_id") % 97).cast("string"), F.lit("]. "))
    return B.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), marker).alias("text"))


@query
def span_sections(spark, sf):
    """Paragraph and sentence of every numbered citation."""
    return documents.span_sections(cited_documents(spark, sf))


@query
def verdict_as_of(spark, sf):
    """Of every log entry, the verdict of its paper that was in force before it."""
    log = events(spark, sf)
    verdicts = log.where("event_type <> 'error'").select(
        "user_id", "ts", F.col("event_id").alias("verdict_event"), F.col("event_type").alias("verdict"), F.col("value").alias("verdict_value"))
    out = asof.asof_join(log.select("event_id", "user_id", "ts"), verdicts, ["user_id"], ["ts", "event_id"], ["ts", "verdict_event"],
                         ["verdict", "verdict_value", "verdict_event"], inclusive=False)
    return out.select("event_id", "user_id", F.coalesce("verdict", F.lit("")).alias("verdict"),
                      F.coalesce("verdict_value", F.lit(-1.0)).alias("verdict_value"),
                      F.coalesce("verdict_event", F.lit(-1)).cast("bigint").alias("verdict_event"))


@query
def searches_verified(spark, sf):
    """Views as search results, purchases of the same user as verifications within
    a day; a result that none follows stays once."""
    log = events(spark, sf)
    found = log.where("event_type = 'view'").select("user_id", F.col("event_id").alias("found_id"), F.col("ts").alias("found_at"))
    checked = log.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("checked_id"), F.col("ts").alias("checked_at"))
    out = joins.followed_within(found, checked, ["user_id"], seconds=86_400)
    return out.select("user_id", "found_id", F.coalesce("checked_id", F.lit(-1)).cast("bigint").alias("checked_id"))


# --- windows and totals -----------------------------------------------------------------

@query
def log_sessions(spark, sf):
    """Runs of a user's events with gaps under six hours."""
    out = sessions.sessions(events(spark, sf), time="ts", gap="6 hours")
    return out.select("user_id", *[
        F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("first_event", "first_us"), ("session_end", "end_us"))], "n")


@query
def venue_trailing_years(spark, sf):
    out = frames.trailing_counts(B.papers(spark, sf), ["venue"], "year", 5)
    return out.select("venue", "year", "n", "trailing")


def supported(spark, sf):
    return B.papers(spark, sf).select("doc_id", "venue", ((F.col("doc_id") % 41) / 40).alias("support"))


@query
def venue_percentiles(spark, sf):
    return frames.percent_ranks(supported(spark, sf), ["venue"], "support").select(
        "venue", "support", "n", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"))


@query
def venue_quartiles(spark, sf):
    return frames.tiles(supported(spark, sf), ["venue"], ["support", "doc_id"], 4, "quartile").select("doc_id", "venue", "quartile")


@query
def claim_cube(spark, sf):
    """Claims by type, need and source with all totals."""
    docs = B.table(spark, sf, "documents")
    claims = extract.detect_citation_need(extract.classify_claims(extract.extract_claims(docs)))
    light = claims.select("doc_id", "claim_type", "citation_need").join(docs.select("doc_id", "source"), "doc_id")
    out = logs.count_cube(light, ["claim_type", "citation_need", "source"])
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("claim_type", "citation_need", "source")],
                      F.col("level").cast("int").alias("level"), "n")


# --- stored state -----------------------------------------------------------------------

@query
def verdict_table(spark, sf):
    """The last verdict per paper, merged into a table in three runs."""
    log = events(spark, sf).where("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("paper_id"), F.col("event_type").alias("verdict"), "value", "event_id")
    target = shared_folder(spark)
    for run in range(3):
        tables.upsert(log.where(F.col("event_id") % 3 == run), target, ["paper_id"], ["event_id"], buckets=16)
    return tables.latest_table(spark, target).select("paper_id", "verdict", "value")


@query
def daily_sketches(spark, sf):
    """Sketches of users and values per event type and day, stored and merged, and
    whether their estimates are within the stated error of the exact figures
    (three standard errors for the distinct count)."""
    log = events(spark, sf)
    path = shared_folder(spark)
    sketches.store(sketches.daily(log, ["event_type"], F.to_date("ts"), F.col("user_id"), F.col("value")), path)
    got = sketches.report(sketches.merged(sketches.load(spark, path), ["event_type"]), ["event_type"])
    exact = log.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("value").alias("held"))
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), 3 * sketches.DISTINCT_ERROR * F.col("users"))
    # Rows at or below, and below, an estimated quantile enclose its rank.
    marks = broadcast_checked(cut_lineage(got.select("event_type", F.posexplode("quantiles").alias("i", "q"))))
    ranks = log.select("event_type", "value").join(marks, "event_type").groupBy("event_type", "i").agg(
        (F.count_if(F.col("value") < F.col("q")) / F.count("value")).alias("under"),
        (F.count_if(F.col("value") <= F.col("q")) / F.count("value")).alias("upto"))
    wanted = (F.col("i") + 1) * 0.25
    right = ranks.groupBy("event_type").agg(F.every(
        (F.col("under") - sketches.RANK_ERROR <= wanted) & (wanted <= F.col("upto") + sketches.RANK_ERROR)).alias("ranks_within"))
    return got.join(exact, "event_type").join(right, "event_type").select(
        "event_type", "n", "users", near.alias("users_within"), "ranks_within")


# --- titles and captured pages ------------------------------------------------------------

@query
def title_blocks(spark, sf):
    """Matching blocks of every title with its beginning and with its end, which
    are single blocks, so the exact value is known."""
    p = B.papers(spark, sf)
    third = F.floor(F.length("title") / 3).cast("int")
    return p.select("doc_id", F.round(X.title_similarity(F.col("title"), F.left("title", third), "blocks"), 9).alias("beginning"),
                    F.round(X.title_similarity(F.col("title"), F.right("title", third), "blocks"), 9).alias("ending"))


PAGE = 50
#: Responses in a file, one per line.
FILE_PAGES = 1_000
WORK = "id STRING, doi STRING, title STRING, publication_year INT, type STRING, cited_by_count BIGINT"


def captured_pages(spark, sf, path):
    """Pages of fifty works per venue, as a search service answers."""
    works = B.papers(spark, sf).select(
        F.col("journal").alias("query"), F.floor(F.col("doc_id") / PAGE).alias("no"), F.struct(
            F.concat(F.lit("W"), "doc_id").alias("id"), "doi", "title", F.col("year").alias("publication_year"),
            F.when(F.col("doc_id") % 4 == 0, F.lit("preprint")).otherwise(F.lit("article")).alias("type"),
            F.col("citation_count").alias("cited_by_count")).alias("work"))
    pages = works.groupBy("query", "no").agg(F.sort_array(F.collect_list("work")).alias("results"))
    pages.select("query", "results").write.option("maxRecordsPerFile", FILE_PAGES).json(path)


@query
def captured_search(spark, sf):
    """Captured pages read with the year and type conditions pushed down."""
    path = shared_folder(spark)
    captured_pages(spark, sf, path)
    works = captured.captured(spark, path, "openalex", WORK).where(
        "publication_year >= 2005 AND publication_year <= 2020 AND type = 'article'")
    return works.select("query", "id", F.coalesce("doi", F.lit("")).alias("doi"), "title", "publication_year", "cited_by_count")
