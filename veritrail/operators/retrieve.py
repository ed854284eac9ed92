"""Candidate retrieval: responses of several sources for the planned queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import mappers as M
from .dedup import deduplicate
from .quality import drop_blacklisted, enrich

# Rows one request may return, and the order sources answer in.
PAGE_LIMITS = {"openalex": 50, "crossref": 50, "semantic_scholar": 100}
MAPPERS: dict[str, Callable] = {
    "openalex": M.map_openalex,
    "semantic_scholar": M.map_semantic_scholar,
    "crossref": M.map_crossref,
    "publish_or_perish": M.map_publish_or_perish,
    "exa": M.map_exa,
    "google_scholar": M.map_google_scholar,
}
SOURCE_YEAR = {
    "openalex": lambda: F.col("publication_year"),
    "semantic_scholar": lambda: F.col("year"),
    "crossref": M.crossref_year,
    "publish_or_perish": lambda: F.col("year"),
}
# The types Crossref and OpenAlex are asked for.
TYPES = {"crossref": ("journal-article",),
         "openalex": ("article", "conference-paper", "preprint", "posted-content")}
# Positions of one source lie between two multiples of this.
_STRIDE = 1 << 40


def source_candidates(searches: DataFrame, name: str, responses: DataFrame, number: int,
                      scope: Sequence[str], years: tuple[int, int] | None = None,
                      fields: Sequence[str] | None = None) -> DataFrame:
    """Unified rows of one source. `responses` carry (query, rank, payload...).

    Year, type and field filters are part of a request, so the budget of a query
    and the page limit of the source count the rows that pass them. Only a
    scholar page is cut first: there, scanned rows count."""
    rows = responses
    if name in TYPES and "type" in rows.columns:
        rows = rows.where(F.col("type").isin(*TYPES[name]))
    if fields and name == "semantic_scholar" and "fieldsOfStudy" in rows.columns:
        rows = rows.where(F.arrays_overlap("fieldsOfStudy", F.array(*map(F.lit, fields))))
    if years and name in SOURCE_YEAR:
        rows = rows.where(SOURCE_YEAR[name]().between(*years))
    limit = F.col("budget")
    if name in PAGE_LIMITS:
        limit = F.least(limit, F.lit(PAGE_LIMITS[name]))
    if name == "google_scholar":
        place = F.col("rank")
    else:
        rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("query").orderBy("rank")) - 1)
        place = F.col("_place")
    hits = rows.join(searches.select(*scope, "query", "budget"), "query").where(place < limit)
    if years and name == "google_scholar":
        year = F.nullif(F.col("bib.pub_year").try_cast("int"), F.lit(0))
        hits = hits.where(F.coalesce(year >= years[0], F.lit(True)))
    return MAPPERS[name](hits.withColumn("ord", F.lit(number * _STRIDE).cast("bigint") + F.col("rank")),
                         keep=(*scope, "query", "ord"))


def union_sources(searches: DataFrame, responses: dict[str, DataFrame], scope: Sequence[str],
                  years: tuple[int, int] | None = None) -> DataFrame:
    """All candidates of all sources; `ord` is (source, rank). A source without
    responses adds nothing."""
    parts = [source_candidates(searches, name, df, i, scope, years)
             for i, (name, df) in enumerate(responses.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def search_all(searches: DataFrame, responses: dict[str, DataFrame], blacklist: DataFrame,
               conferences: DataFrame, venue_sources: DataFrame, current_year: int,
               scope: Sequence[str] = ("claim_id", "query_no"), extra: DataFrame | None = None,
               years: tuple[int, int] | None = None) -> DataFrame:
    """Union, deduplicate within every query, drop blacklisted, enrich."""
    found = union_sources(searches, responses, scope, years)
    if extra is not None:
        shift = F.lit(len(responses) * _STRIDE).cast("bigint")
        found = found.unionByName(extra.withColumn("ord", F.col("ord") + shift), allowMissingColumns=True)
    merged = deduplicate(found, "ord", scope, bounded=True)
    return enrich(drop_blacklisted(merged, blacklist), conferences, venue_sources, current_year)


def search_log(papers: DataFrame, at: Column | None = None) -> DataFrame:
    """Log rows of retrieved papers."""
    from ..functions.text import first_author
    from .logs import utc_stamp
    return papers.select(
        utc_stamp(at).alias("timestamp"), F.lit("search_result").alias("event"), "paper_id", "query",
        "title", "doi", "year", "venue", first_author(F.col("authors")).alias("first_author"),
        "citation_count", "source_apis")
