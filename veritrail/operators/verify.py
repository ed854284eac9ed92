"""Verification of candidate papers against registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import normalize_doi, paper_id_of
from ..functions.scores import ACCEPTED_VERDICTS, py_round
from ..functions.text import (author_name, bind, family_given, first_author, first_author_last_name,
                              last_name, text_or_empty, title_similarity)
from ..session import cut_lineage
from ..sources.mappers import crossref_year
from .keys import first_per_key, last_per_key
from .logs import utc_stamp
from .tables import latest_table, upsert

# Title agreement threshold, hits looked at per title search.
TITLE_THRESHOLD = 0.85
SEARCH_HITS = 3

_STRINGS = "array<string>"


def registry_records(crossref: DataFrame) -> DataFrame:
    """(doi_key, real_title, real_year, real_authors) from raw Crossref works."""
    given_family = F.transform("author", author_name)
    rows = crossref.select(
        normalize_doi(F.col("DOI")).alias("doi_key"), text_or_empty(F.get("title", 0)).alias("real_title"),
        crossref_year().alias("real_year"),
        F.coalesce(given_family, F.array().cast(_STRINGS)).alias("real_authors")).where("doi_key IS NOT NULL")
    return first_per_key(rows, ["doi_key"], ["real_title", "real_year"])


def _display_names(authorships: Column) -> Column:
    names = F.transform(authorships, lambda a: a["author"]["display_name"])
    return F.filter(F.coalesce(names, F.array().cast(_STRINGS)), lambda n: text_or_empty(n) != "")


def openalex_hits(works: DataFrame, *keep: str) -> DataFrame:
    """(keep..., title, year, authors) from raw OpenAlex works."""
    return works.select(
        *keep, F.coalesce(F.nullif("title", F.lit("")), F.col("display_name"), F.lit("")).alias("title"),
        F.col("publication_year").alias("year"), _display_names(F.col("authorships")).alias("authors"))


def scholar_hits(papers: DataFrame, *keep: str) -> DataFrame:
    """(keep..., title, year, authors) from raw Semantic Scholar papers."""
    names = F.transform("authors", lambda a: text_or_empty(a["name"]))
    return papers.select(*keep, text_or_empty(F.col("title")).alias("title"), "year",
                         F.coalesce(names, F.array().cast(_STRINGS)).alias("authors"))


def _lower_last(authors: Column) -> Column:
    return F.lower(first_author_last_name(authors))


def _names_agree(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)


def _agreeing(asked: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Distinct `key`s of `asked` (key, title, year, authors) with a hit that
    agrees in year, first author and title. The cheap tests come first, so the
    similarity only sees rows that passed them."""
    a, h = asked.alias("a"), hits.alias("h")
    pairs = (a.join(h, key)
             .where(F.col("a.year").isNull() | (F.col("h.year") == F.col("a.year")))
             .where(_names_agree(_lower_last(F.col("a.authors")), _lower_last(F.col("h.authors"))))
             .select(key, F.col("a.title").alias("ta"), F.col("h.title").alias("th")))
    return pairs.where(title_similarity(F.col("ta"), F.col("th")) >= TITLE_THRESHOLD).select(key).distinct()


def second_source(records: DataFrame, s2_search: DataFrame, openalex: DataFrame) -> DataFrame:
    """DOIs of registry records that an independent source confirms: a title
    search hit, or the work under the same DOI. A property of the record, so it
    is computed once per DOI, however many papers claim it."""
    asked = records.select("doi_key", F.col("real_title").alias("title"), F.col("real_year").alias("year"),
                           F.col("real_authors").alias("authors"))
    hits = scholar_hits(s2_search.where(F.col("rank") < SEARCH_HITS), "query_title")
    by_title = (hits.withColumnRenamed("query_title", "asked_title")
                .join(asked.select("doi_key", F.col("title").alias("asked_title")), "asked_title")
                .drop("asked_title"))
    by_doi = openalex_hits(openalex.withColumn("doi_key", normalize_doi(F.col("doi"))), "doi_key")
    return _agreeing(asked, by_title.unionByName(by_doi), "doi_key")


def backfill_authors(authors: Column, real: Column) -> Column:
    """Names without a comma take the registry's full form of the same last
    name (its first one); complete names stay."""
    table = F.filter(
        F.transform(real, lambda r: F.struct(F.lower(last_name(r)).alias("last"), family_given(r).alias("full"))),
        lambda e: e["last"] != "")

    def fill(name: Column, known: Column) -> Column:
        found = F.get(F.filter(known, lambda e: e["last"] == F.lower(last_name(name))), 0)["full"]
        return F.when(~F.contains(name, F.lit(",")) & F.coalesce(F.contains(found, F.lit(",")), F.lit(False)),
                      found).otherwise(name)

    return bind(table, lambda known: F.transform(
        F.coalesce(authors, F.array().cast(_STRINGS)), lambda n: fill(n, known)))


def _two_digits(value: Column) -> Column:
    return F.format_string("%.2f", py_round(value, 2))


def _doi_verdicts(papers: DataFrame, records: DataFrame, confirmed: DataFrame) -> DataFrame:
    joined = (papers.join(records.withColumn("_found", F.lit(True)), "doi_key", "left")
              .join(confirmed.withColumn("_second", F.lit(True)), "doi_key", "left")
              .withColumn("_sim", title_similarity(F.col("real_title"), F.col("title"))))
    found = F.coalesce(F.col("_found"), F.lit(False))
    title_ok = F.col("_sim") >= TITLE_THRESHOLD
    year_ok = F.col("year").isNull() | F.coalesce(F.col("real_year") == F.col("year"), F.lit(False))
    claimed, real = _lower_last(F.col("authors")), _lower_last(F.col("real_authors"))
    author_ok = _names_agree(claimed, real)
    agrees = title_ok & year_ok & author_ok
    second = F.coalesce(F.col("_second"), F.lit(False))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    reasons = F.array_compact(F.array(
        F.when(~title_ok, F.concat(F.lit("title mismatch ("), _two_digits(F.col("_sim")), F.lit(")"))),
        F.when(~year_ok, F.concat(F.lit("year mismatch (claimed "), text(F.col("year")), F.lit(", real "),
                                  text(F.col("real_year")), F.lit(")"))),
        F.when(~author_ok, F.concat(F.lit("first-author mismatch (claimed '"), claimed,
                                    F.lit("', real '"), real, F.lit("')")))))
    verdict = (F.when(~found, F.lit("UNVERIFIED")).when(~agrees, F.lit("CONFLICT"))
               .when(second, F.lit("VERIFIED")).otherwise(F.lit("LIKELY_REAL")))
    details = F.struct(
        F.when(found, F.col("real_title")).alias("real_title"), F.col("real_year").alias("real_year"),
        F.when(found, first_author(F.col("real_authors"))).alias("real_first_author"),
        F.col("real_authors").alias("real_authors"),
        F.when(found, py_round(F.col("_sim"), 4)).alias("title_similarity"),
        F.when(found, year_ok).alias("year_match"), F.when(found, author_ok).alias("first_author_match"),
        F.when(found & agrees, second).alias("second_source_agree"),
        F.when(found & ~agrees, reasons).alias("conflict_reasons"),
        F.when(~found, F.lit("claimed DOI does not resolve on Crossref"))
        .when(agrees & ~second, F.lit("single-source only (second source unavailable/limited)")).alias("note"),
        F.lit(None).cast(_STRINGS).alias("matched_sources"),
        F.when(~found, F.lit("NOT_FOUND")).alias("doi_status"),
        F.when(~found, F.struct(F.lit("Crossref returned no record").alias("reason"))).alias("doi_check"))
    filled = (verdict == "VERIFIED") & (F.size("real_authors") > 0)
    return (joined.withColumn("verification_status", verdict).withColumn("verification_details", details)
            .withColumn("authors_backfilled", F.coalesce(filled, F.lit(False)))
            .withColumn("authors", F.when(F.col("authors_backfilled"),
                                          backfill_authors(F.col("authors"), F.col("real_authors")))
                        .otherwise(F.col("authors")))
            .drop("_found", "_second", "_sim", "real_title", "real_year", "real_authors"))


def _search_verdicts(papers: DataFrame, s2_search: DataFrame, openalex_search: DataFrame) -> DataFrame:
    """Papers without a DOI: found by both title searches, or not."""
    asked = papers.groupBy("title", "year", F.col("authors")).agg(F.lit(1).alias("_")).drop("_")
    asked = asked.withColumn("ask", F.md5(F.to_json(F.struct("title", "year", "authors"))))
    def hits(df: DataFrame, mapper) -> DataFrame:
        found = mapper(df.where(F.col("rank") < SEARCH_HITS), "query_title")
        keyed = found.withColumnRenamed("query_title", "asked_title").join(
            asked.select("ask", F.col("title").alias("asked_title")), "asked_title").drop("asked_title")
        return _agreeing(asked, keyed, "ask")
    s2 = hits(s2_search, scholar_hits).withColumn("_s2", F.lit("semantic_scholar"))
    oa = hits(openalex_search, openalex_hits).withColumn("_oa", F.lit("openalex"))
    matched = F.array_compact(F.array("_s2", "_oa"))
    blank = lambda t: F.lit(None).cast(t)
    details = F.struct(
        blank("string").alias("real_title"), blank("int").alias("real_year"),
        blank("string").alias("real_first_author"), blank(_STRINGS).alias("real_authors"),
        blank("double").alias("title_similarity"), blank("boolean").alias("year_match"),
        blank("boolean").alias("first_author_match"), blank("boolean").alias("second_source_agree"),
        blank(_STRINGS).alias("conflict_reasons"), blank("string").alias("note"),
        matched.alias("matched_sources"), blank("string").alias("doi_status"),
        blank("struct<reason:string>").alias("doi_check"))
    return (papers.withColumn("ask", F.md5(F.to_json(F.struct("title", "year", "authors"))))
            .join(s2, "ask", "left").join(oa, "ask", "left")
            .withColumn("verification_status",
                        F.when(F.size(matched) >= 2, F.lit("LIKELY_REAL")).otherwise(F.lit("UNVERIFIED")))
            .withColumn("verification_details", details).withColumn("authors_backfilled", F.lit(False))
            .drop("ask", "_s2", "_oa"))


def verify_papers(papers: DataFrame, crossref: DataFrame, s2_search: DataFrame, openalex: DataFrame,
                  openalex_search: DataFrame) -> DataFrame:
    """Verdict, details and completed authors for every paper.

    crossref / openalex: raw works by DOI. s2_search / openalex_search: raw
    title-search hits with (query_title, rank). A paper with a DOI the registry
    does not know is UNVERIFIED; it is not searched by title."""
    keyed = papers.withColumn("doi_key", normalize_doi(F.col("doi")))
    records = registry_records(crossref)
    with_doi = _doi_verdicts(keyed.where("doi_key IS NOT NULL"), records,
                             second_source(records, s2_search, openalex))
    without = _search_verdicts(keyed.where("doi_key IS NULL"), s2_search, openalex_search)
    return with_doi.unionByName(without).drop("doi_key")


def verify_with_cache(papers: DataFrame, cache: DataFrame, **tables: DataFrame) -> DataFrame:
    """Verdicts from the cache (doi, verdict, details, authors_backfilled,
    authors) where it has one; only the rest meets the registry tables."""
    keyed = papers.withColumn("_k", normalize_doi(F.col("doi")))
    known = (cache.where(F.col("verdict").isin("VERIFIED", "LIKELY_REAL", "CONFLICT", "UNVERIFIED"))
             .select(normalize_doi(F.col("doi")).alias("_k"), F.col("verdict").alias("_v"),
                     F.col("details").alias("_d"), F.col("authors_backfilled").alias("_b"),
                     F.col("authors").alias("_a")))
    has_doi = keyed.where("_k IS NOT NULL")
    cached = (has_doi.join(known, "_k").withColumn("verification_status", F.col("_v"))
              .withColumn("verification_details", F.col("_d"))
              .withColumn("authors_backfilled", F.coalesce("_b", F.lit(False)))
              .withColumn("authors", F.when(F.col("authors_backfilled"), F.col("_a")).otherwise(F.col("authors")))
              .withColumn("verification_cached", F.lit(True)).drop("_k", "_v", "_d", "_b", "_a"))
    pending = has_doi.join(known.select("_k"), "_k", "left_anti").unionByName(keyed.where("_k IS NULL")).drop("_k")
    fresh = verify_papers(pending, **tables).withColumn("verification_cached", F.lit(False))
    return cached.unionByName(fresh)


def cache_rows(verified: DataFrame, at: Column | None = None) -> DataFrame:
    """What the cache keeps of verdicts: one row per DOI."""
    return verified.select(
        normalize_doi(F.col("doi")).alias("doi"), F.col("verification_status").alias("verdict"),
        F.col("verification_details").alias("details"), "authors_backfilled",
        F.when(F.col("authors_backfilled"), F.col("authors")).alias("authors"),
        (at if at is not None else F.current_timestamp()).alias("cached_at")).where("doi IS NOT NULL")


def refresh_cache(cache: DataFrame, verified: DataFrame, at: Column | None = None) -> DataFrame:
    """Cache after a run: every verdict of the run replaces the older one."""
    fresh = cache_rows(verified, at)
    both = cache.select(*fresh.columns).withColumn("_run", F.lit(0)).unionByName(fresh.withColumn("_run", F.lit(1)))
    return last_per_key(both, ["doi"], ["_run", "cached_at", "verdict"]).drop("_run")


def verify_and_keep(papers: DataFrame, cache_path: str, at: Column | None = None, **tables: DataFrame) -> DataFrame:
    """Verdicts with the cache table at `cache_path`: known DOIs come from it, and
    the verdicts of the others are merged into the buckets they fall into. A
    missing table is an empty cache."""
    spark = papers.sparkSession
    try:
        cache = latest_table(spark, cache_path)
    except FileNotFoundError:
        cache = None
    if cache is None:
        done = verify_papers(papers, **tables).withColumn("verification_cached", F.lit(False))
    else:
        done = verify_with_cache(papers, cache, **tables)
    done = cut_lineage(done)
    fresh = done.where(~F.col("verification_cached") & normalize_doi(F.col("doi")).isNotNull())
    upsert(cache_rows(fresh, at), cache_path, ["doi"], ["cached_at", "verdict"])
    return done


def split_by_verdict(verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected)."""
    kept = F.coalesce(F.col("verification_status").isin(*ACCEPTED_VERDICTS), F.lit(False))
    return verified.where(kept), verified.where(~kept)


def verdict_counts(verified: DataFrame) -> DataFrame:
    """One row with a count per verdict."""
    status = F.col("verification_status")
    return verified.agg(*[F.count_if(status == v).alias(v) for v in
                          ("VERIFIED", "LIKELY_REAL", "UNVERIFIED", "CONFLICT")])


def verification_log(verified: DataFrame, at: Column | None = None) -> DataFrame:
    return verified.select(
        utc_stamp(at).alias("timestamp"), F.lit("verification").alias("event"),
        paper_id_of().alias("paper_id"), F.col("title").alias("title_claimed"),
        F.col("doi").alias("doi_claimed"), F.col("year").alias("year_claimed"),
        first_author(F.col("authors")).alias("first_author_claimed"),
        F.col("verification_status").alias("verdict"), F.col("verification_details").alias("details"))
