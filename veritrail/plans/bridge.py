"""Pipeline inputs derived from the shared tables.

The shared tables hold no bibliography, so papers, registry records, search
hits and logs are derived from `documents` by fixed rules: a document is a
paper whose title is the start of its first sentence, and so on. Everything is computed by
Spark from the whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import claim_id
from ..session import spread

CURRENT_YEAR = 2026
FAMILY_NAMES = ("Adams", "Baker", "Clark", "Davis", "Evans", "Foster", "Green", "Hughes", "Irwin", "Jones")
GIVEN_NAMES = ("Ann", "Bo Lee", "Carl", "Dana-Eve")
# Tables whose rows cost enough work to be spread when the scan is small.
_TEXT_TABLES = ("documents", "pages", "conversations")
SOURCES = ("crossref", "openalex", "semantic_scholar")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in _TEXT_TABLES else df


def headline(text: Column) -> Column:
    """Title of a document: its first sentence, ten words at most."""
    return F.regexp_extract(text, r"^[^.!?\s]+(?: [^.!?\s]+){0,9}", 0)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _author(slot: int) -> Column:
    """Name number `slot` of a paper; every third paper writes 'Last, First'."""
    family = _pick(FAMILY_NAMES, (F.col("letter") + slot) % 10)
    given = _pick(GIVEN_NAMES, (F.col("letter") + slot) % 4)
    return F.when(F.col("letter") % 3 == 0, F.concat(family, F.lit(", "), given)).otherwise(
        F.concat(given, F.lit(" "), family))


def papers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Unified paper rows, one per document, in document order (`ord`), with
    `more` columns of the document behind them."""
    docs = table(spark, sf_dir, "documents")
    base = (docs.withColumn("title", headline(F.col("text")))
            .withColumn("letter", F.ascii(F.lower("title")))
            .withColumn("doi", F.when(F.col("doc_id") % 2 == 0, F.concat(
                F.lit("10.1000/"), F.substring(F.sha2("text", 256), 1, 12)))))
    authors = F.slice(F.array(_author(0), _author(1), _author(2)), 1, F.when(
        F.col("doc_id") % 29 == 0, F.lit(0)).otherwise(F.col("letter") % 3 + 1).cast("int"))
    source = _pick(SOURCES, F.col("doc_id") % 3)
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return base.select(
        "doc_id", F.col("doc_id").alias("ord"), "title", authors.alias("authors"),
        F.when(F.col("doc_id") % 11 != 0, (2000 + F.col("letter") % 25).cast("int")).alias("year"),
        F.col("source").alias("journal"), F.col("source").alias("venue"),
        F.when(F.col("doc_id") % 19 == 0, F.lit("conference")).otherwise(F.lit("journal")).alias("venue_type"),
        "doi", F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "doi")).alias("url"),
        F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise(F.lit("")).alias("abstract"),
        F.col("n_chars").alias("citation_count"),
        F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("volume"), text(None).alias("issue"),
        F.concat_ws("-", F.lit("1"), F.col("n_chars").cast("string")).alias("pages"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("MDPI AG")).otherwise(F.lit("Open Press")).alias("publisher"),
        F.when(F.col("doc_id") % 23 == 0, F.lit("1424-8220")).alias("issn_l"),
        F.array().cast("array<string>").alias("issn"), text(None).alias("open_access_pdf"),
        (F.col("doc_id") % 7 == 0).alias("is_oa"), text(None).alias("oa_status"), F.col("lang").alias("language"),
        F.array("lang").alias("keywords"), F.lit("api").alias("source_layer"), source.alias("source"),
        F.array(source).alias("source_apis"), F.lit(0.0).alias("tier_score"), F.lit(0.0).alias("recency_score"),
        F.lit(None).cast("double").alias("support_score"), F.lit(None).cast("double").alias("composite_score"), *more)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(
        claim_id(F.col("item_id")).alias("claim_id"), F.col("text").alias("original_text"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registered work per DOI, with the defects that verification has to
    find: missing works, other titles, other years."""
    works = (papers(spark, sf_dir).where("doi IS NOT NULL").groupBy("doi")
             .agg(F.min("doc_id").alias("rid"), F.min_by(F.struct("title", "authors", "year"), "doc_id").alias("p"))
             .select("doi", "rid", "p.*"))
    digit = F.col("rid") % 10
    short = F.left(F.col("title"), F.floor(F.length("title") * 3 / 10).cast("int"))
    return (works.where(digit != 0)
            .withColumn("real_title", F.when(digit == 2, short).otherwise(F.col("title")))
            .withColumn("real_year", F.when(digit == 4, F.coalesce("year", F.lit(2000)) + 2).otherwise(
                F.coalesce("year", F.lit(2000)))))


def crossref_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as raw Crossref records."""
    people = F.transform("authors", lambda a: F.when(
        F.contains(a, F.lit(", ")), F.struct(F.split_part(a, F.lit(", "), F.lit(2)).alias("given"),
                                             F.split_part(a, F.lit(", "), F.lit(1)).alias("family"),
                                             F.lit(None).cast("string").alias("name")))
        .otherwise(F.struct(F.regexp_extract(a, r"^(.*) (\S+)$", 1).alias("given"),
                            F.regexp_extract(a, r"^(.*) (\S+)$", 2).alias("family"),
                            F.lit(None).cast("string").alias("name"))))
    parts = lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    none = F.lit(None).cast("struct<`date-parts`:array<array<int>>>")
    online = F.col("rid") % 3 == 0
    year = F.col("real_year").cast("int")
    return registry(spark, sf_dir).select(
        F.upper("doi").alias("DOI"), F.array("real_title").alias("title"), people.alias("author"),
        F.when(~online, parts(year)).alias("issued"), none.alias("published-print"),
        F.when(online, parts(year)).alias("published-online"), none.alias("published"))


def openalex_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works an independent source holds under the same DOI (a third of them),
    with a word index instead of an abstract."""
    from .texts import word_index
    names = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    held = registry(spark, sf_dir).where("rid % 3 = 1")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), "text")
    return held.join(docs, "rid").select(
        F.concat(F.lit("W"), "rid").alias("id"), "doi", F.col("real_title").alias("title"),
        F.lit(None).cast("string").alias("display_name"), F.col("real_year").alias("publication_year"),
        names.alias("authorships"), word_index(F.col("text")).alias("abstract_inverted_index"))


def title_hits(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Title-search hits of one source as (query_title, rank, raw payload)."""
    keep = {"semantic_scholar": "doc_id % 3 = 0", "openalex": "doc_id % 2 = 1 AND doc_id % 3 <> 2"}[name]
    found = (papers(spark, sf_dir).where(keep).where("title <> ''").groupBy("title", "year")
             .agg(F.min_by("authors", "doc_id").alias("authors")))
    from pyspark.sql import Window as W
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("title").orderBy("year")) - 1)
    if name == "semantic_scholar":
        return ranked.select(F.col("title").alias("query_title"), "rank", "title", F.col("year"),
                             F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"))
    return ranked.select(
        F.col("title").alias("query_title"), "rank", "title", F.lit(None).cast("string").alias("display_name"),
        F.col("year").alias("publication_year"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"))
