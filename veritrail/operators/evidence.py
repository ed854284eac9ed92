"""Evidence text for papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import normalize_doi, paper_id_of
from ..functions.text import SPACE, strip, text_or_empty, text_or_null
from ..sources.mappers import inverted_abstract
from .logs import utc_stamp

# Fixed value: characters of evidence that are kept.
MAX_EVIDENCE_CHARS = 2000


def arxiv_id() -> Column:
    """Id from an arXiv URL, else the DOI of a paper whose venue is arXiv."""
    url = text_or_empty(F.col("url"))
    return (F.when(F.contains(url, F.lit("arxiv.org/abs/")), F.substring_index(url, "/", -1))
            .when(F.lower(text_or_empty(F.col("venue"))).startswith("arxiv"), F.col("doi")))


def arxiv_summary(response: Column) -> Column:
    raw = F.regexp_extract(text_or_empty(response), "(?s)<summary>(.*?)</summary>", 1)
    return strip(F.regexp_replace(raw, f"(?U){SPACE}+", " "))


def fetch_evidence(papers: DataFrame, openalex: DataFrame, semantic_scholar: DataFrame,
                   arxiv: DataFrame) -> DataFrame:
    """Own abstract, else OpenAlex, else Semantic Scholar (both by DOI), else
    the arXiv summary, else nothing.

    Papers with an abstract are finished without a join; the others join the
    response tables (openalex: raw works; semantic_scholar: doi, abstract;
    arxiv: arxiv_id, response)."""
    cut = lambda text: F.substring(text, 1, MAX_EVIDENCE_CHARS)
    own = strip(text_or_empty(F.col("abstract")))
    done = (papers.where(own != "").withColumn("evidence_level", F.lit("ABSTRACT"))
            .withColumn("evidence_source", F.lit("search_result")).withColumn("evidence_text", cut(own)))

    oa = openalex.select(normalize_doi(F.col("doi")).alias("_doi"),
                         text_or_null(inverted_abstract(F.col("abstract_inverted_index"))).alias("_oa"))
    s2 = semantic_scholar.select(normalize_doi(F.col("doi")).alias("_doi"),
                                 text_or_null(strip(text_or_empty(F.col("abstract")))).alias("_s2"))
    ax = arxiv.select(F.col("arxiv_id").alias("_ax"),
                      text_or_null(arxiv_summary(F.col("response"))).alias("_sum"))
    # Least non-null text per key; a filter on the text would compute it twice.
    oa = oa.where("_doi IS NOT NULL").groupBy("_doi").agg(F.min("_oa").alias("_oa"))
    s2 = s2.where("_doi IS NOT NULL").groupBy("_doi").agg(F.min("_s2").alias("_s2"))
    ax = ax.where("_ax IS NOT NULL").groupBy("_ax").agg(F.min("_sum").alias("_sum"))
    # Rows without a key would all meet in one task; a row hash keeps them apart.
    spread = lambda key: F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64("title", "url").cast("string")))
    looked_up = (papers.where(own == "")
                 .withColumn("_doi", spread(normalize_doi(F.col("doi")))).withColumn("_ax", spread(arxiv_id()))
                 .join(oa, "_doi", "left").join(s2, "_doi", "left").join(ax, "_ax", "left")
                 .withColumn("evidence_level", F.when(F.coalesce("_oa", "_s2").isNotNull(), F.lit("ABSTRACT"))
                             .when(F.col("_sum").isNotNull(), F.lit("SUMMARY")).otherwise(F.lit("METADATA_ONLY")))
                 .withColumn("evidence_source", F.when(F.col("_oa").isNotNull(), F.lit("openalex"))
                             .when(F.col("_s2").isNotNull(), F.lit("semantic_scholar"))
                             .when(F.col("_sum").isNotNull(), F.lit("arxiv_api"))
                             .otherwise(F.lit("title_metadata")))
                 .withColumn("evidence_text", cut(F.coalesce("_oa", "_s2", "_sum", F.lit(""))))
                 .drop("_doi", "_ax", "_oa", "_s2", "_sum"))
    return done.unionByName(looked_up)


def evidence_log(papers: DataFrame, at: Column | None = None) -> DataFrame:
    return papers.select(
        utc_stamp(at).alias("timestamp"), F.lit("evidence").alias("event"), paper_id_of().alias("paper_id"),
        "title", "doi", "evidence_level", "evidence_source",
        F.length(text_or_empty(F.col("evidence_text"))).alias("evidence_chars"))
