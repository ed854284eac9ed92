"""From raw documents to packed sequences, in stages that are each written.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. run() applies them to the documents table, writing each result as Parquet
to the shared folder and reading it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import line_dedup, mixing, ngram_join, packing, quality
from veritrail.llm.common import stored, table

#: Words of a shingle and least similarity, in percent, of near copies.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return quality.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars follows
    the text. None goes, even if no line is left."""
    done = line_dedup.dedup(docs)
    return done.withColumn("n_chars", _chars(done)) if "n_chars" in docs.columns else done


def _chars(docs: DataFrame) -> Column:
    kind = dict(docs.dtypes)["n_chars"]
    return F.coalesce(F.length("text").cast(kind), F.col("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of near copies: five words, 0.8. The
    values of op9 are that query's alone."""
    return ngram_join.keep_one(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, first_only=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("near duplicates", near_duplicates),
          ("mix sources", mix_sources), ("pack sequences", pack_sequences)]

#: Sketches and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
