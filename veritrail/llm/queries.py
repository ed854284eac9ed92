"""The queries of the operators over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation, grid_join, interleave, line_dedup, mixing, ngram_join, packing, quality, secret_scan,
               suffix_dedup, token_align, token_files, toxicity)
from .common import table
from .oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_embedding_near_dedup(spark, sf_dir):
    return grid_join.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op3_mix_sources(spark, sf_dir):
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target",
                          (F.col("copies") * F.col("size")).alias("taken"))


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op5_pack_sequences(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_token_files(spark, sf_dir):
    return token_files.digests(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark, sf_dir):
    judged = quality.verdicts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept")


@query
def op8_line_dedup(spark, sf_dir):
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op9_ngram_join(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark, sf_dir):
    scanned = secret_scan.scan(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", *[secret_scan.n_of_kind("base", k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
                          F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
                          secret_scan.written("spans").alias("spans"), "n_example", "n_shared", "n_live")


@query
def op11_conversation_repair(spark, sf_dir):
    return conversation.repair(table(spark, sf_dir, "conversations"))


@query
def op12_interleaved_shards(spark, sf_dir):
    return interleave.digests(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    return token_align.linked(table(spark, sf_dir, "documents"))
