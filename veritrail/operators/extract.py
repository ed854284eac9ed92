"""Documents to claims, and the claim stages that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions.ids import claim_id
from ..functions.text import bind, paragraphs, sentence_spans, text_or_empty, unnest


def _paragraph_claims(para: Column, compound: bool, noise_filter: bool) -> Column:
    spans = sentence_spans(para["text"])
    if noise_filter:
        spans = F.filter(spans, lambda s: ~C.is_noise(s["text"]))

    def parts(span: Column) -> Column:
        pieces = C.split_compound(span["text"]) if compound else F.array(span["text"])
        return bind(pieces, lambda ps: F.transform(ps, lambda p, i: F.struct(
            para["id"].alias("paragraph_id"),
            i.alias("sentence_id"),
            F.when(F.size(ps) == 1, span["start"] + para["start"]).alias("char_start"),
            F.when(F.size(ps) == 1, span["end"] + para["start"]).alias("char_end"),
            (F.size(ps) > 1).alias("split_from_compound"),
            p.alias("original_text"))))

    return F.flatten(F.transform(spans, parts))


def extract_claims(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   compound: bool = True, noise_filter: bool = True,
                   source_format: Column | None = None) -> DataFrame:
    """One row per claim of each document. Numbering and offsets are computed
    inside the document's row, so the flat map needs no shuffle."""
    found = F.flatten(F.transform(
        paragraphs(F.col(text)), lambda p: _paragraph_claims(p, compound, noise_filter)))
    empty = F.array().cast("array<string>")
    form = (source_format if source_format is not None else F.lit("text")).alias("source_format")
    return (unnest(docs, found, doc_id, form, value="c", position="pos")
            .select(
                doc_id, (F.col("pos") + 1).alias("claim_no"), claim_id(F.col("pos") + 1).alias("claim_id"),
                F.col("c.original_text"), F.lit("").alias("normalized_claim"), F.lit("").alias("claim_type"),
                F.lit("").alias("citation_need"), F.lit("").alias("section"), F.col("c.paragraph_id"),
                F.col("c.sentence_id"), F.col("c.char_start"), F.col("c.char_end"), "source_format",
                F.col("c.split_from_compound"), F.lit("cautious").alias("rewrite_permission"),
                F.array().cast("array<struct<type:string,query:string>>").alias("queries"),
                empty.alias("search_concepts"), empty.alias("synonyms")))


def _fill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fill only where nothing is set yet."""
    if column not in df.columns:
        return df.withColumn(column, value)
    return df.withColumn(column, F.when(text_or_empty(F.col(column)) == "", value).otherwise(F.col(column)))


def classify_claims(claims: DataFrame, text: str = "original_text") -> DataFrame:
    return _fill(claims, "claim_type", C.claim_type(F.col(text)))


def detect_citation_need(claims: DataFrame, text: str = "original_text") -> DataFrame:
    return _fill(claims, "citation_need", C.citation_need(F.col(text)))


def normalize_claims(claims: DataFrame, hints: DataFrame | None = None,
                     key: str = "claim_id") -> DataFrame:
    """Search form, concepts, synonyms and facets. `hints` (key, hint) gives an
    English form for a claim; the original text is never changed."""
    df = claims if hints is None else claims.join(hints.select(key, "hint"), key, "left")
    hint = F.lit("") if hints is None else F.col("hint")
    df = df.withColumn("normalized_claim", C.normalized_text(F.col("original_text"), hint))
    df = df.withColumn("_cs", C.concepts_and_synonyms(text_or_empty(F.col("original_text")), F.col("normalized_claim")))
    for name in C.FACET_PATTERNS:
        df = df.withColumn(name, C.facet(F.col("normalized_claim"), name))
    return (df.withColumn("search_concepts", F.col("_cs.concepts"))
            .withColumn("synonyms", F.col("_cs.synonyms"))
            .withColumn("context", F.lit("")).withColumn("outcome", F.lit(""))
            .drop("_cs", "hint"))


def generate_queries(claims: DataFrame) -> DataFrame:
    """Fill `queries` where it is empty."""
    norm = F.coalesce(F.nullif("normalized_claim", F.lit("")), F.col("original_text"), F.lit(""))
    made = C.search_queries(norm, F.col("search_concepts"), F.col("synonyms"), F.col("population"),
                            F.col("context"), F.col("claim_type"))
    if "queries" not in claims.columns:
        return claims.withColumn("queries", made)
    return claims.withColumn("queries", F.when(F.coalesce(F.size("queries"), F.lit(0)) == 0, made)
                             .otherwise(F.col("queries")))


def planned_searches(claims: DataFrame, limit: int, key: str = "claim_id") -> DataFrame:
    """(key, query_no, type, query, budget): the first four queries of every
    claim that needs a citation; the budget divides by all its queries."""
    fallback = F.array(F.struct(
        F.lit("precise").alias("type"),
        F.coalesce(F.nullif("normalized_claim", F.lit("")), F.col("original_text"), F.lit("")).alias("query")))
    queries = F.when(F.coalesce(F.size("queries"), F.lit(0)) == 0, fallback).otherwise(F.col("queries"))
    budget = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.size("q"))).cast("int").alias("budget")
    asked = claims.where(F.coalesce(F.col("citation_need"), F.lit("")) != "NOT_NEEDED").select(key, queries.alias("q"))
    return (unnest(asked, F.slice("q", 1, 4), key, budget, value="item", position="query_no")
            .select(key, "query_no", F.col("item.type").alias("type"), F.col("item.query").alias("query"), "budget")
            .where(text_or_empty(F.col("query")) != ""))
