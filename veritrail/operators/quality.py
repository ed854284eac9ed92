"""Venue quality: blacklist, tier and recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import text_or_empty
from ..session import broadcast_checked
from .keys import first_per_key


def venue_key(venue: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(venue)), "[^a-z0-9]", "")


def _with_values(df: DataFrame, name: str, lookup: DataFrame, column: str) -> DataFrame:
    """Adds the values of a lookup list as one array, evaluated once per query."""
    return df.withColumn(name, F.coalesce(
        lookup.agg(F.collect_set(column)).scalar(), F.array().cast("array<string>")))


def drop_blacklisted(papers: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Without papers whose ISSN or venue is listed or whose publisher contains
    a listed name. Venue and ISSN are hash lookups; only the publishers, of
    which there are few, are compared by substring."""
    names = broadcast_checked(blacklist.where("name_key IS NOT NULL").select(F.col("name_key").alias("_vk")).distinct())
    publishers = blacklist.where("publisher_key IS NOT NULL")
    issns = blacklist.where("issn IS NOT NULL")
    own = F.transform(
        F.concat(F.array("issn_l"), F.coalesce("issn", F.array().cast("array<string>"))), F.lower)
    publisher = venue_key(F.col("publisher"))
    flagged = (F.coalesce(F.arrays_overlap(F.filter(own, lambda i: i.isNotNull()), F.col("_issns")), F.lit(False))
               | F.exists("_publishers", lambda p: F.contains(publisher, p)))
    df = _with_values(_with_values(papers, "_issns", issns, "issn"), "_publishers", publishers, "publisher_key")
    return (df.where(~flagged).drop("_issns", "_publishers").withColumn("_vk", F.nullif(venue_key(F.col("venue")), F.lit("")))
            .join(names, "_vk", "left_anti").drop("_vk"))


def is_listed_conference(venue: Column, names: Column) -> Column:
    """Substring match in either direction against abbreviations and full
    names. A venue without ASCII letters or digits matches; an empty one does not."""
    key = venue_key(venue)
    return (text_or_empty(venue) != "") & F.exists(
        names, lambda k: F.contains(key, k) | F.contains(k, key))


def tier_scores(papers: DataFrame, conferences: DataFrame, sources: DataFrame) -> DataFrame:
    """`tier` per paper. `sources` are response rows (issn, venue, rank,
    citedness); the first one by rank answers a lookup. A paper is looked up by
    ISSN, or by venue when it has none."""
    issn = F.coalesce(F.nullif("issn_l", F.lit("")), F.get("issn", 0))
    key = (F.when(text_or_empty(issn) != "", F.concat(F.lit("issn:"), F.lower(issn)))
           .when(text_or_empty(F.col("venue")) != "", F.concat(F.lit("venue:"), F.lower("venue"))))
    answers = (sources.select(
        F.explode(F.array(F.concat(F.lit("issn:"), F.lower("issn")), F.concat(F.lit("venue:"), F.lower("venue")))).alias("_sk"),
        "rank", "citedness").where("_sk IS NOT NULL"))
    answers = first_per_key(answers, ["_sk"], ["rank"]).select("_sk", "citedness", F.lit(True).alias("_found"))
    conference = (F.coalesce(F.col("venue_type") == "conference", F.lit(False))
                  | is_listed_conference(F.col("venue"), F.col("_names")))
    score = F.when(F.col("_conf"), F.lit(S.CONFERENCE_TIER)).otherwise(
        S.citedness_tier(F.col("_found"), F.col("citedness")))
    return (_with_values(papers, "_names", conferences, "name_key").withColumn("_conf", conference).drop("_names").withColumn("_sk", F.when(~F.col("_conf"), key))
            .join(broadcast_checked(answers), "_sk", "left")
            .withColumn("tier", score).drop("_conf", "_sk", "_found", "citedness"))


def enrich(papers: DataFrame, conferences: DataFrame, sources: DataFrame, current_year: int) -> DataFrame:
    """Fill tier and recency where they are missing or zero."""
    scored = tier_scores(papers, conferences, sources)
    filled = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0.0, S.py_round(v, 4)).otherwise(F.col(c))
    return (scored.withColumn("tier_score", filled("tier_score", F.col("tier")))
            .withColumn("recency_score", filled("recency_score", S.recency(F.col("year"), current_year)))
            .drop("tier"))
