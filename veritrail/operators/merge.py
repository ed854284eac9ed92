"""Field-wise merge of records that describe the same paper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which record wins a field. The first group keeps the value of
# the most trusted record that has one, the second the fullest value.
FIRST_WINS = ("title", "venue", "journal", "abstract", "issn_l", "issn")
LONGEST_WINS = ("volume", "issue", "pages", "publisher", "url", "open_access_pdf",
                "oa_status", "language", "venue_type")
MERGED = FIRST_WINS + LONGEST_WINS + ("authors", "keywords", "year", "is_oa", "citation_count",
                                      "source", "source_apis")


def authors_quality(authors: Column) -> Column:
    """Complete 'Last, First' names weigh most, then the number of names, then
    their length; -1 when missing."""
    complete = F.size(F.filter(authors, lambda a: F.contains(a, F.lit(","))))
    chars = F.length(F.array_join(authors, ""))
    return F.coalesce(complete * 1000 + F.size(authors) * 10 + chars, F.lit(-1))


def year_quality(year: Column) -> Column:
    return F.when(year.isNull(), F.lit(-1)).when(year == 0, F.lit(0)).otherwise(F.lit(1))


def merge_records(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  rename_single: bool = True, empty_as_null: bool = False,
                  least: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """One row per key. `order` ranks the records of a key, best first, and has
    to be unique within it.

    Every field is a minimum over (rank, value), so both steps combine on the
    map side and a key that holds most of the rows still moves only one partial
    record per task. The first step also keys on the contributing sources; the
    second one therefore only ever sees one record per source combination and
    can list them in rank order.

    `n` counts the merged records (or sums `weight`). With `rename_single=False`
    a record that stands alone keeps its `source` and `source_apis`. `least`
    adds columns with the least value of an expression over the key.
    """
    least = least or {}
    rank = [F.col(c) for c in order]
    taken = {*MERGED, *keys, *order, *least, *([weight] if weight else [])}
    carried = [c for c in df.columns if c not in taken]
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if empty_as_null else F.col(c)

    def best(value: Column, when: Column, *front: Column) -> Column:
        return F.min(F.when(when, F.struct(*[f.alias(f"f{i}") for i, f in enumerate(front)],
                                           *[r.alias(f"r{i}") for i, r in enumerate(rank)],
                                           value.alias("v"))))

    first = F.struct(*order, *[F.col(c) for c in carried], F.col("source"),
                     F.col("source_apis"), F.col("is_oa"), F.col("citation_count"))
    partial = [F.min(first).alias("_first"), F.count(F.lit(1)).alias("_rows"),
               (F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"),
               *[F.min(expr).alias(name) for name, expr in least.items()],
               F.max(F.coalesce("citation_count", F.lit(0))).alias("_cites"),
               F.max(F.coalesce("is_oa", F.lit(False))).alias("_oa")]
    for c in FIRST_WINS:
        value = blank(c) if c != "issn" else F.col(c)
        partial.append(best(value, value.isNotNull()).alias(f"best_{c}"))
    for c in LONGEST_WINS:
        partial.append(best(F.col(c), F.col(c).isNotNull(), -F.length(c)).alias(f"best_{c}"))
    partial.append(best(F.col("keywords"), F.col("keywords").isNotNull(), -F.size("keywords")).alias("best_keywords"))
    quality = authors_quality(F.col("authors"))
    partial.append(best(F.col("authors"), quality >= 0, -quality).alias("best_authors"))
    known = year_quality(F.col("year"))
    partial.append(best(F.col("year"), known >= 0, -known).alias("best_year"))

    apis = F.coalesce("source_apis", F.array().cast("array<string>"))
    by_source = (df.withColumn("_apis", F.struct(apis.alias("apis"), F.col("source").alias("source")))
                 .groupBy(*keys, "_apis").agg(*partial))

    slots = [f"best_{c}" for c in FIRST_WINS + LONGEST_WINS + ("keywords", "authors", "year")]
    seen = F.transform(F.array_sort(F.collect_list(
        F.struct(*[F.col(f"_first.{c}").alias(c) for c in order], F.col("_apis").alias("_apis")))),
        lambda e: e["_apis"])
    merged = by_source.groupBy(*keys).agg(
        F.min("_first").alias("_first"), F.sum("_rows").alias("_rows"), F.sum("_n").alias("n"),
        *[F.min(name).alias(name) for name in least], F.max("_cites").alias("_cites"),
        F.max("_oa").alias("_oa"), *[F.min(s).alias(s) for s in slots], seen.alias("_seen"))

    named = F.array_distinct(F.flatten(F.transform("_seen", lambda e: e["apis"])))
    plain = F.array_distinct(F.filter(
        F.transform("_seen", lambda e: e["source"]), lambda s: F.coalesce(s, F.lit("")) != ""))
    merged = merged.withColumn("_union", F.when(F.size(named) > 0, named).otherwise(plain))
    alone = F.col("_rows") == 1
    keep = alone & F.lit(not rename_single)
    joined = F.when(F.size("_union") > 0, F.array_join("_union", "+")).otherwise(F.col("_first.source"))
    return merged.select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in order],
        *[F.col(f"_first.{c}").alias(c) for c in carried],
        *[F.col(f"{s}.v").alias(s.removeprefix("best_")) for s in slots],
        F.when(F.col("_oa"), F.lit(True)).otherwise(F.col("_first.is_oa")).alias("is_oa"),
        F.when(alone, F.col("_first.citation_count")).otherwise(F.col("_cites")).alias("citation_count"),
        F.when(keep, F.col("_first.source")).otherwise(joined).alias("source"),
        F.when(keep, F.col("_first.source_apis")).otherwise(F.col("_union")).alias("source_apis"),
        *least, "n")
