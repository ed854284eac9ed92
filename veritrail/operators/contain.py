"""Which fragments are part of which texts, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked, cut_lineage

# Lengths of the leading pieces that serve as join keys, the longest that fits a fragment.
_WIDTHS = (24, 8, 4, 2, 1)
# Pieces that may be broadcast, as far as they keep within the limit of bytes.
_PIECES = 2_000_000
# Tasks per slot: texts are few bytes for the work they cause.
_TASKS = 4


def contained_fragments(fragments: DataFrame, bodies: DataFrame) -> DataFrame:
    """Distinct `fragment`s (not empty) that occur in some `body`.

    The first 24 characters of a fragment (8, 4, 2 or 1 of a shorter one) must
    occur in the text, so a hash of that piece joins the hashes of the text's
    pieces of the same width. At such a place the text is cut to the lengths of
    the fragments that begin with the piece, and equal cuts are counted once: a
    fragment never meets all the texts that share its beginning, so the work
    grows with the length of the texts."""
    n = F.length("fragment")
    width = F.lit(_WIDTHS[-1])
    for w in reversed(_WIDTHS[:-1]):
        width = F.when(n >= w, F.lit(w)).otherwise(width)
    wanted = cut_lineage(fragments.where("fragment <> ''").select("fragment").distinct())
    sized = wanted.select(n.alias("n"), width.alias("width"), F.xxhash64(width, F.left("fragment", width)).alias("piece"))
    begins = sized.groupBy("piece").agg(F.collect_set("n").alias("lengths"))
    widths = F.coalesce(sized.agg(F.collect_set("width")).scalar(), F.array().cast("array<int>"))
    slots = bodies.sparkSession.sparkContext.defaultParallelism
    texts = (bodies.where("body IS NOT NULL").select("body").distinct().repartition(_TASKS * slots, "body")
             .withColumn("tid", F.xxhash64("body")))
    places = (texts.withColumn("_widths", widths).select("body", "tid", F.explode("_widths").alias("width"))
              .where(F.length("body") >= F.col("width"))
              .select("body", "tid", "width", F.explode(F.sequence(F.lit(1), F.length("body") - F.col("width") + 1)).alias("at"))
              .withColumn("piece", F.xxhash64("width", F.substring(F.col("body"), F.col("at"), F.col("width")))))
    # A set of pieces that is small filters the places where they arise; else
    # only hashes meet, and the texts are fetched for the places that are left.
    # Either way a cut is a part of its text, whatever the hashes do.
    small = broadcast_checked(begins, _PIECES)
    if small is begins:
        found = places.select("tid", "at", "piece").join(begins, "piece").join(texts, "tid")
    else:
        found = places.select("body", "at", "piece").join(small, "piece")
    cuts = found.select("body", "at", F.explode("lengths").alias("n")).select(
        F.substring(F.col("body"), F.col("at"), F.col("n")).alias("fragment")).distinct()
    return wanted.join(cuts, "fragment", "left_semi")
