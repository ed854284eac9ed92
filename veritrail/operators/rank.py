"""Gates, ranking profiles and greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.ids import paper_id_of
from ..functions.text import first_author, text_or_empty
from ..session import cut_lineage
from .keys import first_per_key

# Penalties for a first author or venue that is already selected.
SAME_AUTHOR = 0.6
SAME_VENUE = 0.7
_STEPS = max(S.MAX_PER_CLAIM.values())


def with_gate(pairs: DataFrame, threshold: float = S.SUPPORT_THRESHOLD) -> DataFrame:
    """`reject_reason` is null for pairs that pass every gate."""
    return pairs.withColumn("reject_reason", S.gate_reason(
        F.col("support_score"), F.col("verification_status"), F.col("support_level"), threshold))


def base_composite(current_year: int, diversity: Column | None = None) -> Column:
    return S.composite(
        S.profile_name(text_or_empty(F.col("claim_type"))), F.col("support_score"), F.col("tier_score"),
        F.col("recency_score"), F.col("year"), F.col("citation_count"),
        diversity if diversity is not None else F.lit(1.0), current_year)


def _diversity(chosen: Column, author: Column, venue: Column) -> Column:
    """Against the selected papers in order: the first one that shares the
    author or the venue decides."""
    clash = F.filter(
        F.transform(chosen, lambda s: F.when((author != "") & (author == s["author"]), F.lit(SAME_AUTHOR))
                    .when((venue != "") & (venue == s["venue"]), F.lit(SAME_VENUE))),
        lambda d: d.isNotNull())
    return F.coalesce(F.get(clash, 0), F.lit(1.0))


def select_for_claims(pairs: DataFrame, current_year: int, key: str = "claim_id", order: str = "ord",
                      per_claim: Column | None = None) -> DataFrame:
    """(key, order, pick, composite_score) of the selected pairs.

    Greedy selection is repeated at most three times, because no claim takes
    more than three papers. Each step is one aggregate (the best remaining pair
    of a claim) and one join with the few pairs selected so far, so a claim with
    very many candidates is never gathered. Ties fall back to the ranking of
    the step before, and at last to the input order."""
    k = per_claim if per_claim is not None else S.per_claim_limit(
        text_or_empty(F.col("citation_need")), text_or_empty(F.col("claim_type")))
    pool = pairs.select(
        key, order, k.alias("_k"), "claim_type", "support_score", "tier_score", "recency_score", "year",
        "citation_count", F.lower(first_author(F.col("authors"))).alias("author"),
        F.lower(text_or_empty(F.col("venue"))).alias("venue"))
    # Every step reads the pool again, so it is written once: matching columns
    # and scores only, no texts.
    pool = cut_lineage(pool.withColumn("c1", base_composite(current_year)))
    picks = None
    chosen = None
    for step in range(1, _STEPS + 1):
        left = pool.where(F.col("_k") >= step)
        if chosen is not None:
            left = (left.join(chosen, key).where(~F.array_contains("taken", F.col(order)))
                    .withColumn("c2", base_composite(current_year, _diversity(
                        F.slice("held", 1, 1), F.col("author"), F.col("venue")))))
            if step == 3:
                left = left.withColumn("c3", base_composite(current_year, _diversity(
                    F.col("held"), F.col("author"), F.col("venue"))))
        ranks = [F.col(f"c{i}") for i in range(step, 0, -1)]
        best = F.max_by(F.struct(F.col(order), F.col("author"), F.col("venue"), F.col(f"c{step}").alias("score")),
                        F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)],
                                 (-F.col(order)).alias("o")))
        kept = F.first("taken").alias("taken") if chosen is not None else None
        held = F.first("held").alias("held") if chosen is not None else None
        aggs = [best.alias("b")] + ([kept, held] if chosen is not None else [])
        step_best = left.groupBy(key).agg(*aggs)
        found = step_best.select(key, F.col(f"b.{order}").alias(order), F.lit(step).alias("pick"),
                                 F.col("b.score").alias("composite_score"))
        picks = found if picks is None else picks.unionByName(found)
        one = F.array(F.struct(F.col("b.author").alias("author"), F.col("b.venue").alias("venue")))
        taken = F.array(F.col(f"b.{order}"))
        chosen = step_best.select(
            key, (F.concat("taken", taken) if chosen is not None else taken).alias("taken"),
            (F.concat("held", one) if chosen is not None else one).alias("held"))
    return picks


def rank_all(pairs: DataFrame, current_year: int, threshold: float = S.SUPPORT_THRESHOLD,
             order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(selected, rejected). `pairs` are scored candidates with their claim's
    type and need; `order` is a unique position within the claim. Rejected
    pairs say why: a gate, or outranked."""
    gated = with_gate(pairs, threshold)
    passed = gated.where("reject_reason IS NULL")
    picks = select_for_claims(passed, current_year, order=order)
    tagged = passed.drop("composite_score").join(picks, ["claim_id", order], "left")
    selected = tagged.where("pick IS NOT NULL").drop("reject_reason")
    outranked = tagged.where("pick IS NULL").withColumn("reject_reason", F.lit("outranked")).drop("pick")
    rejected = gated.where("reject_reason IS NOT NULL").unionByName(outranked, allowMissingColumns=True)
    return selected, rejected


def claim_links(selected: DataFrame) -> DataFrame:
    """Bridge rows between claims and selected papers."""
    return selected.select(
        "claim_id", paper_id_of().alias("paper_id"), "title", "doi", "support_score", "support_level",
        "evidence_level", "evidence_source",
        F.substring(text_or_empty(F.col("evidence_text")), 1, 1000).alias("evidence_text"),
        F.lit("SELECTED").alias("selection_status"),
        text_or_empty(F.col("support_reasoning")).alias("reason"))


def distinct_papers(selected: DataFrame, order: tuple[str, ...] = ("claim_id", "pick")) -> DataFrame:
    """Selected papers across claims; the first selection of a paper stays."""
    return first_per_key(selected.withColumn("paper_id", paper_id_of()), ["paper_id"], list(order))


def final_envelope(claims: DataFrame, papers: DataFrame, rejected: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The four result tables under their names."""
    return {"claims": claims, "papers": papers, "rejected": rejected, "links": links}
