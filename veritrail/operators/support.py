"""How well evidence supports a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.ids import paper_id_of
from ..functions.text import bind, coverage, keywords, strip, text_or_empty, unnest
from .keys import last_per_key
from .logs import utc_stamp

# Reasons and the bound on keywords that are compared.
HEURISTIC_REASON = "heuristic overlap fallback (no LLM configured)"
NEGATED_REASON = "heuristic: abstract negates the claim's assertion"
METADATA_REASON = "metadata-only: no abstract available"
SUPPORT_KEYWORDS = 50
DEFAULT_JUDGED_SCORE = 0.2

_VERDICT = "support_score DOUBLE, support_level STRING, reasoning STRING"


def evidence_of(prefix: str = "") -> Column:
    at = f"{prefix}." if prefix else ""
    return F.coalesce(F.nullif(F.col(f"{at}evidence_text"), F.lit("")), F.col(f"{at}abstract"), F.lit(""))


def _combine(in_evidence: Column, in_title: Column) -> Column:
    """{score, level}: the level comes from the unrounded score."""
    raw = F.least(F.lit(1.0), in_evidence * F.lit(0.75) + in_title * F.lit(0.25))
    return bind(raw, lambda r: bind(
        F.when(r < 0.30, F.least(r, F.lit(0.29))).otherwise(r),
        lambda s: F.struct(S.py_round(s, 2).alias("score"), S.support_level(s).alias("level"))))


def gate_coverage(threshold: float = S.SUPPORT_THRESHOLD) -> float:
    """Least coverage by the evidence of any pair over the gate, even when its
    title holds all keywords. The gate compares the score rounded to two digits,
    so the unrounded one may lie half a hundredth below the threshold."""
    return (threshold - 0.005 - 0.25) / 0.75 - 1e-6


def heuristic(claim: Column, title: Column, evidence: Column, level: Column,
              claim_kw: Column, title_kw: Column, evidence_kw: Column, negated: Column | None = None) -> Column:
    """{score, level, reason} from keyword coverage. The keyword arrays are
    arguments, so a caller that already has them does not pay twice; so is
    `negated`, whether the evidence denies the claim."""
    negated = S.contradicts(claim, evidence) if negated is None else negated
    bare = (evidence == "") & (F.coalesce(level, F.lit("METADATA_ONLY")) == "METADATA_ONLY")
    in_title = coverage(claim_kw, title_kw)
    scored = _combine(coverage(claim_kw, evidence_kw), in_title)
    return (F.when(bare, F.struct(
        S.py_round(in_title * F.lit(0.5), 2).alias("score"), F.lit("INSUFFICIENT_EVIDENCE").alias("level"),
        F.lit(METADATA_REASON).alias("reason")))
        .when(negated, F.struct(
            F.lit(0.10).alias("score"), F.lit("CONTRADICTORY").alias("level"), F.lit(NEGATED_REASON).alias("reason")))
        .otherwise(bind(scored, lambda s: F.struct(
            s["score"].alias("score"), s["level"].alias("level"), F.lit(HEURISTIC_REASON).alias("reason")))))


def parse_verdict(content: Column) -> Column:
    """{support_score, support_level, reasoning} from the first {...} of a
    judge's answer; null when there is none or it is not JSON."""
    found = F.nullif(F.regexp_extract(text_or_empty(content), r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(found, _VERDICT)


def _judged(score: Column, level: Column, reason: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(DEFAULT_JUDGED_SCORE))))
    return F.struct(
        S.py_round(clamped, 2).alias("score"),
        F.upper(F.coalesce(F.nullif(level, F.lit("")), S.support_level(clamped))).alias("level"),
        text_or_empty(reason).alias("reason"))


def _finish(df: DataFrame, claim: Column, verdict: Column, method: Column) -> DataFrame:
    """Apply the cap on title-only evidence and write the four score columns."""
    capped = S.py_round(S.cap_metadata_only(F.col("_v.score"), claim), 2)
    hit = (F.coalesce(F.col("evidence_level") == "METADATA_ONLY", F.lit(False))) & (capped != F.col("_v.score"))
    return (df.withColumn("_v", verdict)
            .withColumn("support_score", F.when(hit, capped).otherwise(F.col("_v.score")))
            .withColumn("support_level", F.when(hit, S.support_level(capped)).otherwise(F.col("_v.level")))
            .withColumn("support_reasoning", F.when(hit, F.concat(F.col("_v.reason"), F.lit(S.CAPPED_NOTE)))
                        .otherwise(F.col("_v.reason")))
            .withColumn("scoring_method", method).drop("_v"))


def score_support(pairs: DataFrame, claim: str = "claim_text", judged: DataFrame | None = None) -> DataFrame:
    """Support columns for claim-paper pairs.

    `judged` (claim_id, paper_id, content) holds answers of an external judge;
    pairs without a usable answer fall back to keyword coverage. Keyword arrays
    already present as claim_kw / title_kw / evidence_kw are reused, and so are
    the flags claim_asserts / evidence_negates."""
    df = pairs
    have = set(df.columns)
    flags = {"claim_asserts", "evidence_negates"} <= have
    negated = F.col("claim_asserts") & F.col("evidence_negates") if flags else None
    evidence = evidence_of()
    kw = lambda name, text: F.col(name) if name in have else keywords(text, SUPPORT_KEYWORDS)
    claim_text = text_or_empty(F.col(claim))
    df = (df.withColumn("_ck", kw("claim_kw", claim_text)).withColumn("_tk", kw("title_kw", F.col("title")))
          .withColumn("_ek", kw("evidence_kw", evidence)))
    fallback = heuristic(claim_text, F.col("title"), evidence, F.col("evidence_level"),
                         F.col("_ck"), F.col("_tk"), F.col("_ek"), negated)
    if judged is None:
        return _finish(df, claim_text, fallback, F.lit("heuristic")).drop("_ck", "_tk", "_ek")
    answers = (judged.withColumn("_j", parse_verdict(F.col("content"))).where(
        "_j IS NOT NULL AND (_j.support_score IS NOT NULL OR _j.support_level IS NOT NULL)")
        .select("claim_id", "paper_id", "_j"))
    df = df.join(answers, ["claim_id", "paper_id"], "left")
    by_judge = _judged(F.col("_j.support_score"), F.col("_j.support_level"), F.col("_j.reasoning"))
    used = F.col("_j").isNotNull()
    return _finish(df, claim_text, F.when(used, by_judge).otherwise(fallback),
                   F.when(used, F.lit("llm")).otherwise(F.lit("heuristic"))).drop("_ck", "_tk", "_ek", "_j")


def pending_judgments(pairs: DataFrame) -> DataFrame:
    """The items an external judge has to answer, one row per pair."""
    return pairs.select(
        "claim_id", F.col("claim_text").alias("claim"), paper_id_of().alias("paper_id"), "title",
        F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 5).alias("authors"), "year", "venue", "doi",
        F.coalesce("evidence_level", F.lit("?")).alias("evidence_level"),
        F.substring(evidence_of(), 1, 2000).alias("evidence_text"),
        (F.col("evidence_path") if "evidence_path" in pairs.columns else F.lit(None).cast("string")).alias("evidence_path"))


def apply_judgments(pairs: DataFrame, judgments: DataFrame, order: str = "ord") -> DataFrame:
    """Merge a judge's rows (paper_id, support_score, support_level, reasoning,
    order; optionally claim_id). The last row of a paper wins."""
    keys = [k for k in ("claim_id", "paper_id") if k in judgments.columns]
    last = last_per_key(judgments.where("paper_id IS NOT NULL AND paper_id <> ''"), keys, [order])
    last = last.select(*keys, F.struct("support_score", "support_level", "reasoning").alias("_j"))
    df = pairs.withColumn("paper_id", paper_id_of()).join(last, keys, "left")
    evidence = evidence_of()
    claim_text = text_or_empty(F.col("claim_text"))
    df = (df.withColumn("_ck", keywords(claim_text, SUPPORT_KEYWORDS))
          .withColumn("_tk", keywords(F.col("title"), SUPPORT_KEYWORDS))
          .withColumn("_ek", keywords(evidence, SUPPORT_KEYWORDS)))
    used = F.col("_j").isNotNull()
    by_judge = _judged(F.col("_j.support_score"), F.col("_j.support_level"), F.col("_j.reasoning"))
    fallback = heuristic(claim_text, F.col("title"), evidence, F.col("evidence_level"),
                         F.col("_ck"), F.col("_tk"), F.col("_ek"))
    return _finish(df, claim_text, F.when(used, by_judge).otherwise(fallback),
                   F.when(used, F.lit("agent_llm")).otherwise(F.lit("heuristic"))).drop("_ck", "_tk", "_ek", "_j")


def support_log(scored: DataFrame, at: Column | None = None) -> DataFrame:
    return scored.select(
        utc_stamp(at).alias("timestamp"), F.lit("support_score").alias("event"), "claim_id",
        paper_id_of().alias("paper_id"), "title", "doi", "support_score", "support_level",
        "evidence_level", "scoring_method", F.col("support_reasoning").alias("reasoning"))


def keyword_pairs(claims: DataFrame, papers: DataFrame, min_coverage: float,
                  claim_key: str = "claim_id", paper_key: str = "doc_id") -> DataFrame:
    """(claim_key, paper_key) of every pair whose evidence may hold at least
    `min_coverage` of the claim's keywords.

    claims: claim_key, claim_kw. papers: paper_key, evidence_kw. A paper that
    holds c of a claim's k keywords holds at least one of any k - c + 1 of
    them, so only the claim's rarest k - c + 1 keywords are joined: a word that
    most papers share is never a join key unless the claim has nothing else."""
    k = F.size("claim_kw")
    words = claims.where(k > 0).select(
        claim_key, F.explode("claim_kw").alias("word"), k.alias("k"))
    wanted = words.select("word").distinct()
    paper_words = unnest(papers, "evidence_kw", paper_key, value="word")
    seen = paper_words.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.row_number().over(W.partitionBy(claim_key).orderBy("df", "word"))
    need = F.greatest(F.lit(1), F.ceil(F.col("k") * F.lit(min_coverage) - F.lit(1e-9)))
    probes = (words.join(seen, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
              .withColumn("r", rarity).where(F.col("r") <= F.col("k") - need + 1)
              .where("df > 0").select(claim_key, "word"))
    return paper_words.join(probes, "word").select(claim_key, paper_key).distinct()
