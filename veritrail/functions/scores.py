"""Score columns. The reference year is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, text_or_empty

# ---------------------------------------------------------------------------
# Bands, weights and patterns that decide the results below.
# ---------------------------------------------------------------------------

RECENCY_STEPS = ((2, 1.0), (5, 0.8), (10, 0.5), (20, 0.3))
RECENCY_FLOOR = 0.1
ORIGINALITY_STEPS = ((20, 1.0), (10, 0.8), (5, 0.5))
CITEDNESS_STEPS = ((10, 0.95), (5, 0.80), (2, 0.60), (0.5, 0.40))
CONFERENCE_TIER = 0.8
UNKNOWN_TIER = 0.1
LEVEL_BANDS = ((0.75, "DIRECT"), (0.60, "PARTIAL"), (0.30, "BACKGROUND"))
METADATA_CAP = 0.74
CAPPED_NOTE = " [capped: METADATA_ONLY]"
PUBLICATION_CLAIM = r"\b(published|released|appeared|reported) in (19|20)\d{2}\b"
NEGATION = (
    r"\b(does not|do not|did not|no (significant )?(effect|impact|improvement|benefit|"
    r"association|relationship|difference)|fails? to|without (any )?(effect|impact)|"
    r"not (improve|reduce|increase|affect|support)|contradict|refute|undermine|"
    r"challenge (the|this))\b"
)
ASSERTION = (
    r"\b(improve|improves|enhance|enhances|increase|increases|reduce|reduces|affect|"
    r"supports?|is (associated with|linked to)|leads? to|predicts?|explains?|"
    r"significantly)\b"
)
PROFILES = {
    "CURRENT_EMPIRICAL": {"support": 0.40, "quality": 0.25, "recency": 0.25, "diversity": 0.10},
    "FOUNDATIONAL": {"support": 0.40, "originality": 0.35, "authority": 0.20, "recency": 0.05},
    "METHOD": {"support": 0.40, "method_authority": 0.35, "relevance": 0.20, "recency": 0.05},
    "DEFINITION": {"support": 0.50, "originality": 0.30, "authority": 0.20, "recency": 0.0},
    "DEFAULT": {"support": 0.40, "quality": 0.25, "recency": 0.25, "diversity": 0.10},
}
# Terms of the weighted sum in the order they are added.
PROFILE_TERMS = ("support", "quality", "recency", "originality", "authority",
                 "method_authority", "diversity")
SUPPORT_THRESHOLD = 0.60
HIGH_RIGOR_THRESHOLD = 0.75
ACCEPTED_VERDICTS = ("VERIFIED", "LIKELY_REAL")
BLOCKED_LEVELS = ("CONTRADICTORY", "INSUFFICIENT_EVIDENCE")
MAX_PER_CLAIM = {"default": 1, "contested": 2, "systematic": 3}
ENTAILMENT_MIN_CHARS = 40
ENTAILMENT_PASS = 0.30
ENTAILMENT_WEAK = 0.15

# ---------------------------------------------------------------------------


def py_round(value: Column, digits: int) -> Column:
    """Round the binary value, halves to even: what `round` of a float does in
    the source data. Multiplies by 10^digits without error (two partial
    products), so the comparison with one half is exact."""
    scale = float(10 ** digits)

    def rounded(x: Column) -> Column:
        spread = x * F.lit(134217729.0)
        high = spread - (spread - x)
        top, rest = high * F.lit(scale), (x - high) * F.lit(scale)

        def settle(p: Column) -> Column:
            base = F.floor(p["top"] + p["rest"]).cast("double")
            gap = (p["top"] - base) - F.lit(0.5)
            up = (gap > -p["rest"]) | ((gap == -p["rest"]) & (F.pmod(base, F.lit(2.0)) == 1.0))
            return (base + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(scale)

        return bind(F.struct(top.alias("top"), rest.alias("rest")), settle)

    return bind(value.cast("double"), rounded)


def or_default(value: Column, default: float) -> Column:
    """Missing and zero both give the default."""
    return F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(float(default)))


def recency(year: Column, current_year: int) -> Column:
    age = F.lit(current_year) - year
    out = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(RECENCY_FLOOR))
    for limit, score in RECENCY_STEPS:
        out = out.when(age <= limit, F.lit(score))
    return out.otherwise(F.lit(RECENCY_FLOOR))


def originality(year: Column, current_year: int) -> Column:
    age = F.lit(current_year) - year
    out = F.when(F.coalesce(year, F.lit(0)) == 0, F.lit(0.5))
    for limit, score in ORIGINALITY_STEPS:
        out = out.when(age >= limit, F.lit(score))
    return out.otherwise(F.lit(0.3))


def authority(citations: Column) -> Column:
    n = F.coalesce(citations, F.lit(0))
    scaled = F.least(F.lit(1.0), F.log10(n + F.lit(1)) / F.lit(4.0))
    return F.when(n <= 0, F.lit(0.1)).otherwise(py_round(scaled, 4))


def method_authority(citations: Column, tier: Column) -> Column:
    return py_round(authority(citations) * F.lit(0.7) + or_default(tier, 0.1) * F.lit(0.3), 4)


def citedness_tier(found: Column, citedness: Column) -> Column:
    """Tier of a source by its two-year mean citedness; a source that was
    found but has no figure is in the lowest step, an unknown one below it."""
    value = F.coalesce(citedness, F.lit(0.0))
    out = F.when(~F.coalesce(found, F.lit(False)), F.lit(UNKNOWN_TIER))
    for limit, score in CITEDNESS_STEPS:
        out = out.when(value > limit, F.lit(score))
    return out.otherwise(F.lit(0.20))


def support_level(score: Column) -> Column:
    out = None
    for limit, level in LEVEL_BANDS:
        out = F.when(score >= limit, F.lit(level)) if out is None else out.when(score >= limit, F.lit(level))
    return out.otherwise(F.lit("INSUFFICIENT_EVIDENCE"))


def cap_metadata_only(score: Column, claim: Column) -> Column:
    return F.when(claim.rlike(f"(?iU){PUBLICATION_CLAIM}"), score).otherwise(
        F.least(score, F.lit(METADATA_CAP)))


def asserts(claim: Column) -> Column:
    return text_or_empty(claim).rlike(f"(?iU){ASSERTION}")


def negates(evidence: Column) -> Column:
    return text_or_empty(evidence).rlike(f"(?iU){NEGATION}")


def contradicts(claim: Column, evidence: Column) -> Column:
    return asserts(claim) & negates(evidence)


def profile_name(claim_type: Column) -> Column:
    return (F.when(claim_type == "DEFINITION", F.lit("DEFINITION"))
            .when(claim_type.isin("THEORETICAL", "HISTORICAL"), F.lit("FOUNDATIONAL"))
            .when(claim_type == "METHOD", F.lit("METHOD"))
            .otherwise(F.lit("CURRENT_EMPIRICAL")))


def profile_weight(profile: Column, term: str) -> Column:
    out = None
    for name, weights in PROFILES.items():
        value = F.lit(weights.get(term, 0.0))
        out = F.when(profile == name, value) if out is None else out.when(profile == name, value)
    return out.otherwise(F.lit(PROFILES["DEFAULT"].get(term, 0.0)))


def composite(profile: Column, support: Column, tier: Column, recency_: Column, year: Column,
              citations: Column, diversity: Column, current_year: int) -> Column:
    """Weighted sum of the claim's profile, unrounded terms, rounded to four digits."""
    values = {
        "support": F.coalesce(support, F.lit(0.0)),
        "quality": or_default(tier, 0.1),
        "recency": or_default(recency_, 0.1),
        "originality": originality(year, current_year),
        "authority": authority(citations),
        "method_authority": method_authority(citations, tier),
        "diversity": diversity,
    }
    total = None
    for term in PROFILE_TERMS:
        part = values[term] * profile_weight(profile, term)
        total = part if total is None else total + part
    return py_round(total, 4)


def years_close(a: Column, b: Column) -> Column:
    """Within one year; an unknown year agrees with every year."""
    return F.coalesce(F.abs(F.nullif(a, F.lit(0)) - F.nullif(b, F.lit(0))) <= 1, F.lit(True))


def per_claim_limit(need: Column, claim_type: Column) -> Column:
    return (F.when((need == "REQUIRED") & (claim_type == "CURRENT_STATE"), F.lit(MAX_PER_CLAIM["systematic"]))
            .when(need == "REQUIRED", F.lit(MAX_PER_CLAIM["contested"]))
            .otherwise(F.lit(MAX_PER_CLAIM["default"])))


def gate_reason(score: Column, verdict: Column, level: Column, threshold: float) -> Column:
    """Null when the pair may be cited, else the first gate that stops it."""
    return (F.when(F.coalesce(score, F.lit(0.0)) < threshold, F.lit("below_threshold"))
            .when(~F.coalesce(verdict.isin(*ACCEPTED_VERDICTS), F.lit(False)), F.lit("not_verified"))
            .when(F.coalesce(level.isin(*BLOCKED_LEVELS), F.lit(False)), F.lit("blocked_level")))
