"""Vector and score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WEIGHTS = {"embedding_cosine": 0.25, "entity_overlap": 0.20, "token_ratio": 0.15, "historical_alignment": 0.25, "rerank_score": 0.15}
FAST_TRACK, GAP_CONFIRM = 0.85, 0.60
ANOMALY_COSINE, ANOMALY_ENTITY = 0.85, 0.20
HISTORY_BOOST = 0.10
RRF_K = 60
CLASS_BONUS = {"FIT": 0.10, "PARTIAL_FIT": 0.05}
PRIOR_CONFIDENCE, PRIOR_OVERRIDE = 0.60, 0.15
DOC_BOOST, PRIOR_BOOST = 0.08, 0.12
QUALITY_FACTOR = {"HIGH": 1.0, "MEDIUM": 0.85}
LOW_QUALITY_FACTOR, HISTORY_FACTOR = 0.70, 1.1
REVIEW_THRESHOLD, FIT_THRESHOLD = 0.60, 0.85
SANITY_FIT_MIN = 0.50
# ----------------------------------------------------------------------------


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """By its length; a zero vector stays (MTH1)."""
    n = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    return F.transform(F.transform(F.array(n), lambda k: F.transform(_doubles(a), lambda x: x / k)), lambda x: x)[0]


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (F.lit(float(k)) + rank)


def prior_score(classification: Column, confidence: Column, override: Column) -> Column:
    """(MTH6)"""
    bonus = F.lit(0.0)
    for name, value in CLASS_BONUS.items():
        bonus = F.when(classification == name, value).otherwise(bonus)
    return F.least(F.lit(1.0), bonus + PRIOR_CONFIDENCE * confidence + F.when(override, PRIOR_OVERRIDE).otherwise(0.0))


def composite(signals: dict[str, Column], has_fit_prior: Column) -> Column:
    """Weighted sum, a boost where a prior fits, within 0 and 1 (MTH10, AGG16)."""
    total = sum((signals[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.lit(1.0), total) + F.when(has_fit_prior, HISTORY_BOOST).otherwise(0.0)))


def route(score: Column, has_history: Column) -> Column:
    """(MTH11)"""
    return F.when((score > FAST_TRACK) & has_history, "FAST_TRACK").when(score >= GAP_CONFIRM, "DEEP_REASON").otherwise("GAP_CONFIRM")


def anomaly(cos: Column, overlap: Column) -> Column:
    """(FLT13)"""
    return F.when((cos > ANOMALY_COSINE) & (overlap < ANOMALY_ENTITY), F.format_string("high cosine (%.2f) but low entity overlap (%.2f)", cos.cast("double"), overlap.cast("double")))


def calibrated(rerank: Column, quality: Column, has_history: Column) -> Column:
    """(MTH9)"""
    factor = F.lit(LOW_QUALITY_FACTOR)
    for name, value in QUALITY_FACTOR.items():
        factor = F.when(quality == name, value).otherwise(factor)
    return F.least(F.lit(1.0), rerank * factor * F.when(has_history, HISTORY_FACTOR).otherwise(1.0))


def sane_verdict(classification: Column, top: Column, fit_threshold: float = FIT_THRESHOLD) -> Column:
    """(MTH12)"""
    return F.when((classification == "FIT") & (top < SANITY_FIT_MIN), "PARTIAL_FIT").when((classification == "GAP") & (top > fit_threshold), "REVIEW_REQUIRED").otherwise(classification)


def percent(done: Column, total: Column) -> Column:
    """Half-even percent; 0 for an empty total (MTH13)."""
    return F.when(total > 0, F.bround(done * 100.0 / total).cast("int")).otherwise(0)


def seconds(ms: Column) -> Column:
    """Milliseconds as whole seconds, halves up (MTH14)."""
    return half_up(ms / 1000)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sanity_flags(v: Column, confidence: Column, top: Column, has_match: Column, anomalies: Column, caveats: Column, has_steps: Column, fit: float = FIT_THRESHOLD, review: float = REVIEW_THRESHOLD) -> Column:
    """Flags of the eight rules, in rule order (FLT12)."""
    rules = [
        (has_match & (v == "GAP") & (confidence > fit), "high_confidence_gap"),
        (has_match & (v == "FIT") & (top < review), "low_score_fit"),
        (v == "REVIEW_REQUIRED", "llm_schema_retry_exhausted"),
        (~v.isin("GAP", "REVIEW_REQUIRED") & (confidence < review), "low_confidence"),
        (v == "GAP", "gap_review"),
        (has_match & anomalies, "phase3_anomaly"),
        (F.contains(F.coalesce(caveats, F.lit("")), F.lit("G11:")), "response_pii_leak"),
        ((v == "PARTIAL_FIT") & ~has_steps, "partial_fit_no_config"),
    ]
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda x: x.isNotNull())
