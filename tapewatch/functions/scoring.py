"""Scores, severities, agreement, evidence and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewatch.schemas import EVIDENCE, STREAMING_SOURCES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.85, "CRITICAL").when(s >= 0.65, "HIGH").when(s >= 0.40, "MEDIUM").otherwise("LOW")


SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def severity_rank(label) -> Column:
    s = _c(label)
    return F.when(s == "CRITICAL", 3).when(s == "HIGH", 2).when(s == "MEDIUM", 1).otherwise(0)


def combined_score(if_score, mp_score) -> Column:
    """0.6 forest + 0.4 classifier, or the one that exists. Null if neither does."""
    a, b = _c(if_score), _c(mp_score)
    return F.coalesce(F.round(0.6 * a + 0.4 * b, 4), F.round(a, 4), F.round(b, 4))


def is_anomaly(score, threshold: float = 0.7) -> Column:
    return _c(score) >= threshold


def is_scored_alert(score, sentinel) -> Column:
    return _c(score).isNotNull() & _c(sentinel).isNull()


def low_confidence(source) -> Column:
    return ~F.coalesce(F.upper(_c(source)), F.lit("UNKNOWN")).isin(*STREAMING_SOURCES)


def coverage_code(has_model, has_baseline, low) -> Column:
    """Why a tick could not be scored; null when it could."""
    m, b, l = _c(has_model), _c(has_baseline), _c(low)
    return (F.when(~m & l, "model_unavailable").when(~m, "no_model_high_confidence")
            .when(~b & l, "baseline_unavailable").when(~b, "no_baseline_high_confidence"))


def baseline_valid(mean, std) -> Column:
    m, s = _c(mean).cast("double"), _c(std).cast("double")
    huge = F.lit(float("inf"))
    return F.coalesce(~F.isnan(m) & ~F.isnan(s) & (F.abs(m) < huge) & (s < huge) & (s > 0), F.lit(False))


def against_baseline(x, mean, std) -> Column:
    return F.when(baseline_valid(mean, std), F.try_divide(_c(x) - _c(mean), _c(std)))


def agreement_live(if_score, mp_score, floor: float = 0.6) -> Column:
    """1 when both scores reach the floor, 0.5 when any exists, null when none does."""
    a, b = _c(if_score), _c(mp_score)
    return F.when((a >= floor) & (b >= floor), 1.0).when(a.isNotNull() | b.isNotNull(), 0.5)


def agreement_detectors(flag_a, flag_b) -> Column:
    """1 both flagged, 0.5 one flagged, 0 none."""
    a, b = _c(flag_a).cast("int"), _c(flag_b).cast("int")
    return F.when(a + b == 2, 1.0).when(a + b == 1, 0.5).otherwise(0.0)


def agreement_strict(flag_a, flag_b) -> Column:
    """1 only when both flagged, else 0."""
    return F.when((_c(flag_a).cast("int") + _c(flag_b).cast("int")) == 2, 1.0).otherwise(0.0)


def _falling(scores: Column) -> Column:
    return F.sort_array(F.map_values(scores), asc=False)


def top_scores(scores) -> tuple[Column, Column]:
    """Largest and second largest value of a score map."""
    v = _falling(_c(scores))
    return F.get(v, 0), F.get(v, 1)


def best_pattern(scores) -> Column:
    """Key with the largest value; the first in map order wins a tie."""
    m = _c(scores)
    return F.get(F.filter(F.map_keys(m), lambda k: F.element_at(m, k) == F.array_max(F.map_values(m))), 0)


def label_confidence(scores, agreement) -> Column:
    """top1/(top1+top2+1e-9), scaled by agreement; the single score when there is one pattern."""
    m, g = _c(scores), _c(agreement)
    a, b = top_scores(m)
    ratio = F.round(a / (a + b + 1e-9), 4)
    many = F.when(g.isNull(), ratio).otherwise(F.round(ratio * g, 4))
    return F.when(F.size(m) > 1, many).when(F.size(m) == 1, F.round(a, 4))


def _spoken(pattern: Column) -> Column:
    return F.replace(F.upper(pattern), F.lit("_"), F.lit(" "))


def primary_signal(scores, score, floor: float = 0.5) -> Column:
    m = _c(scores)
    top = F.array_max(F.map_values(m))
    with_patterns = F.when((top >= floor) & (top > 0), _spoken(best_pattern(m))).otherwise("ANOMALY")
    return (F.when(m.isNotNull(), with_patterns)
            .when(_c(score) >= floor, "UNCLASSIFIED").otherwise("NORMAL"))


def search_signal(scores, floor: float = 0.5) -> Column:
    """Signal text used in search hits: ANOMALY unless a pattern reaches the floor."""
    m = _c(scores)
    top = F.array_max(F.map_values(m))
    return F.when(top >= floor, _spoken(best_pattern(m))).otherwise("ANOMALY")


def pattern_label(scores) -> Column:
    """Top pattern without a floor."""
    m = _c(scores)
    return F.when(m.isNotNull() & (F.size(m) > 0), _spoken(best_pattern(m))).otherwise("ANOMALY")


def _signal(name: str, value: Column, threshold: float) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                    F.lit(float(threshold)).alias("threshold"), F.lit(True).alias("triggered"))


def _kept(signals: list[Column]) -> Column:
    return F.filter(F.array(*signals), lambda s: s.isNotNull()).cast(EVIDENCE)


# Evidence thresholds.
ABSOLUTE_LIMITS = {"return": 0.02, "log_return": 0.02, "rolling_return_5d": 0.05, "rolling_return_10d": 0.10,
                   "price_momentum": 0.05}
VOLUME_RATIO_LIMIT = 1.5
VOLATILITY_LIMIT = 0.05
RSI_HIGH, RSI_LOW = 70.0, 30.0
SCORE_LIMIT = 0.65
TRAINING_VOLUME_RATIO, TRAINING_VOLATILITY, TRAINING_RETURN = 1.5, 0.8, 0.05


def evidence(if_score=None, mp_score=None, feature=F.col, dual: Column | None = None) -> Column:
    """Triggered signals in fixed feature order. ``feature`` maps a name to its column."""
    found = []
    for name, limit in ABSOLUTE_LIMITS.items():
        v = feature(name)
        found.append(F.when(F.abs(v) > limit, _signal(f"high_{name}", v, limit)))
    ratio, vol, rsi = feature("volume_ratio_20d"), feature("volatility_20d"), feature("rsi_14d")
    found += [
        F.when(ratio > VOLUME_RATIO_LIMIT, _signal("volume_ratio_20d_spike", ratio, VOLUME_RATIO_LIMIT)),
        F.when(vol > VOLATILITY_LIMIT, _signal("high_volatility_20d", vol, VOLATILITY_LIMIT)),
        F.when(rsi > RSI_HIGH, _signal("rsi_14d_overbought", rsi, RSI_HIGH))
        .when(rsi < RSI_LOW, _signal("rsi_14d_oversold", rsi, RSI_LOW)),
    ]
    if if_score is not None:
        s = _c(if_score)
        found.append(F.when(s > SCORE_LIMIT, _signal("isolation_forest_outlier", s, SCORE_LIMIT)))
    if mp_score is not None:
        s = _c(mp_score)
        found.append(F.when(s > SCORE_LIMIT, _signal("multi_pattern_classifier", s, SCORE_LIMIT)))
    if dual is not None:
        found.append(F.when(dual == 1.0, _signal("dual_detector_agreement", F.lit(1.0), 1.0)))
    return _kept(found)


def training_evidence(feature=F.col) -> Column:
    """Evidence of the weak labeller, with its own thresholds."""
    ratio, vol, ret = feature("volume_ratio_20d"), feature("volatility_20d"), feature("return")
    return _kept([
        F.when(ratio > TRAINING_VOLUME_RATIO, _signal("volume_spike", ratio, TRAINING_VOLUME_RATIO)),
        F.when(vol > TRAINING_VOLATILITY, _signal("high_volatility", vol, TRAINING_VOLATILITY)),
        F.when(F.abs(ret) > TRAINING_RETURN, _signal("large_return", ret, TRAINING_RETURN)),
    ])


def detection_result(scores, confidence, score, agreement, source, signals) -> Column:
    return F.struct(
        F.coalesce(best_pattern(scores), F.lit("anomaly")).alias("label"),
        F.coalesce(_c(confidence), F.lit(0.0)).alias("confidence"), _c(score).alias("detector_score"),
        F.coalesce(_c(agreement), F.lit(0.0)).alias("detector_agreement"), _c(source).alias("source"),
        _c(signals).alias("evidence"))


def evidence_names(signals) -> Column:
    return F.array_join(F.transform(_c(signals), lambda s: s["name"]), ",")


def z_estimate(value, threshold) -> Column:
    v, t = _c(value), _c(threshold)
    return F.when(t == 0, 0.0).otherwise((v - t) / F.nullif(t / 2, F.lit(0.0)))


def percentile_estimate(z) -> Column:
    return F.least(F.lit(99.9), 50 + _c(z) * 15)


def threshold_multiple(value, threshold) -> Column:
    v, t = _c(value), _c(threshold)
    return F.when(t > 0, v / F.nullif(t, F.lit(0.0))).otherwise(1.0)


def multiple_band(multiple) -> Column:
    m = _c(multiple)
    return F.when(m >= 2.5, "HIGH").when(m >= 1.5, "MEDIUM").otherwise("LOW")


def correlation_band(r) -> Column:
    x = _c(r)
    return (F.when(x >= 0.7, "strong_positive").when(x >= 0.4, "positive").when(x >= 0.1, "weak_positive")
            .when(x >= -0.1, "none").when(x >= -0.4, "weak_negative").otherwise("negative"))


def case_headline_severity(max_score) -> Column:
    s = F.greatest(F.coalesce(_c(max_score), F.lit(0.6)), F.lit(0.6))
    return F.when(s >= 0.85, "CRITICAL").when(s >= 0.7, "HIGH").otherwise("MEDIUM")


def case_risk_rank(label, score) -> Column:
    """Rank of one anomaly in the case roll-up; its cut-offs differ from ``severity``."""
    l, s = _c(label), F.coalesce(_c(score), F.lit(0.0))
    return (F.when((l == "CRITICAL") | (s >= 0.85), 3).when((l == "HIGH") | (s >= 0.70), 2)
            .when((l == "MEDIUM") | (s >= 0.50), 1).otherwise(0))


def rank_label(rank) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITY_RANK]), _c(rank) + 1)


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(_c(z), F.lit(500.0)), F.lit(-500.0))))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda s, v: s + v))


EULER_GAMMA = 0.5772156649


def average_path(n) -> Column:
    """Expected path length of an unsuccessful search among n points."""
    m = _c(n).cast("double")
    return F.when(m <= 1, 0.0).otherwise(2 * (F.ln(F.nullif(m - 1, F.lit(0.0))) + EULER_GAMMA) - 2 * (m - 1) / m)


def isolation_score(mean_depth, n) -> Column:
    m = _c(n).cast("double")
    return F.when(m <= 1, 0.0).otherwise(F.pow(F.lit(2.0), -_c(mean_depth) / F.nullif(average_path(m), F.lit(0.0))))
