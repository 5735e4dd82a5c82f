"""Rule score, normalisation, final score, bands, reasons, score table."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, functions as F

from farewatch import constants as K


def rule_score(rules=K.RULES, cap: float = K.RULE_SCORE_CAP) -> Column:
    """Sum of points of every rule whose feature exceeds its threshold, capped."""
    total = F.lit(0.0)
    for feature, threshold, points, _ in rules:
        total = total + F.when(F.col(feature) > F.lit(threshold), F.lit(points)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(cap))


def minmax_normalise(df: DataFrame, col: str, out: str, scale: float = 100.0) -> DataFrame:
    """(x - min) / (max - min) * 100, 0.0 when the range is 0.

    min and max are scalar subqueries (one-row aggregates evaluated once),
    not a join; the caller should persist/checkpoint ``df`` first when ``col``
    is expensive.
    """
    stats = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, rng = F.col("_mm.lo"), F.col("_mm.hi") - F.col("_mm.lo")
    return (df.withColumn("_mm", stats)
            .withColumn(out, F.when(rng > 0, (F.col(col) - lo) / rng * F.lit(scale)).otherwise(F.lit(0.0)))
            .drop("_mm"))


def final_score(rule_weight: float = K.RULE_WEIGHT, ml_weight: float = K.ML_WEIGHT) -> Column:
    """R4."""
    return F.lit(rule_weight) * F.col("rule_score") + F.lit(ml_weight) * F.col("ml_score")


def risk_band(score="final_score", cuts=K.BAND_CUTS, default: str = K.BAND_DEFAULT) -> Column:
    """> 75 critical, > 50 high, > 30 medium, else low."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for cut, band in cuts:
        expr = F.when(s > cut, band) if expr is None else expr.when(s > cut, band)
    return expr.otherwise(default)


def top_reasons(rules=K.RULES) -> Column:
    """Reason texts of rules that fired, in rule order, then the ML reason."""
    items = [F.when(F.col(f) > F.lit(th), F.lit(text)) for f, th, _, text in rules if text]
    items.append(F.when(F.col("ml_score") > K.ML_REASON_THRESHOLD, F.lit(K.ML_REASON)))
    return F.array_compact(F.array(*items))


def score_features(features: DataFrame, ml: DataFrame | None = None, rule_weight: float = K.RULE_WEIGHT,
                   ml_weight: float = K.ML_WEIGHT, rules=K.RULES) -> DataFrame:
    """R1 + R4 + R5 + R6 on a feature table.

    ``ml`` is the anomaly score table (passenger keys + ``ml_score``); without
    it the ML score is 0 (use weights 1/0 for rule-only scoring).
    """
    keys = [c for c in ("upload_id", "passenger_id") if c in features.columns]
    f = features.withColumn("rule_score", rule_score(rules))
    if ml is not None:
        f = f.join(ml.select(*keys, "ml_score"), keys, "left").withColumn("ml_score", F.coalesce("ml_score", F.lit(0.0)))
    else:
        f = f.withColumn("ml_score", F.lit(0.0))
    return (f.withColumn("final_score", final_score(rule_weight, ml_weight))
            .withColumn("risk_band", risk_band())
            .withColumn("top_reasons", top_reasons(rules)))


def score_table(scored: DataFrame, scored_at: _dt.datetime | None = None) -> DataFrame:
    """Rows of the score table; run time passed in as a literal."""
    ts = F.lit(scored_at) if scored_at is not None else F.current_timestamp()
    keys = [c for c in ("upload_id",) if c in scored.columns]
    return scored.select(
        *keys, "passenger_id", "rule_score", "ml_score", "final_score", "risk_band", "top_reasons",
        (F.col("refund_close_ratio") > K.SEAT_CLOSE_RATIO_MIN).alias("seat_blocking_flag"),
        F.lit(False).alias("is_manual"),
        ts.cast("timestamp_ntz").alias("scored_at"),
    )
