"""Per-passenger behavioural features (P16-P18 applied, A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewatch import constants as K
from farewatch.functions import timeflags as TF


def with_time_flags(tx: DataFrame, night: str = "scoring", late: str = "scoring") -> DataFrame:
    """Add hours_to_departure, is_night and late_refund columns."""
    return (tx.withColumn("hours_to_departure", TF.hours_to_departure())
            .withColumn("is_night", TF.night_flag(definition=night))
            .withColumn("late_refund", TF.late_refund_flag(definition=late)))


def _scope_keys(scope: str) -> list[str]:
    if scope == "all":
        return ["passenger_id"]
    if scope == "upload":
        return ["upload_id", "passenger_id"]
    raise ValueError(f"scope must be 'all' or 'upload', got {scope!r}")


def passenger_features(transactions: DataFrame, passengers: DataFrame, scope: str = "all",
                       upload_id: int | None = None, night: str = "scoring",
                       late: str = "scoring") -> DataFrame:
    """J1 + A1.  Transactions are aggregated per passenger first (partial +
    final hash aggregate) and only then joined to passengers for the name
    score, so the join sees one row per passenger instead of one per ticket.
    The inner join drops transactions without a known passenger, as before.
    """
    tx = transactions
    if upload_id is not None:
        tx = tx.filter(F.col("upload_id") == F.lit(upload_id))
    keys = _scope_keys(scope)
    agg = (with_time_flags(tx, night, late).filter(F.col("passenger_id").isNotNull())
           .groupBy(*keys)
           .agg(F.count("*").cast("long").alias("total_tickets"),
                F.count_if(F.lower("op_type") == "refund").cast("long").alias("refund_cnt"),
                F.count_if("is_night").cast("long").alias("night_tickets"),
                F.count_if("late_refund").cast("long").alias("late_refunds")))
    p = passengers.select(F.col("id").alias("passenger_id"), F.col("fake_fio_score").alias("fake_fio"))
    t = F.col("total_tickets").cast("double")
    return (agg.join(p, "passenger_id", "inner")
            .withColumn("refund_share", F.col("refund_cnt") / t)
            .withColumn("night_share", F.col("night_tickets") / t)
            .withColumn("refund_close_ratio", F.col("late_refunds") / (F.col("refund_cnt") + K.CLOSE_RATIO_EPS)))


def peak_features(transactions: DataFrame, scope: str = "all") -> DataFrame:
    """A2: busiest month, departure day and train per passenger.

    Two-level aggregation: counts per (passenger, bucket), then max per
    passenger.  Rows without a departure time / train do not form buckets.
    """
    keys = _scope_keys(scope)
    tx = transactions.filter(F.col("passenger_id").isNotNull())
    # One scan: every row contributes to three (kind, bucket) counters.
    buckets = F.array(
        F.struct(F.lit("m").alias("kind"), F.date_format(F.date_trunc("month", "op_datetime"), "yyyy-MM").alias("b")),
        F.struct(F.lit("d").alias("kind"), F.to_date("dep_datetime").cast("string").alias("b")),
        F.struct(F.lit("t").alias("kind"), F.col("train_no").alias("b")),
    )
    counts = (tx.select(*keys, F.inline(buckets))
              .groupBy(*keys, "kind", "b").agg(F.count_if(F.col("b").isNotNull()).alias("n")))
    return (counts.groupBy(*keys)
            .agg(F.max(F.when(F.col("kind") == "m", F.col("n"))).alias("m"),
                 F.max(F.when(F.col("kind") == "d", F.col("n"))).alias("d"),
                 F.max(F.when(F.col("kind") == "t", F.col("n"))).alias("t"))
            .select(*keys,
                    F.coalesce("m", F.lit(0)).cast("int").alias("max_tickets_month"),
                    F.coalesce("d", F.lit(0)).cast("int").alias("max_tickets_same_depday"),
                    F.coalesce("t", F.lit(0)).cast("double").alias("tickets_per_train_peak")))


def seat_blocking(features: DataFrame, min_same_day: int = K.SEAT_SAME_DEPDAY_MIN,
                  min_close: float = K.SEAT_CLOSE_RATIO_MIN) -> DataFrame:
    """A3: feature flag (>= both thresholds) and score flag (close ratio > 0.6)."""
    return (features
            .withColumn("seat_blocking_feature",
                        (F.col("max_tickets_same_depday") >= min_same_day) & (F.col("refund_close_ratio") >= min_close))
            .withColumn("seat_blocking_flag", F.col("refund_close_ratio") > min_close))


def bucket_counts(transactions: DataFrame, scope: str = "all") -> DataFrame:
    """Sums per passenger and (kind, bucket) that add up over any parts of the transactions.

    Every row feeds three counters: its month (which also carries the A1
    counts, as each row has exactly one), departure day and train.
    """
    keys = _scope_keys(scope)
    tx = with_time_flags(transactions).filter(F.col("passenger_id").isNotNull())
    refund = (F.lower("op_type") == "refund").cast("int")
    buckets = F.array(
        F.struct(F.lit("m").alias("kind"), F.date_format(F.date_trunc("month", "op_datetime"), "yyyy-MM").alias("b"),
                 refund.alias("r"), F.col("is_night").cast("int").alias("nt"), F.col("late_refund").cast("int").alias("lt")),
        F.struct(F.lit("d").alias("kind"), F.to_date("dep_datetime").cast("string").alias("b"),
                 F.lit(0).alias("r"), F.lit(0).alias("nt"), F.lit(0).alias("lt")),
        F.struct(F.lit("t").alias("kind"), F.col("train_no").alias("b"),
                 F.lit(0).alias("r"), F.lit(0).alias("nt"), F.lit(0).alias("lt")),
    )
    return (tx.select(*keys, F.inline(buckets))
            .groupBy(*keys, "kind", "b")
            .agg(F.count("*").alias("n_all"), F.count_if(F.col("b").isNotNull()).alias("n"),
                 F.sum("r").alias("r"), F.sum("nt").alias("nt"), F.sum("lt").alias("lt")))


def features_from_buckets(per_bucket: DataFrame, passengers: DataFrame, scope: str = "all") -> DataFrame:
    """A1 + A2 + A3 from ``bucket_counts``, whose (passenger, kind, bucket) must be unique."""
    keys = _scope_keys(scope)
    m = F.col("kind") == "m"
    agg = (per_bucket.groupBy(*keys).agg(
        F.sum(F.when(m, F.col("n_all"))).cast("long").alias("total_tickets"),
        F.sum(F.when(m, F.col("r"))).cast("long").alias("refund_cnt"),
        F.sum(F.when(m, F.col("nt"))).cast("long").alias("night_tickets"),
        F.sum(F.when(m, F.col("lt"))).cast("long").alias("late_refunds"),
        F.coalesce(F.max(F.when(m, F.col("n"))), F.lit(0)).cast("int").alias("max_tickets_month"),
        F.coalesce(F.max(F.when(F.col("kind") == "d", F.col("n"))), F.lit(0)).cast("int").alias("max_tickets_same_depday"),
        F.coalesce(F.max(F.when(F.col("kind") == "t", F.col("n"))), F.lit(0)).cast("double").alias("tickets_per_train_peak"),
    ))
    p = passengers.select(F.col("id").alias("passenger_id"), F.col("fake_fio_score").alias("fake_fio"))
    t = F.col("total_tickets").cast("double")
    f = (agg.join(p, "passenger_id", "inner")
         .withColumn("refund_share", F.col("refund_cnt") / t)
         .withColumn("night_share", F.col("night_tickets") / t)
         .withColumn("refund_close_ratio", F.col("late_refunds") / (F.col("refund_cnt") + K.CLOSE_RATIO_EPS)))
    return seat_blocking(f)


def full_features(transactions: DataFrame, passengers: DataFrame, scope: str = "all") -> DataFrame:
    """A1 + A2 + A3 as stored in the feature table, from ONE scan of the
    transactions: per-bucket sums, then totals and peaks per passenger."""
    return features_from_buckets(bucket_counts(transactions, scope), passengers, scope)
