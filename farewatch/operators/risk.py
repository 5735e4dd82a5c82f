"""Risk analytics over transactions and scores.

Every suspicious count is a conditional count in the same pass as the total
(the two-scan "totals LEFT JOIN suspicious" shape is folded into one).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewatch import constants as K
from farewatch.functions.identity import concentration_id


def is_suspicious(band: str = "risk_band") -> Column:
    return F.coalesce(F.col(band).isin(*K.SUSPICIOUS_BANDS), F.lit(False))


def band_lookup(scores: DataFrame) -> DataFrame:
    """(passenger_id, risk_band) -- one narrow row per scored passenger."""
    return scores.select("passenger_id", "risk_band")


def suspicious_lookup(scores: DataFrame) -> DataFrame:
    """(passenger_id, suspicious = true) of the suspicious passengers only.

    The band filter reaches the score scan, and the side that meets the
    transactions shrinks to the few it marks.
    """
    return (scores.filter(F.col("risk_band").isin(*K.SUSPICIOUS_BANDS))
            .select("passenger_id", F.lit(True).alias("suspicious")))


def mark_suspicious(rows: DataFrame, scores: DataFrame) -> DataFrame:
    return (rows.join(suspicious_lookup(scores), "passenger_id", "left")
            .withColumn("suspicious", F.coalesce("suspicious", F.lit(False))))


def flag_transactions(tx: DataFrame, scores: DataFrame) -> DataFrame:
    """J2/J3/J4 base: transactions LEFT JOIN band, plus a suspicious flag.

    The right side has one row per passenger; AQE picks broadcast when its
    runtime size is under the threshold, else sort-merge with skew splitting
    of hot passengers on the transaction side.
    """
    return (tx.join(band_lookup(scores), "passenger_id", "left")
            .withColumn("suspicious", is_suspicious()))


def op_filters(df: DataFrame, train_no: str | None = None, cashdesk: str | None = None,
               terminal: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """F1 filter part: equality on each given attribute, inclusive time range."""
    if train_no:
        df = df.filter(F.col("train_no") == train_no)
    if cashdesk:
        df = df.filter(F.col("cashdesk") == cashdesk)
    if terminal:
        df = df.filter(F.col("terminal") == terminal)
    if date_from is not None:
        df = df.filter(F.col("op_datetime") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        df = df.filter(F.col("op_datetime") <= F.lit(date_to).cast("timestamp_ntz"))
    return df


def suspicious_operations(tx: DataFrame, scores: DataFrame, **filters) -> DataFrame:
    """F1 + J2: transactions of high/critical passengers with optional filters.

    The filters are applied to the transactions before the join so they reach
    the Parquet scan; the band filter reaches the score scan.
    """
    sus = scores.filter(F.col("risk_band").isin(*K.SUSPICIOUS_BANDS)).select("passenger_id", "risk_band")
    return op_filters(tx, **filters).join(sus, "passenger_id", "inner")


def per_passenger_ops(tx: DataFrame, scores: DataFrame) -> DataFrame:
    """(passenger_id, n, suspicious): operations per passenger with the flag.

    Partial aggregation before the shuffle; the band join then carries one
    row per passenger (a hot passenger is one row, not a third of the data).
    """
    per = tx.groupBy("passenger_id").agg(F.count("*").alias("n"))
    return mark_suspicious(per, scores)


def counts(tx: DataFrame, scores: DataFrame, **filters) -> DataFrame:
    """A5: total and suspicious operation counts in one pass (same filters on both)."""
    per = per_passenger_ops(op_filters(tx, **filters), scores)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_ops"),
                   F.coalesce(F.sum(F.when(F.col("suspicious"), F.col("n"))), F.lit(0)).cast("long").alias("suspicious_ops"))


def passenger_counts(passengers: DataFrame, scores: DataFrame) -> DataFrame:
    """A5: passengers total and per band (an unscored passenger has no band)."""
    p = passengers.select(F.col("id").alias("passenger_id")).join(band_lookup(scores), "passenger_id", "left")
    return p.agg(
        F.count("*").cast("long").alias("total_passengers"),
        *[F.count_if(F.col("risk_band") == b).cast("long").alias(f"{b}_count") for b in ("low", "medium", "high", "critical")],
    )


def risk_trend(tx: DataFrame, scores: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Per UTC day total, suspicious and share % (2 dp).

    The range limits both counts.  Transactions are first reduced to
    (passenger, day) counts -- partial aggregation before any shuffle -- so the
    join to the band table carries at most one row per passenger-day and a
    passenger holding a third of all rows becomes a handful of rows.
    """
    t = op_filters(tx, date_from=date_from, date_to=date_to)
    per_pd = (t.groupBy("passenger_id", F.date_trunc("day", "op_datetime").cast("timestamp_ntz").alias("day"))
              .agg(F.count("*").alias("n")))
    j = mark_suspicious(per_pd, scores)
    out = (j.groupBy("day")
           .agg(F.sum("n").cast("long").alias("total_ops"),
                F.sum(F.when(F.col("suspicious"), F.col("n")).otherwise(0)).cast("long").alias("highrisk_ops")))
    return out.withColumn("share", F.round(F.col("highrisk_ops") * 100.0 / F.col("total_ops"), 2))


def unpivot_dimensions(df: DataFrame, dims=K.DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (operation, dimension) with a non-null value."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension_type"), F.col(d).cast("string").alias("dimension_value"))
                      for d in dims])
    return (df.select(*keep, F.inline(pairs))
            .filter(F.col("dimension_value").isNotNull()))


def dimension_stats(flagged: DataFrame, dims=K.DIMENSIONS) -> DataFrame:
    """Per dimension value total and suspicious counts; nulls dropped.

    All dimensions in one scan + one aggregate (partial aggregation makes the
    shuffle proportional to the number of distinct values, not operations).
    """
    bad = [d for d in dims if d not in K.ALL_DIMENSIONS]
    if bad:
        raise ValueError(f"Invalid dimension column: {bad[0]}")
    u = unpivot_dimensions(flagged, dims, keep=("suspicious",))
    return (u.groupBy("dimension_type", "dimension_value")
            .agg(F.count("*").cast("long").alias("total_ops"),
                 F.count_if("suspicious").cast("long").alias("highrisk_ops")))


def risk_concentration(flagged: DataFrame, dims=K.DIMENSIONS,
                       calculated_at: _dt.datetime | None = None) -> DataFrame:
    """Share, base share and lift per dimension value.

    The base share is a scalar subquery (one-row aggregate, evaluated once);
    lift is 1.0 when the base is 0; ids are the SHA-256 fold of 'type:value'.
    """
    stats = dimension_stats(flagged, dims)
    base = flagged.agg(F.count_if("suspicious") / F.count("*")).scalar()
    return with_lift(stats, base, calculated_at)


def passenger_dim_counts(tx: DataFrame, scores: DataFrame, dims=K.DIMENSIONS) -> DataFrame:
    """Operations per (passenger, dimension values) with the passenger's flag.

    The group-by runs a partial aggregate before its shuffle, so a passenger
    holding a third of all operations leaves each map task as a handful of
    rows; the band join then sees at most one row per passenger and value
    combination instead of one per operation.
    """
    per = tx.groupBy("passenger_id", *dims).agg(F.count("*").alias("n"))
    return mark_suspicious(per, scores)


def dimension_stats_pre(tx: DataFrame, scores: DataFrame, dims=K.DIMENSIONS) -> DataFrame:
    """A7 from pre-aggregated counts (same result as ``dimension_stats``)."""
    c = passenger_dim_counts(tx, scores, dims)
    u = unpivot_dimensions(c, dims, keep=("n", "suspicious"))
    return (u.groupBy("dimension_type", "dimension_value")
            .agg(F.sum("n").cast("long").alias("total_ops"),
                 F.sum(F.when(F.col("suspicious"), F.col("n")).otherwise(0)).cast("long").alias("highrisk_ops")))


ALL_ROWS = "__all__"


def concentration(tx: DataFrame, scores: DataFrame, dims=K.DIMENSIONS,
                  calculated_at: _dt.datetime | None = None) -> DataFrame:
    """A8 over transactions + scores with pre-aggregation (the refresh that runs
    after every scoring).

    One pass: every pre-aggregated row also feeds an ``__all__`` row, so the
    base share comes out of the same aggregation.  The result (one row per
    dimension value -- small at any scale) is materialised once and the base
    is read from it, instead of a second full scan for a scalar subquery.
    """
    from farewatch.session import cut_lineage

    c = passenger_dim_counts(tx, scores, dims)
    pairs = [F.struct(F.lit(d).alias("dimension_type"), F.col(d).cast("string").alias("dimension_value")) for d in dims]
    pairs.append(F.struct(F.lit(ALL_ROWS).alias("dimension_type"), F.lit(ALL_ROWS).alias("dimension_value")))
    u = c.select("n", "suspicious", F.inline(F.array(*pairs))).filter(F.col("dimension_value").isNotNull())
    stats_all = cut_lineage(
        u.groupBy("dimension_type", "dimension_value")
        .agg(F.sum("n").cast("long").alias("total_ops"),
             F.sum(F.when(F.col("suspicious"), F.col("n")).otherwise(0)).cast("long").alias("highrisk_ops")),
        "concentration_stats")
    base = (stats_all.filter(F.col("dimension_type") == ALL_ROWS)
            .select(F.col("highrisk_ops") / F.col("total_ops")).scalar())
    return with_lift(stats_all.filter(F.col("dimension_type") != ALL_ROWS), base, calculated_at)


def with_lift(stats: DataFrame, base: Column, calculated_at) -> DataFrame:
    """Share and lift of dimension counts against the base share (a one-row value)."""
    share = F.when(F.col("total_ops") > 0, F.col("highrisk_ops") / F.col("total_ops")).otherwise(F.lit(0.0))
    ts = F.lit(calculated_at) if calculated_at is not None else F.current_timestamp()
    b = F.col("_base")
    return (stats.withColumn("_base", F.coalesce(base, F.lit(0.0)))
            .withColumn("share_highrisk_ops", share)
            .withColumn("lift_vs_base", F.when(b > 0, F.col("share_highrisk_ops") / b).otherwise(F.lit(1.0)))
            .withColumn("id", concentration_id("dimension_type", "dimension_value"))
            .withColumn("calculated_at", ts.cast("timestamp_ntz"))
            .select("id", "dimension_type", "dimension_value", "total_ops", "highrisk_ops",
                    "share_highrisk_ops", "lift_vs_base", "calculated_at"))


def hotspot_label(lift: str = "lift_vs_base") -> Column:
    """A9."""
    expr = None
    for cut, label in K.HOTSPOT_LABELS:
        expr = F.when(F.col(lift) >= cut, label) if expr is None else expr.when(F.col(lift) >= cut, label)
    return expr.otherwise(K.HOTSPOT_DEFAULT)


def top_dimension(conc: DataFrame, n: int = 1) -> DataFrame:
    """The n highest-lift values per dimension type (value breaks ties)."""
    w = Window.partitionBy("dimension_type").orderBy(F.col("lift_vs_base").desc(), F.col("dimension_value"))
    return conc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def concentration_list(conc: DataFrame, dimension_type: str | None = None) -> DataFrame:
    """Per type, lift descending, share and lift rounded to 2."""
    c = conc if dimension_type is None else conc.filter(F.col("dimension_type") == dimension_type.lower())
    return (c.select("dimension_type", "dimension_value", "total_ops", "highrisk_ops",
                     F.round("share_highrisk_ops", 2).alias("share_highrisk_ops"),
                     F.round("lift_vs_base", 2).alias("lift_vs_base"),
                     F.col("lift_vs_base").alias("_lift"))
            .orderBy("dimension_type", F.col("_lift").desc(), "dimension_value").drop("_lift"))


def chart_slices(conc: DataFrame, top_channels: int = K.CHART_TOP_CHANNELS,
                 top_terminals: int = K.CHART_TOP_TERMINALS) -> DataFrame:
    """Top channels by share % and top terminals by (lift - 1) * 100.

    Both come from the lift-ordered lists; values are computed from unrounded
    share/lift (share % to 1 dp, lift % to 0 dp).
    """
    ranked = top_dimension(conc.filter(F.col("dimension_type").isin("channel", "terminal")),
                           max(top_channels, top_terminals))
    ch = (ranked.filter((F.col("dimension_type") == "channel") & (F.col("rank") <= top_channels))
          .select(F.lit("channel_share_pct").alias("slice"), "rank", "dimension_value",
                  F.round(F.col("share_highrisk_ops") * 100, 1).alias("value")))
    te = (ranked.filter((F.col("dimension_type") == "terminal") & (F.col("rank") <= top_terminals))
          .select(F.lit("terminal_lift_pct").alias("slice"), "rank", "dimension_value",
                  F.round((F.col("lift_vs_base") - 1) * 100, 0).alias("value")))
    return ch.unionByName(te)


def dashboard_summary(passengers: DataFrame, scores: DataFrame, tx: DataFrame,
                      conc: DataFrame) -> DataFrame:
    """A10: one row; every measure is a scalar subquery over its own table.

    ``tx`` are the transactions (or already flagged transactions)."""
    pc = passenger_counts(passengers, scores)
    if "suspicious" in tx.columns:
        ops = tx.agg(F.struct(F.count("*").alias("t"), F.count_if("suspicious").alias("s"))).scalar()
    else:
        per = per_passenger_ops(tx, scores)
        ops = per.agg(F.struct(F.sum("n").alias("t"),
                               F.coalesce(F.sum(F.when(F.col("suspicious"), F.col("n"))), F.lit(0)).alias("s"))).scalar()
    t, s = ops.getField("t"), ops.getField("s")
    top = top_dimension(conc.filter(F.col("dimension_type").isin("channel", "terminal")), 1)
    top_ch = top.filter(F.col("dimension_type") == "channel").select("dimension_value").scalar()
    top_te = top.filter(F.col("dimension_type") == "terminal").select("dimension_value").scalar()
    return pc.select(
        "total_passengers",
        F.col("high_count").alias("high_risk_count"),
        F.col("critical_count").alias("critical_risk_count"),
        F.when(t > 0, F.round(s * 100.0 / t, 2)).otherwise(F.lit(0.0)).alias("share_suspicious_ops"),
        top_ch.alias("top_risk_channel"),
        top_te.alias("top_risk_terminal"),
    )
