"""Filters, lookups, joins and per-passenger windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farewatch import constants as K
from farewatch.operators.risk import is_suspicious


def passenger_search(passengers: DataFrame, transactions: DataFrame, term: str,
                     band: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """case-insensitive substring on the name, or on an iin seen in the
    passenger's transactions (semi join); optional band (inner join, J6)."""
    pat = f"%{term}%"
    by_iin = (transactions.filter(F.col("iin").ilike(pat)).select(F.col("passenger_id").alias("id")))
    by_name = passengers.filter(F.col("fio_clean").ilike(pat))
    hits = by_name.unionByName(passengers.join(by_iin, "id", "left_semi")).distinct()
    if band is not None:
        if scores is None:
            raise ValueError("band filter needs scores")
        hits = passengers_by_band(hits, scores, band)
    return hits


# Pages that start further down than this are found by rank.
SHALLOW_OFFSET = 10_000
# Sub-ranges that one counting round divides a range of keys into.
PAGE_CELLS = 1024


def page(df: DataFrame, limit: int, offset: int = 0, ts: str = "op_datetime", tie: str = "id") -> DataFrame:
    """newest first, id as tie-breaker, then offset/limit.

    A top page is a TakeOrderedAndProject, which brings offset + limit rows of each
    task together; a page further down is cut out by rank first.
    """
    if offset <= SHALLOW_OFFSET:
        return df.orderBy(F.col(ts).desc(), F.col(tie)).offset(offset).limit(limit)
    return deep_page(df, limit, offset, ts, tie)


def deep_page(df: DataFrame, limit: int, offset: int, ts: str = "op_datetime", tie: str = "id") -> DataFrame:
    """F5 at any depth: only the rows between two splitters around the page are sorted.

    Rows are counted by sub-ranges of the time; the sub-ranges that hold the
    page's first and last rank are divided again until no more rows than a few pages
    are left or a sub-range is one instant, which is divided by ``tie`` (an
    integer) likewise.  Each round is one aggregation that returns ``PAGE_CELLS``
    counts.  Rows without a time come last.
    """
    keyed = df.withColumn("_k", F.coalesce(-F.unix_micros(F.col(ts).cast("timestamp")), F.lit(2**63 - 1)))
    rows, instant, skipped = _rank_slice(keyed, "_k", offset, limit)
    if instant:  # it alone holds more rows than a few pages
        rows, _, before = _rank_slice(rows.withColumn("_t", F.col(tie).cast("long")), "_t", offset - skipped, limit)
        rows, skipped = None if rows is None else rows.drop("_t"), skipped + before
    if rows is None:
        return df.limit(0)
    return rows.orderBy(F.col(ts).desc(), F.col(tie)).drop("_k").offset(offset - skipped).limit(limit)


def _rank_slice(df: DataFrame, key: str, first: int, limit: int) -> tuple[DataFrame | None, bool, int]:
    """(rows, whether they are too many of one key, rows before them): a slice of ``df`` by an integer ``key``
    that holds the ``limit`` ranks from ``first``; no rows if there are no such ranks."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n, before = ends["lo"], ends["hi"], ends["n"], 0
    if n <= first or lo is None:
        return None, False, 0
    enough = max(4 * limit, SHALLOW_OFFSET)
    while n > enough and hi > lo:
        step = (hi - lo) // PAGE_CELLS + 1
        # The distance from lo may exceed a long; a decimal holds it.
        cell = F.expr(f"cast((cast({key} AS decimal(20, 0)) - ({lo}BD)) div {step}BD AS int)")
        counts = df.where(F.col(key).between(lo, hi)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        at, kept = before, []
        for c, m in sorted(map(tuple, counts)):
            if at + m > first and at < first + limit:
                kept.append((c, m, at))
            at += m
        lo, hi, before = lo + kept[0][0] * step, min(hi, lo + (kept[-1][0] + 1) * step - 1), kept[0][2]
        left = sum(m for _, m, _ in kept)
        if left == n and len(kept) > 1:
            break  # the page itself spans these rows
        n = left
    return df.where(F.col(key).between(lo, hi)), lo == hi and n > enough, before


def upload_transactions(tx: DataFrame, upload_id: int, limit: int = 500, offset: int = 0) -> DataFrame:
    """one upload (partition-pruned when stored by upload_id), paged."""
    return page(tx.filter(F.col("upload_id") == F.lit(upload_id)), limit, offset)


def latest_n(tx: DataFrame, n: int, keys: DataFrame | None = None) -> DataFrame:
    """The n latest operations per passenger (optionally only ``keys``).

    ``row_number() <= n`` lets Spark insert a per-partition group limit before
    the shuffle, so a passenger with a third of all rows ships only n rows.
    """
    t = tx.filter(F.col("passenger_id").isNotNull())
    if keys is not None:
        t = t.join(keys, "passenger_id", "left_semi")
    w = Window.partitionBy("passenger_id").orderBy(F.col("op_datetime").desc(), F.col("id"))
    return t.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def passenger_history(tx: DataFrame, passenger_ids: DataFrame, limit: int = 100) -> DataFrame:
    """F4 batch form: transactions of many passengers, newest first, per-passenger limit."""
    return latest_n(tx, limit, passenger_ids.select("passenger_id"))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """batch point lookup (semi join); a single key is a plain filter."""
    return df.join(keys.select(key), key, "left_semi")


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def derived_flags(features: DataFrame, passengers: DataFrame, scores: DataFrame) -> DataFrame:
    """F8: entity predicates as boolean columns."""
    p = passengers.select(F.col("id").alias("passenger_id"), "fake_fio_score")
    s = scores.select("passenger_id", "risk_band", "seat_blocking_flag", F.lit(True).alias("_scored"))
    j = features.select("passenger_id", "refund_share").join(p, "passenger_id").join(s, "passenger_id", "left")
    return j.select(
        "passenger_id",
        (F.col("refund_share") >= K.REFUND_RATE_HIGH).alias("refund_rate_high"),
        (F.col("fake_fio_score") >= K.LIKELY_FAKE_IDENTITY).alias("likely_fake_identity"),
        F.coalesce(F.col("risk_band") == "critical", F.lit(False)).alias("is_critical"),
        is_suspicious().alias("is_suspicious"),
        F.col("_scored").isNotNull().alias("is_scored"),
        F.coalesce("seat_blocking_flag", F.lit(False)).alias("has_seat_blocking"),
    )


def scoring_input(tx: DataFrame, passengers: DataFrame, upload_id: int | None = None) -> DataFrame:
    """Transactions of one upload joined to their passengers (inner)."""
    t = tx if upload_id is None else tx.filter(F.col("upload_id") == F.lit(upload_id))
    p = passengers.select(F.col("id").alias("passenger_id"), "fio_clean", F.col("fake_fio_score").alias("p_fake_fio"))
    return t.join(p, "passenger_id", "inner")


def passenger_profile(passengers: DataFrame, scores: DataFrame, features: DataFrame) -> DataFrame:
    """Passengers LEFT JOIN scores LEFT JOIN features; list view shows
    unscored passengers as band 'low' with score 0.0."""
    s = scores.select(F.col("passenger_id").alias("id"), "risk_band", "final_score", "top_reasons", "is_manual")
    f = features.withColumnRenamed("passenger_id", "id")
    f = f.drop(*[c for c in f.columns if c in ("upload_id",)])
    return (passengers.join(s, "id", "left").join(f, "id", "left")
            .withColumn("risk_band", F.coalesce("risk_band", F.lit(K.BAND_DEFAULT)))
            .withColumn("final_score", F.coalesce("final_score", F.lit(0.0))))


def passengers_by_band(passengers: DataFrame, scores: DataFrame, band: str) -> DataFrame:
    """Inner join -- unscored passengers never match, not even 'low'."""
    s = scores.filter(F.col("risk_band") == band).select(F.col("passenger_id").alias("id"))
    return passengers.join(s, "id", "inner")


def passenger_page(passengers: DataFrame, transactions: DataFrame, scores: DataFrame, features: DataFrame,
                   term: str | None = None, band: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """F2 + J5 + F5: one page of the passenger list, last seen first, with score,
    features and ``total``, the number of passengers that match.

    Only the page's rows meet scores and features; the total is a scalar subquery.
    """
    hits = passengers if term is None else passenger_search(passengers, transactions, term)
    if band is not None:
        hits = passengers_by_band(hits, scores, band)
    total = hits.agg(F.count(F.lit(1))).scalar()
    shown = page(hits, limit, offset, ts="last_seen_at")
    return passenger_profile(shown, scores, features).withColumn("total", total)
