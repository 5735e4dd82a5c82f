"""Append-only status ledgers (L1-L3) and upload processing summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farewatch import constants as K


def _allowed(prev: Column, cur: Column, transitions: dict[str, tuple[str, ...]]) -> Column:
    expr = F.lit(False)
    for src, dsts in transitions.items():
        expr = F.when(prev == src, cur.isin(*dsts)).otherwise(expr)
    return expr


# Consecutive events that are folded together before their summaries are.
SLICE_EVENTS = 4096


def _compose(parts: Column, transitions: dict[str, tuple[str, ...]]) -> Column:
    """Fold ordered summaries (first, last, illegal) of neighbouring event ranges into one.

    A range maps the status before it to (last status, illegal transitions); such
    maps compose, so ranges can be folded anywhere and in any grouping.
    """
    text = F.lit(None).cast("string")
    zero = F.struct(F.lit(False).alias("some"), text.alias("first"), text.alias("last"), F.lit(0).cast("long").alias("illegal"))

    def merge(acc: Column, x: Column) -> Column:
        broken = acc["some"] & F.coalesce(acc["last"].isNotNull() & ~_allowed(acc["last"], x["first"], transitions), F.lit(False))
        return F.struct(F.lit(True).alias("some"), F.when(acc["some"], acc["first"]).otherwise(x["first"]).alias("first"),
                        x["last"].alias("last"), (acc["illegal"] + x["illegal"] + broken.cast("long")).alias("illegal"))

    return F.aggregate(parts, zero, merge)


def fold_status(events: DataFrame, key: str, transitions: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per entity: latest status, event count, illegal transitions.

    The events are put in order by one range exchange; at most ``SLICE_EVENTS``
    neighbours of an entity are folded to a summary, then an entity's summaries
    in order.  No task holds all events of an entity, however many it has.
    """
    order = [F.col(key), F.col("ts"), F.col("seq"), F.col("status")]
    placed = (events.select(key, "ts", "seq", "status").repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("at", F.monotonically_increasing_id()))
    event = F.struct("at", F.col("status").alias("first"), F.col("status").alias("last"), F.lit(0).cast("long").alias("illegal"))
    slices = (placed.groupBy(key, F.expr(f"at div {SLICE_EVENTS}").alias("slice"))
              .agg(F.array_sort(F.collect_list(event)).alias("parts"), F.count("*").alias("n"),
                   F.min("ts").alias("lo"), F.max("ts").alias("hi"))
              .withColumn("fold", _compose(F.col("parts"), transitions)))
    part = F.struct("slice", F.col("fold.first").alias("first"), F.col("fold.last").alias("last"), F.col("fold.illegal").alias("illegal"))
    return (slices.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("n").alias("n_events"),
                                    F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))
            .withColumn("fold", _compose(F.col("parts"), transitions))
            .select(key, F.col("fold.last").alias("status"), "n_events", F.col("fold.illegal").alias("illegal_transitions"),
                    "first_ts", "last_ts"))


def upload_status(events: DataFrame) -> DataFrame:
    """L1: pending -> (processing) -> done | failed."""
    return fold_status(events, "upload_id", K.UPLOAD_TRANSITIONS)


def job_status(events: DataFrame) -> DataFrame:
    """L2: status, start, finish of the latest terminal event, duration, last error."""
    base = fold_status(events, "job_id", K.JOB_TRANSITIONS)
    order = F.struct("ts", "seq")
    term = F.col("status").isin("done", "failed")
    extra = (events.groupBy("job_id")
             .agg(F.max_by(F.when(term, F.col("ts")), F.when(term, order)).alias("finished_at"),
                  F.max_by(F.when(F.col("status") == "failed", F.col("error")),
                           F.when(F.col("status") == "failed", order)).alias("error_message")))
    j = base.join(extra, "job_id")
    finished = F.when(F.col("status").isin("done", "failed"), F.col("finished_at"))
    return j.select(
        "job_id", "status", F.col("first_ts").alias("started_at"), finished.alias("finished_at"),
        (F.timestamp_diff("MICROSECOND", F.col("first_ts"), finished).cast("double") / 1e6).alias("duration_sec"),
        "error_message", "n_events", "illegal_transitions")


NO_GOOD_ROWS = "no valid rows"


def upload_outcomes(uploads: DataFrame, headers: DataFrame, typed: DataFrame) -> DataFrame:
    """Outcome of an ingest per upload: status, error, rows_read, parse_errors.

    An upload without a header row, or without a single good row, has failed;
    every upload of ``uploads`` has one row.
    """
    per = typed.groupBy("upload_id").agg(F.count(F.lit(1)).alias("rows_read"),
                                         F.count_if(F.col("error").isNotNull()).alias("parse_errors"))
    j = (uploads.select("upload_id").join(headers.select("upload_id", "header_error"), "upload_id", "left")
         .join(per, "upload_id", "left"))
    read, bad = (F.coalesce(c, F.lit(0)).cast("long") for c in ("rows_read", "parse_errors"))
    error = F.coalesce(F.col("header_error"), F.when(read == bad, F.lit(NO_GOOD_ROWS)))
    return j.select("upload_id", F.when(error.isNull(), "done").otherwise("failed").alias("status"), error.alias("error"),
                    read.alias("rows_read"), bad.alias("parse_errors"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """L3: audit rows per action and UTC day."""
    return (audit.groupBy("action", F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"))
            .agg(F.count("*").cast("long").alias("n"), F.countDistinct("user_id").cast("long").alias("users")))


def audit_filter(audit: DataFrame, action: str | None = None, user_id: int | None = None,
                 entity_type: str | None = None, entity_id: str | None = None, date_from=None, date_to=None,
                 limit: int | None = 100, offset: int = 0) -> DataFrame:
    """filters compose; newest first; pages of 1..1000 rows (other sizes are refused), ``None`` for all rows."""
    if limit is not None and not 1 <= limit <= K.AUDIT_PAGE_MAX:
        raise ValueError(f"page size {limit} is not in 1..{K.AUDIT_PAGE_MAX}")
    df = audit
    if action:
        df = df.filter(F.col("action") == action)
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if entity_type and entity_id:
        df = df.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
    if date_from is not None:
        df = df.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        df = df.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    ordered = df.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered if limit is None and not offset else ordered.offset(offset) if limit is None else ordered.offset(offset).limit(limit)


def upload_summary(typed: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per upload parsed rows, row errors, loaded transactions, passengers."""
    errs = typed.groupBy("upload_id").agg(
        F.count("*").cast("long").alias("rows_read"),
        F.count_if(F.col("error").isNotNull()).cast("long").alias("parse_errors"))
    loaded = transactions.groupBy("upload_id").agg(
        F.count("*").cast("long").alias("transactions_loaded"),
        F.countDistinct("passenger_id").cast("long").alias("passengers_upserted"))
    return errs.join(loaded, "upload_id", "left").select(
        "upload_id", "rows_read", "parse_errors",
        F.coalesce("transactions_loaded", F.lit(0).cast("long")).alias("transactions_loaded"),
        F.coalesce("passengers_upserted", F.lit(0).cast("long")).alias("passengers_upserted"))
