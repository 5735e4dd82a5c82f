"""Structured Streaming forms of the pipeline.

Every micro-batch is idempotent: a batch re-run after a failure re-derives
the same ids (inserts ignore them), rewrites the same pending set and skips
error rows already written.

T1  incremental upload ingest: file stream of sheet cells -> foreachBatch ->
    lifecycle of each upload (first positions, settled header, status) ->
    typing -> insert-ignore transactions / upsert passengers.  Rows of an upload
    wait until its header is certain, so that any order of arrival stores what
    the batch job stores; an upload that gets no more rows ends done or failed.
T2  duplicate suppression: each batch inserts the ids that are not stored yet.
T3  streaming daily trend: each batch's day counts are kept under its batch
    number; the trend is their sum.

All sinks are files in the shared store.  Every stream has one checkpoint per
store, so runs with ``availableNow`` drain the new input and stop; batches can
be retried at any point (deterministic ids, overwritten deltas and pending rows,
lifecycle replaced last).
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farewatch import constants as K
from farewatch import schemas as S
from farewatch.operators import ledger as LG
from farewatch.operators import risk as RK
from farewatch.operators import upsert as UP
from farewatch.plans import jobs as JB
from farewatch.plans.store import TableStore
from farewatch.session import bounded_broadcast, cut_lineage
from farewatch.sources import uploads as UPL


def _ckpt(store: TableStore, name: str) -> str:
    """One checkpoint per stream and store: a later run goes on where the last one ended."""
    return os.path.join(store.root, "_streams", name)


def _drain(query) -> None:
    query.awaitTermination()
    exc = query.exception()
    if exc is not None:
        raise RuntimeError(str(exc))


# ---------------------------------------------------------------------------
# T1
# ---------------------------------------------------------------------------

# What is known of an upload while its rows arrive, one row per upload.  ``heads`` are
# its first positions, kept until the header is settled; ``columns`` the header's names.
LIFECYCLE = ("upload_id long, last_arrival timestamp_ntz, filled boolean, heads array<struct<row_num: bigint, cells: array<string>>>, "
             "header_row long, columns map<string, int>, status string")
OUTCOMES = "upload_id long, status string, error string, rows_read long, parse_errors long"
# Time without a new row after which an open upload may be closed.
PATIENCE = _dt.timedelta(hours=1)
PENDING = UPL.CELLS_SCHEMA + ", batch long"


def _merged_heads() -> Column:
    """Stored first positions and those of the batch; a position that comes again keeps its first cells."""
    old = F.coalesce("heads", F.array().cast("array<struct<row_num: bigint, cells: array<string>>>"))
    new = F.coalesce("new_heads", F.array().cast("array<struct<row_num: bigint, cells: array<string>>>"))
    fresh = F.filter(new, lambda x: ~F.exists(old, lambda y: y["row_num"] == x["row_num"]))
    return F.array_sort(F.concat(old, fresh))


def settle_headers(uploads: DataFrame) -> DataFrame:
    """(upload_id, header_row, columns, header_error, certain) from the known first positions of ``uploads`` (upload_id, heads).

    A header is certain once every position up to it is known: no row that is
    still to come can precede it.
    """
    heads = uploads.select("upload_id", F.inline("heads"))
    rows = cut_lineage(UPL.sheet_rows(heads), "stream-heads")
    found = UPL.discover_headers(rows)
    names = (UPL.column_map(rows, found).filter(F.col("canonical").isin(*K.SHEET_COLUMNS)).groupBy("upload_id")
             .agg(F.map_from_entries(F.collect_list(F.struct("canonical", F.col("idx").cast("int")))).alias("columns")))
    known = F.size(F.filter("heads", lambda x: x["row_num"] <= F.col("header_row")))
    nothing = F.lit("missing required columns: " + ", ".join(sorted(K.REQUIRED_COLUMNS)))
    return (uploads.select("upload_id", "heads").join(found, "upload_id", "left").join(names, "upload_id", "left")
            .select("upload_id", "header_row", "columns",
                    F.when(F.col("header_row").isNull(), F.coalesce("header_error", nothing)).alias("header_error"),
                    F.coalesce(known == F.col("header_row"), F.lit(False)).alias("certain")))


def _pending(store: TableStore, uploads: DataFrame) -> DataFrame:
    """Rows of earlier batches that wait for the header of one of ``uploads``; reads only their folders."""
    rows = store.read_log("pending_rows", PENDING)
    if rows is None:
        return store.spark.createDataFrame([], UPL.CELLS_SCHEMA)
    return rows.join(bounded_broadcast(uploads.select("upload_id")), "upload_id", "left_semi").select("upload_id", "row_num", "cells")


def _ingest_ready(store: TableStore, rows: DataFrame, headers: DataFrame, **kw) -> None:
    """Type the data rows of uploads with a settled header (upload_id, header_row, columns) and store them once."""
    typed = cut_lineage(UPL.type_rows(UPL.pick_columns(UPL.sheet_rows(rows), headers)), "stream-typed")
    good, bad = UPL.split_errors(typed)
    store.append_once("row_errors", bad, ["upload_id", "row_num"], "upload_id long, row_num long, error string")
    JB.ingest_typed(store, good, **kw)


def ingest_cells_batch(store: TableStore, batch_cells: DataFrame, epoch: int = 0, now: _dt.datetime | None = None,
                       user_id: int | None = None, **kw) -> None:
    """One micro-batch of sheet cells (any mix of uploads and rows).

    Rows of an upload go out once its header is certain; until then they wait in
    a folder of their batch and upload.  A row that comes again is stored once.
    The lifecycle is written last: a batch that is run again after a failure
    finds the state from before it, or adds nothing.
    """
    now = F.lit(now or JB._now()).cast("timestamp_ntz")
    batch = cut_lineage(batch_cells.select("upload_id", "row_num", "cells"), "stream-cells")
    arrived = cut_lineage(batch.groupBy("upload_id").agg(
        F.bool_or(F.exists("cells", lambda c: c.isNotNull())).alias("new_filled"),
        F.array_sort(F.collect_set(F.when(F.col("row_num") <= K.HEADER_SEARCH_ROWS, F.struct("row_num", "cells")))).alias("all_heads")),
        "stream-arrived")
    # Of a position repeated within the batch the first in order stays.
    first = F.filter("all_heads", lambda x, i: (i == 0) | (x["row_num"] != F.get("all_heads", i - 1)["row_num"]))
    arrived = arrived.select("upload_id", "new_filled", first.alias("new_heads"))
    state = store.read_keys("upload_lifecycle", arrived.select("upload_id"), "upload_id", LIFECYCLE)
    life = cut_lineage(arrived.join(state, "upload_id", "left").select(
        "upload_id", now.alias("last_arrival"), (F.coalesce("filled", F.lit(False)) | F.coalesce("new_filled", F.lit(False))).alias("filled"),
        F.when(F.col("header_row").isNull(), _merged_heads()).alias("heads"), "header_row", "columns",
        F.coalesce("status", F.lit("waiting")).alias("status"), F.col("status").isNull().alias("first_seen")), "stream-life")
    none = F.lit(None).cast("string")
    fresh = life.where("first_seen").select("upload_id", F.lit("processing").alias("status"), none.alias("error"))
    if not fresh.isEmpty():
        JB._outcomes(store, fresh, user_id, once=True)

    settled = cut_lineage(settle_headers(life.where("status = 'waiting'")).where("certain"), "stream-settled")
    headers = cut_lineage(life.where("header_row IS NOT NULL").select("upload_id", "header_row", "columns").unionByName(
        settled.select("upload_id", "header_row", "columns")), "stream-headers")
    waiting = batch.join(bounded_broadcast(headers.select("upload_id")), "upload_id", "left_anti")
    store.write_part("pending_rows", f"batch={epoch}", UPL.sheet_rows(waiting), partition_by="upload_id")
    _ingest_ready(store, batch.unionByName(_pending(store, settled)), headers, **kw)

    new = (life.drop("first_seen").join(settled.select("upload_id", F.col("header_row").alias("h"), F.col("columns").alias("c")), "upload_id", "left")
           .withColumn("columns", F.coalesce("columns", "c")).withColumn("header_row", F.coalesce("header_row", "h"))
           .withColumn("status", F.when(F.col("h").isNotNull(), "reading").otherwise(F.col("status")))
           .withColumn("heads", F.when(F.col("header_row").isNull(), F.col("heads"))).drop("h", "c"))
    _save_lifecycle(store, new)


def _save_lifecycle(store: TableStore, rows: DataFrame) -> None:
    names = ["upload_id", "last_arrival", "filled", "heads", "header_row", "columns", "status"]
    store.upsert("upload_lifecycle", rows.select(*names), "upload_id",
                 lambda old, new: old.join(new.select("upload_id"), "upload_id", "left_anti").select(*names).unionByName(new))


def close_uploads(store: TableStore, before: _dt.datetime | None = None, user_id: int | None = None, **kw) -> None:
    """End the open uploads, or those without a row since ``before``: ``done`` or ``failed``.

    A header that was not certain counts now, and the rows that waited for it go
    out.  Uploads without a header or without a good row end ``failed``; that is
    final, their rows stay in the pending table.  Rows that come after ``done``
    are still added.  Outcomes are kept by upload; ledger and audit get one row each.
    """
    life = store.read("upload_lifecycle", LIFECYCLE)
    if life is None:
        return
    life = life.where("status IN ('waiting', 'reading')")
    if before is not None:
        life = life.where(F.col("last_arrival") < F.lit(before).cast("timestamp_ntz"))
    life = cut_lineage(life, "closing")
    uploads = life.select("upload_id")
    if uploads.isEmpty():
        return
    late = cut_lineage(settle_headers(life.where("status = 'waiting'")), "closing-headers")
    settled = late.where("header_row IS NOT NULL").select("upload_id", "header_row", "columns")
    _ingest_ready(store, _pending(store, settled), settled, **kw)

    outcomes = cut_lineage(_stored_outcomes(store, life, late), "closing-outcomes")
    store.upsert("upload_outcomes", outcomes, "upload_id", lambda old, new: UP.replace_on_key(old, new, ["upload_id"]))
    JB._outcomes(store, outcomes, user_id, once=True)
    ended = (life.drop("status").join(outcomes.select("upload_id", "status"), "upload_id")
             .join(settled.withColumnsRenamed({"header_row": "h", "columns": "c"}), "upload_id", "left")
             .withColumn("header_row", F.coalesce("header_row", "h")).withColumn("columns", F.coalesce("columns", "c"))
             .withColumn("heads", F.lit(None).cast(life.schema["heads"].dataType)))
    _save_lifecycle(store, ended)


def _stored_outcomes(store: TableStore, life: DataFrame, late: DataFrame) -> DataFrame:
    """OUTCOMES of the closing uploads from what is stored of them: one row per position, good or bad."""
    uploads = bounded_broadcast(life.select("upload_id"))
    tx = store.read_log("transactions", S.TRANSACTIONS).join(uploads, "upload_id", "left_semi")
    bad = store.read_log("row_errors", "upload_id long, row_num long, error string").join(uploads, "upload_id", "left_semi")
    good = tx.groupBy("upload_id").agg(F.count(F.lit(1)).alias("good"))
    bad = bad.groupBy("upload_id").agg(F.count(F.lit(1)).alias("bad"))
    j = (life.select("upload_id", "filled").join(late.select("upload_id", "header_error"), "upload_id", "left")
         .join(good, "upload_id", "left").join(bad, "upload_id", "left"))
    n_good, n_bad = (F.coalesce(c, F.lit(0)).cast("long") for c in ("good", "bad"))
    error = F.coalesce(F.when(F.col("filled"), F.col("header_error")), F.when(n_good == 0, F.lit(LG.NO_GOOD_ROWS)))
    return j.select("upload_id", F.when(error.isNull(), "done").otherwise("failed").alias("status"), error.alias("error"),
                    (n_good + n_bad).alias("rows_read"), n_bad.alias("parse_errors"))


def stream_ingest(spark: SparkSession, source_dir: str, store: TableStore, max_files: int = 1, complete: bool = False,
                  patience: _dt.timedelta = PATIENCE, **kw) -> DataFrame:
    """Drain ``source_dir`` (Parquet cells) into the store, then close uploads.

    ``complete`` says that no upload will get further rows: all open ones are
    closed.  Otherwise those end that got no row for ``patience``.
    """
    cells = (spark.readStream.schema(UPL.CELLS_SCHEMA).option("maxFilesPerTrigger", max_files)
             .parquet(source_dir))
    q = (cells.writeStream.foreachBatch(lambda df, epoch: ingest_cells_batch(store, df, epoch, **kw))
         .option("checkpointLocation", _ckpt(store, "ingest")).trigger(availableNow=True).start())
    _drain(q)
    close_uploads(store, None if complete else JB._now() - patience, **kw)
    return store.read_log("transactions", S.TRANSACTIONS)


# ---------------------------------------------------------------------------
# T2
# ---------------------------------------------------------------------------

def _transactions(spark: SparkSession, source_dir: str, schema, max_files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)


def stream_dedup(spark: SparkSession, source_dir: str, schema, store: TableStore, max_files: int = 1) -> DataFrame:
    """Transactions file stream without repeated ids.

    Each micro-batch adds the ids that are not stored yet, however late they
    arrive; a retried batch finds its rows stored and adds nothing.
    """
    def sink(df: DataFrame, _epoch: int) -> None:
        stored = store.read_log("dedup_transactions", schema)
        fresh = (UP.first_per_key(df, "id", ("upload_id", "row_num")).select(*df.columns) if stored is None
                 else UP.insert_ignore(stored, df))
        store.append("dedup_transactions", fresh, partition_by="upload_id")

    _drain(_transactions(spark, source_dir, schema, max_files).writeStream.foreachBatch(sink)
           .option("checkpointLocation", _ckpt(store, "dedup")).trigger(availableNow=True).start())
    return store.read_log("dedup_transactions", schema)


# ---------------------------------------------------------------------------
# T3
# ---------------------------------------------------------------------------

TREND_DELTAS = "day timestamp_ntz, total_ops long, highrisk_ops long, batch long"


def stream_trend(spark: SparkSession, source_dir: str, schema, scores: DataFrame, store: TableStore,
                 max_files: int = 1) -> DataFrame:
    """Per-day totals and suspicious counts, incrementally.

    Each micro-batch writes its own day counts under its batch number (a retry
    overwrites them); the trend is their sum.  No operation is too late.
    """
    out = store._path("stream_trend", "data")

    def sink(df: DataFrame, epoch: int) -> None:
        days = RK.risk_trend(df, scores).select("day", "total_ops", "highrisk_ops")
        days.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _drain(_transactions(spark, source_dir, schema, max_files).writeStream.foreachBatch(sink)
           .option("checkpointLocation", _ckpt(store, "trend")).trigger(availableNow=True).start())
    deltas = store.read_log("stream_trend", TREND_DELTAS)
    if deltas is None:
        deltas = spark.createDataFrame([], TREND_DELTAS)
    summed = deltas.groupBy("day").agg(F.sum("total_ops").alias("total_ops"), F.sum("highrisk_ops").alias("highrisk_ops"))
    return summed.withColumn("share", F.round(F.col("highrisk_ops") * 100.0 / F.col("total_ops"), 2))
