"""Aggregates kept up to date by deltas instead of recounts.

The transactions log only grows by files that never change, so what is new
since a state was made are the files it does not list.  A refresh reads those,
adjusts stored sums, and names the versions of all its tables in one marker
written last; a refresh that fails leaves the state as it was, and the next one
starts from the same versions.
"""

from __future__ import annotations

import datetime as _dt
import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, functions as F

from farewatch import constants as K
from farewatch import schemas as S
from farewatch.operators import features as FT
from farewatch.operators import risk as RK
from farewatch.operators import upsert as UP
from farewatch.plans.store import TableStore
from farewatch.session import cut_lineage

TOTALS = "dimension_type string, dimension_value string, total_ops long, highrisk_ops long"
FILES = "file string"


def log_files(store: TableStore, name: str, schema) -> DataFrame:
    """(file): the data files of an append-only log, one row each."""
    log = store.read_log(name, schema)
    return store.spark.createDataFrame([(f,) for f in (log.inputFiles() if log is not None else [])], FILES)


def new_rows(store: TableStore, name: str, schema, files: DataFrame, seen: DataFrame | None) -> DataFrame:
    """The rows of the log in ``files`` that ``seen`` does not list; only those files are opened."""
    fresh = files if seen is None else files.join(seen, "file", "left_anti")
    paths = sorted(unquote(r["file"]) for r in fresh.collect())  # one name per new file
    if not paths:
        return store.spark.createDataFrame([], schema)
    root = store._path(name, "data")
    return store.spark.read.schema(schema).option("basePath", root).parquet(*paths)


def read_state(store: TableStore, name: str) -> dict:
    """The marker of the newest complete state, or an empty one."""
    v = store.version(name)
    return {} if v is None else store._layout(name, v)


def _signed(rows: DataFrame, dims, total: str, highrisk: str) -> DataFrame:
    """Signed counts (passenger, dims..., ...) as rows of TOTALS, with one row over all operations."""
    pairs = [F.struct(F.lit(d).alias("dimension_type"), F.col(d).cast("string").alias("dimension_value")) for d in dims]
    pairs.append(F.struct(F.lit(RK.ALL_ROWS).alias("dimension_type"), F.lit(RK.ALL_ROWS).alias("dimension_value")))
    return (rows.select(F.expr(total).cast("long").alias("total_ops"), F.expr(highrisk).cast("long").alias("highrisk_ops"),
                        F.inline(F.array(*pairs))).where("dimension_value IS NOT NULL"))


def _sum_totals(parts: list[DataFrame]) -> DataFrame:
    return (reduce(DataFrame.unionByName, parts).groupBy("dimension_type", "dimension_value")
            .agg(F.sum("total_ops").alias("total_ops"), F.sum("highrisk_ops").alias("highrisk_ops")))


def band_changes(store: TableStore, old: int | None, new: int | None) -> DataFrame | None:
    """(passenger_id, sign): passengers that became suspicious (1) or ceased to be (-1) between two versions of the scores.

    Only buckets that differ are read.  None if the older version is gone.
    """
    none = store.spark.createDataFrame([], "passenger_id long, sign int")
    if old == new:
        return none
    if old is None:
        return RK.suspicious_lookup(store.read("passenger_scores", version=new)).select("passenger_id", F.lit(1).alias("sign"))
    pair = store.changed_buckets("passenger_scores", old, new)
    if pair is None:
        return None
    before, after = (RK.suspicious_lookup(p) for p in pair)
    j = before.withColumnRenamed("suspicious", "was").join(after, "passenger_id", "full_outer")
    return j.where("was IS NULL OR suspicious IS NULL").select("passenger_id", F.when(F.col("was").isNull(), 1).otherwise(-1).alias("sign"))


def refresh_concentration(store: TableStore, dims=K.DIMENSIONS, calculated_at: _dt.datetime | None = None) -> DataFrame:
    """The concentrations after all stored transactions and scores, from what changed since the last refresh.

    Kept: operations per passenger and dimension values (in buckets of the
    passenger), and the totals per dimension value.  New transactions add to
    both; a passenger that crossed into or out of the suspicious bands moves
    its own stored counts, with their sign.  Neither all transactions nor all
    passengers are read.  A change of ``dims``, or scores whose older version was
    expired, counts anew from the stored operations.
    """
    name = "concentration_state"
    state = read_state(store, name)
    if state.get("dims") != list(dims):
        state = {}
    per = "passenger_id long, " + ", ".join(f"`{d}` {_type_of(d)}" for d in dims) + ", n long"
    scores_at = store.version("passenger_scores")
    files = cut_lineage(log_files(store, "transactions", S.TRANSACTIONS), "log-files")
    seen = store.read("counted_files", FILES, state["files"]) if state else None
    fresh = cut_lineage(new_rows(store, "transactions", S.TRANSACTIONS, files, seen)
                        .groupBy("passenger_id", *dims).agg(F.count(F.lit(1)).alias("n")), "fresh-counts")
    changes = band_changes(store, state["scores"], scores_at) if state else None
    if changes is None:  # nothing counted yet, or nothing to compare with
        counts = fresh if not state else store.read("passenger_dimensions", per, state["counts"]).unionByName(fresh)
        parts = [_signed(RK.mark_suspicious(counts, _scores(store, scores_at)), dims, "n", "if(suspicious, n, 0)")]
    else:
        changes = cut_lineage(changes, "band-changes")
        moved = store.read_keys("passenger_dimensions", changes.select("passenger_id"), "passenger_id", per, state["counts"])
        marked = store.read_keys("passenger_scores", fresh.select("passenger_id").distinct(), "passenger_id",
                                 S.PASSENGER_SCORES, scores_at or 0)
        parts = [store.read("dimension_totals", TOTALS, state["totals"]),
                 _signed(moved.join(changes, "passenger_id"), dims, "0", "n * sign"),
                 _signed(RK.mark_suspicious(fresh, marked), dims, "n", "if(suspicious, n, 0)")]
    totals_at = store.write("dimension_totals", _sum_totals(parts))
    counts_at = store.upsert("passenger_dimensions", fresh, "passenger_id", lambda old, new: old.unionByName(new).groupBy(
        "passenger_id", *dims).agg(F.sum("n").alias("n")), base=state.get("counts", 0))
    files_at = store.write("counted_files", files)
    store._mark(name, (store.version(name) or 0) + 1, json.dumps(
        {"dims": list(dims), "totals": totals_at, "counts": counts_at, "files": files_at, "scores": scores_at}))
    totals = store.read("dimension_totals", TOTALS, totals_at).where("total_ops > 0")
    base = totals.where(F.col("dimension_type") == RK.ALL_ROWS).select(F.col("highrisk_ops") / F.col("total_ops")).scalar()
    return RK.with_lift(totals.where(F.col("dimension_type") != RK.ALL_ROWS), base, calculated_at)


BUCKET_SUMS = ("n_all", "n", "r", "nt", "lt")
BUCKETS = "passenger_id long, kind string, b string, " + ", ".join(f"{c} long" for c in BUCKET_SUMS)


def refresh_features(store: TableStore, calculated_at: _dt.datetime) -> DataFrame:
    """A1-A3: the feature table after all stored transactions, from what is new since the last refresh.

    Kept per passenger: the sums of each month, departure day and train, which add
    up over uploads.  New transactions are added to the buckets of their
    passengers, whose features alone are derived again.
    """
    name = "feature_state"
    state = read_state(store, name)
    files = cut_lineage(log_files(store, "transactions", S.TRANSACTIONS), "log-files")
    seen = store.read("feature_files", FILES, state["files"]) if state else None
    fresh = cut_lineage(FT.bucket_counts(new_rows(store, "transactions", S.TRANSACTIONS, files, seen)).select(
        "passenger_id", "kind", "b", *[F.col(c).cast("long").alias(c) for c in BUCKET_SUMS]), "fresh-buckets")
    buckets_at = store.upsert("feature_buckets", fresh, "passenger_id", lambda old, new: old.unionByName(new).groupBy(
        "passenger_id", "kind", "b").agg(*[F.sum(c).alias(c) for c in BUCKET_SUMS]), base=state.get("buckets", 0))
    changed = fresh.select("passenger_id").distinct()
    sums = store.read_keys("feature_buckets", changed, "passenger_id", BUCKETS, buckets_at)
    known = store.read_keys("passengers", changed.withColumnRenamed("passenger_id", "id"), "id", S.PASSENGERS)
    features = FT.features_from_buckets(sums, known).withColumn("calculated_at", F.lit(calculated_at).cast("timestamp_ntz"))
    store.upsert("passenger_features", features, "passenger_id", UP.feature_upsert)
    files_at = store.write("feature_files", files)
    store._mark(name, (store.version(name) or 0) + 1, json.dumps({"buckets": buckets_at, "files": files_at}))
    return store.read("passenger_features")


def _scores(store: TableStore, version: int | None) -> DataFrame:
    stored = None if version is None else store.read("passenger_scores", S.PASSENGER_SCORES, version)
    return store.spark.createDataFrame([], S.PASSENGER_SCORES) if stored is None else stored


def _type_of(column: str) -> str:
    return next(f.split()[1] for f in S.TRANSACTIONS.split(", ") if f.split()[0] == column)
