"""The two end-to-end jobs: upload ingest (section 3.1) and scoring run (3.2).

Both read and write a ``TableStore``; every step is a DataFrame plan and the
only actions are the writes.  Reruns are idempotent: transaction ids are
deterministic and inserts ignore known ids; passengers/features/scores are
set-based upserts into a new version.
"""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.sql import DataFrame, Observation, functions as F

from farewatch import constants as K
from farewatch import schemas as S
from farewatch.operators import features as FT
from farewatch.operators import ledger as LG
from farewatch.operators import risk as RK
from farewatch.operators import scoring as SC
from farewatch.operators import upsert as UP
from farewatch.plans.incremental import refresh_concentration, refresh_features
from farewatch.plans.ingest import enrich_rows, passenger_rollup, transactions_from
from farewatch.plans.store import TableStore
from farewatch.session import cut_lineage
from farewatch.sources import uploads as UPL


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _event(store: TableStore, table: str, key: str, key_value, status: str, error: str | None = None) -> None:
    """Append one status event to a ledger (L1/L2)."""
    row = [(key_value, status, _now(), error, time.time_ns() // 1000)]
    store.append(table, store.spark.createDataFrame(row, S.UPLOAD_EVENTS if key == "upload_id" else S.JOB_EVENTS))


def _audit(store: TableStore, action: str, entity_type: str, entity_id, user_id: int | None = None,
           meta: dict | None = None) -> None:
    """Append one audit row (L3); ``meta`` is stored as JSON text."""
    import json

    now = _now()
    row = [(f"{action.lower()}-{entity_id}-{time.time_ns()}", user_id, action, entity_type, str(entity_id),
            json.dumps(meta or {}, ensure_ascii=False), now)]
    store.append("audit_logs", store.spark.createDataFrame(row, S.AUDIT_LOGS))


def _outcomes(store: TableStore, outcomes: DataFrame, user_id: int | None, once: bool = False) -> None:
    """Append one ledger event and one audit row per upload (upload_id, status, error): two writes
    for any number of uploads, none of which passes the driver.

    ``once``: only what the two logs do not have yet, for callers that may repeat a step.
    """
    now, seq = F.lit(_now()).cast("timestamp_ntz"), time.time_ns() // 1000
    events = outcomes.select("upload_id", "status", now.alias("ts"), "error", F.lit(seq).cast("long").alias("seq"))
    action = F.when(F.col("status") == "processing", "UPLOAD_STARTED").when(
        F.col("status") == "done", "UPLOAD_COMPLETED").otherwise("UPLOAD_FAILED")
    up = F.col("upload_id").cast("string")
    audit = outcomes.select(
        F.concat(F.lower(action), F.lit("-"), up, F.lit(f"-{seq}")).alias("id"), F.lit(user_id).cast("long").alias("user_id"),
        action.alias("action"), F.lit("upload").alias("entity_type"), up.alias("entity_id"),
        F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise("{}").alias("meta"), now.alias("created_at"))
    if once:
        store.append_once("upload_events", events, ["upload_id", "status"], S.UPLOAD_EVENTS)
        store.append_once("audit_logs", audit, ["entity_id", "action"], S.AUDIT_LOGS)
    else:
        store.append("upload_events", events)
        store.append("audit_logs", audit)


def ingest_typed(store: TableStore, typed_rows: DataFrame, **kw) -> None:
    """Typed good rows -> transactions (insert-ignore, repeats within the batch included) + passengers (upsert)."""
    enriched = cut_lineage(enrich_rows(typed_rows, **kw))
    tx = transactions_from(enriched)
    existing = store.read_log("transactions")
    new_tx = (UP.first_per_key(tx, "id", ("upload_id", "row_num")).select(*tx.columns) if existing is None
              else UP.insert_ignore(existing, tx))
    # Whole uploads to few files, large uploads to several tasks.
    store.append("transactions", new_tx.hint("rebalance", F.col("upload_id")), partition_by="upload_id")
    store.upsert("passengers", passenger_rollup(enriched), "id", UP.passenger_upsert)


def ingest_cells(store: TableStore, cells: DataFrame, user_id: int | None = None, **kw) -> dict:
    """Section 3.1 for a batch of uploads given as sheet cells.

    Header discovery, typing and the row-error split are one plan; typed rows
    are checkpointed once because both outputs read them.  Uploads without a
    header or without a good row end ``failed``; the others of the batch go on.
    """
    uploads = cut_lineage(cells.select("upload_id").distinct(), "uploads")
    none = F.lit(None).cast("string")
    _outcomes(store, uploads.select("upload_id", F.lit("processing").alias("status"), none.alias("error")), user_id)
    try:
        out, outcomes = _ingest_cells(store, uploads, cells, **kw)
    except Exception as exc:
        _outcomes(store, uploads.select("upload_id", F.lit("failed").alias("status"), F.lit(str(exc)).alias("error")), user_id)
        raise
    _outcomes(store, outcomes, user_id)
    return out


def _ingest_cells(store: TableStore, uploads: DataFrame, cells: DataFrame, **kw) -> tuple[dict, DataFrame]:
    typed, headers, _ = UPL.typed_from_cells(cells)
    # Row and error counts are collected as metrics of the checkpoint pass
    # itself (no extra job).
    obs = Observation("upload_rows")
    typed = cut_lineage(typed.observe(obs, F.count(F.lit(1)).alias("rows_read"),
                                      F.count_if(F.col("error").isNotNull()).alias("parse_errors")))
    headers = cut_lineage(headers, "headers")
    good, bad = UPL.split_errors(typed)
    # A repeated ingest finds its error rows and headers stored.
    store.append_once("row_errors", bad, ["upload_id", "row_num"], "upload_id long, row_num long, error string")
    store.append_once("upload_headers", headers, ["upload_id"], headers.schema)
    ingest_typed(store, good, **kw)
    return dict(obs.get), cut_lineage(LG.upload_outcomes(uploads, headers, typed), "outcomes")


def scoring_run(store: TableStore, upload_id: int | None = None, scope: str = "all",
                rule_weight: float = K.RULE_WEIGHT, ml_weight: float = K.ML_WEIGHT,
                with_ml: bool = True, run_time: _dt.datetime | None = None,
                dims=K.DIMENSIONS, job_id: str | None = None, user_id: int | None = None, incremental: bool = False) -> dict:
    """Section 3.2: features -> rule + anomaly score -> bands/reasons ->
    feature and score upserts (manual rows win) -> concentration refresh.

    ``incremental``: features of all transactions are kept by ``refresh_features``,
    which reads only what was loaded since the last such run.
    """
    if scope == "upload" and upload_id is None:
        raise ValueError("scope='upload' needs an upload_id: features per upload would give a passenger several scores")
    if incremental and upload_id is not None:
        raise ValueError("incremental features are those of all uploads")
    run_time = run_time or _now()
    job_id = job_id or f"job-{run_time:%Y%m%d%H%M%S}"
    _event(store, "job_events", "job_id", job_id, "running")
    _audit(store, "SCORING_STARTED", "scoring_job", job_id, user_id)
    try:
        tx = store.read_log("transactions", S.TRANSACTIONS)
        passengers = store.read("passengers")
        if tx is None:  # nothing ingested yet: an empty run
            tx = store.spark.createDataFrame([], S.TRANSACTIONS)
        if passengers is None:
            passengers = store.spark.createDataFrame([], S.PASSENGERS)
        if upload_id is not None:
            tx = tx.filter(F.col("upload_id") == F.lit(upload_id))
        if incremental:
            feats = refresh_features(store, run_time).drop("calculated_at")
        else:
            feats = cut_lineage(FT.full_features(tx, passengers, scope))
        ml = None
        if with_ml:
            from farewatch.operators.iforest import anomaly_scores
            ml = anomaly_scores(feats)
        scored = SC.score_features(feats, ml=ml, rule_weight=rule_weight, ml_weight=ml_weight)
        new_scores = SC.score_table(scored, scored_at=run_time)
        if scope == "upload":
            new_scores = new_scores.drop("upload_id")
            feats = feats.drop("upload_id")
        if not incremental:
            new_feats = feats.withColumn("calculated_at", F.lit(run_time).cast("timestamp_ntz"))
            store.upsert("passenger_features", new_feats, "passenger_id", UP.feature_upsert)
        store.upsert("passenger_scores", new_scores, "passenger_id", UP.score_upsert)
        conc = refresh_concentration(store, dims, run_time)
        old_c = store.read("risk_concentrations")
        store.write("risk_concentrations", conc if old_c is None else UP.concentration_upsert(old_c, conc))
        _event(store, "job_events", "job_id", job_id, "done")
        _audit(store, "SCORING_COMPLETED", "scoring_job", job_id, user_id)
    except Exception as exc:
        _event(store, "job_events", "job_id", job_id, "failed", str(exc))
        raise
    return {"job_id": job_id}


def upload_job(store: TableStore, cells: DataFrame, user_id: int | None = None, job_id: str | None = None,
               scoring: dict | None = None, **kw) -> dict:
    """An upload and the scoring it triggers: section 3.1, then 3.2 over the loaded data.

    Scoring is a step of its own: the upload's outcome is written before it, and
    a scoring that fails ends its own job ``failed`` and leaves the uploads ``done``.
    Nothing is scored if no upload of the batch loaded a row.  Returns the
    ingest metrics with ``scoring`` (the job's id) or ``scoring_error``.
    """
    out = ingest_cells(store, cells, user_id, **kw)
    if out["rows_read"] == out["parse_errors"]:
        return out
    try:
        out["scoring"] = scoring_run(store, job_id=job_id, user_id=user_id, **(scoring or {}))["job_id"]
    except Exception as exc:  # recorded in the job ledger by the run itself
        out["scoring_error"] = str(exc)
    return out


def export_reports(store: TableStore, out_dir: str, **filters) -> dict:
    """S10-S12 written from the current tables: suspicious operations (CSV),
    concentration sections (CSV, one folder per dimension), dossiers (JSON)."""
    from farewatch.plans import exports as EX

    tx, scores = store.read_log("transactions"), store.read("passenger_scores")
    paths = {"suspicious": f"{out_dir}/suspicious_operations", "concentration": f"{out_dir}/risk_concentration",
             "dossiers": f"{out_dir}/passenger_dossiers"}
    EX.write_csv(EX.suspicious_export(tx, scores, **filters), paths["suspicious"])
    EX.write_sections(EX.concentration_export(store.read("risk_concentrations")), paths["concentration"])
    EX.write_json(EX.dossiers(store.read("passengers"), tx, scores), paths["dossiers"])
    return paths


def override(store: TableStore, overrides: DataFrame, run_time: _dt.datetime | None = None) -> None:
    """R8 as a job: new score version + audit rows."""
    rows, audit = UP.manual_override(store.read("passenger_scores", S.PASSENGER_SCORES), overrides, run_time or _now())
    audit = cut_lineage(audit, "override-audit")  # tells the bands before the override
    store.upsert("passenger_scores", rows, "passenger_id", lambda old, new: UP.replace_on_key(old, new, ["passenger_id"]))
    store.append("audit_logs", audit)
