"""Set-based upserts (S5-S9) and manual override.

Each upsert is one full outer join on the key (no per-row lookups): the
result is the next version of the table, written by ``plans.store``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from farewatch import constants as K
from farewatch.session import BROADCAST_MAX_ROWS


# Uploads of a batch that are named one by one when stored rows are looked up.
SCOPE_LIST = 1000


def first_per_key(df: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Keep the first row per key in ``order``.

    Repeated keys are rare: they are found by a hash aggregate over the bare
    key; only their rows are reduced, the others pass through as they are.
    Rows without a key count as repeats of one key.
    """
    cols = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    repeated = df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_k"))
    same = df[key].eqNullSafe(repeated["_k"])
    reduced = df.join(repeated, same, "left_semi").groupBy(key).agg(first.alias("_r")).select(key, "_r.*")
    return df.join(repeated, same, "left_anti").select(key, *cols).unionByName(reduced)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str = "id",
                  order: tuple[str, ...] = ("upload_id", "row_num"), scope: str | None = "upload_id") -> DataFrame:
    """Rows of ``new`` whose key is not stored yet (the first of duplicates);
    stored rows are untouched.  Returns only the rows to append.

    Transaction ids hash the upload id, so a stored duplicate can only sit in
    one of the incoming uploads: the stored side is restricted to those
    instead of shuffling every stored id on each ingest.  Up to ``SCOPE_LIST``
    uploads are named in a filter on the partition column, so only their folders
    are listed and opened; more are a broadcast semi join after a check of their
    number.  ``scope=None`` or too many uploads compares against all stored keys.
    """
    fresh = first_per_key(new, key, order).select(*new.columns)
    stored = existing
    if scope and scope in existing.columns and scope in new.columns:
        scopes = new.select(scope).distinct()
        few = [r[0] for r in scopes.limit(SCOPE_LIST + 1).collect()]
        if len(few) <= SCOPE_LIST:
            stored = existing.where(F.col(scope).isin([v for v in few if v is not None]))
        elif scopes.count() <= BROADCAST_MAX_ROWS:
            stored = existing.join(F.broadcast(scopes), scope, "left_semi")
    return fresh.join(stored.select(key), key, "left_anti")


def passenger_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New passengers inserted; for known ones only last_seen_at moves
    forward (name, fake score and first_seen_at stay from first sight)."""
    o, n = existing.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")

    def keep(c):
        return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)

    cols = [F.coalesce(F.col("o.id"), F.col("n.id")).alias("id"), keep("fio_clean"), keep("fake_fio_score"),
            keep("first_seen_at"), F.greatest(F.col("o.last_seen_at"), F.col("n.last_seen_at")).alias("last_seen_at")]
    if "min_op_datetime" in existing.columns and "min_op_datetime" in new.columns:
        cols.append(F.least(F.col("o.min_op_datetime"), F.col("n.min_op_datetime")).alias("min_op_datetime"))
    return j.select(*cols)


def replace_on_key(existing: DataFrame, new: DataFrame, keys: list[str], keep_old=None,
                   prune: bool = False) -> DataFrame:
    """Generic upsert: the new row replaces the stored one on key conflict,
    unless ``keep_old`` (a Column over the stored side ``o``) is true.

    ``prune=True`` drops stored rows whose key is absent from ``new``.
    """
    cols = [c for c in existing.columns if c not in keys]
    o = existing.select(*keys, F.struct(*cols).alias("_o"), F.lit(True).alias("_in_o"))
    n = new.select(*keys, F.struct(*cols).alias("_n"), F.lit(True).alias("_in_n"))
    j = o.join(n, keys, "right" if prune else "full_outer")
    use_old = F.col("_in_n").isNull()
    if keep_old is not None:
        use_old = use_old | (F.col("_in_o").isNotNull() & F.coalesce(keep_old, F.lit(False)))
    return j.select(*keys, F.when(use_old, F.col("_o")).otherwise(F.col("_n")).alias("_r")).select(*keys, "_r.*")


def feature_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All feature columns replaced on key conflict."""
    return replace_on_key(existing, new, ["passenger_id"])


def score_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Replace only where the stored row is not manual; a manual row blocks
    the whole update.  Stored ``is_manual`` is kept on update."""
    new = new.select(*existing.columns)
    out = replace_on_key(existing, new, ["passenger_id"], keep_old=F.col("_o.is_manual"))
    return out


def concentration_upsert(existing: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """Measures replaced on id conflict; vanished values stay unless pruned."""
    return replace_on_key(existing, new.select(*existing.columns), ["id"], prune=prune)


EMPTY_SCORE = {
    "rule_score": 0.0, "ml_score": 0.0, "final_score": 0.0, "risk_band": K.BAND_DEFAULT,
    "seat_blocking_flag": False,
}


def manual_override(scores: DataFrame, overrides: DataFrame,
                    run_time: _dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply overrides (passenger_id, new_band, reason, actor_user_id).

    Returns (override score rows, audit rows).  A passenger without a score
    gets an empty one; the manual reason is prepended unless already listed.
    Several overrides of one passenger are applied in order (by a ``seq`` column
    if there is one, else by band and reason): one score row with the last band,
    one audit row each.
    Merge the score rows with ``replace_on_key`` (they win unconditionally).
    """
    seq = F.col("seq").cast("long") if "seq" in overrides.columns else F.lit(0).cast("long")
    overrides = overrides.groupBy("passenger_id").agg(F.array_sort(F.collect_list(F.struct(
        seq.alias("seq"), "new_band", "reason", F.col("actor_user_id").alias("actor")))).alias("steps"))
    ts = (F.lit(run_time) if run_time is not None else F.current_timestamp()).cast("timestamp_ntz")
    s = scores.alias("s")
    o = overrides.alias("v")
    j = o.join(s, F.col("v.passenger_id") == F.col("s.passenger_id"), "left")
    old_reasons = F.coalesce(F.col("s.top_reasons"), F.array().cast("array<string>"))

    def listed(acc, step):
        reason = F.concat(F.lit(K.MANUAL_REASON_PREFIX), step["reason"])
        return F.when(F.array_contains(acc, reason), acc).otherwise(F.array_prepend(acc, reason))

    reasons = F.aggregate(F.col("v.steps"), old_reasons, listed)
    old_band = F.coalesce(F.col("s.risk_band"), F.lit(K.BAND_DEFAULT))
    rows = j.select(
        F.col("v.passenger_id").alias("passenger_id"),
        *[F.coalesce(F.col(f"s.{c}"), F.lit(v)).alias(c) for c, v in EMPTY_SCORE.items() if c != "risk_band"],
        F.element_at("v.steps", -1)["new_band"].alias("risk_band"),
        reasons.alias("top_reasons"),
        F.lit(True).alias("is_manual"),
        ts.alias("scored_at"),
        old_band.alias("_old_band"),
        F.col("v.steps").alias("_steps"),
    )
    steps = rows.select("passenger_id", "_old_band", "_steps", F.posexplode("_steps").alias("_at", "_step")).select(
        "passenger_id", "_at", F.col("_step.new_band").alias("risk_band"), F.col("_step.reason").alias("_reason"),
        F.col("_step.actor").alias("_actor"),
        F.when(F.col("_at") == 0, F.col("_old_band")).otherwise(F.get("_steps", F.col("_at") - 1)["new_band"]).alias("_old_band"))
    text = F.concat_ws("|", F.col("passenger_id").cast("string"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                       "risk_band", "_reason", F.col("_at").cast("string"))
    audit = steps.select(
        F.concat(F.lit("override-"), F.col("passenger_id").cast("string"), F.lit("-"),
                 F.substring(F.sha2(text, 256), 1, 16)).alias("id"),
        F.col("_actor").alias("user_id"),
        F.lit("PASSENGER_RISK_OVERRIDE").alias("action"),
        F.lit("passenger").alias("entity_type"),
        F.col("passenger_id").cast("string").alias("entity_id"),
        F.to_json(F.struct(F.col("_old_band").alias("old_band"), F.col("risk_band").alias("new_band"),
                           F.col("_reason").alias("reason"))).alias("meta"),
        ts.alias("created_at"),
    )
    score_cols = ["passenger_id", "rule_score", "ml_score", "final_score", "risk_band", "top_reasons",
                  "seat_blocking_flag", "is_manual", "scored_at"]
    return rows.select(*score_cols), audit


def apply_override(scores: DataFrame, overrides: DataFrame, run_time=None) -> tuple[DataFrame, DataFrame]:
    """R8 end to end: the score table after overrides, and the audit rows."""
    rows, audit = manual_override(scores, overrides, run_time)
    cols = [c for c in scores.columns]
    merged = replace_on_key(scores.select(*cols), rows.select(*cols), ["passenger_id"])
    return merged, audit
