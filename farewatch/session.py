"""Spark session helpers: UTC clock, AQE, checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on.  Hour-of-day and day buckets are
# computed in UTC; AQE coalesces small shuffles and splits skewed partitions.
SESSION_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Fall back from whole-stage codegen when a generated method exceeds the
    # JVM's JIT limit (8000 bytes): wide typing projections otherwise run as
    # interpreted bytecode.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "farewatch", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster the launcher supplies master and sizes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime settings to an existing session (idempotent)."""
    for k, v in SESSION_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    on a ``local[...]`` master (tests) a private temporary folder is created.
    A cluster without a shared folder is refused: executors cannot see one
    machine's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {sc.master}")
        configured = tempfile.mkdtemp(prefix="farewatch-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, name: str = "df") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and continue from it.

    The plan runs once (a reliable ``checkpoint()`` computes it a second time
    to write its files), survives executor loss, bounds plan size between
    pipeline breaks, and reads back columnar (later steps prune columns).
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"_lineage/{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint location for intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"


# Largest number of rows a per-key side table (one row per upload, ~100
# bytes) may have to be broadcast; beyond it the join is left to the planner.
BROADCAST_MAX_ROWS = 100_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking its row count (one small job).

    The table is materialised first (reliable checkpoint), so the check
    does not recompute it.  Used for side tables keyed by a low-cardinality
    column (upload id): a
    shuffle join on such a key would put each upload -- possibly a third of
    all rows -- into one task.  Above the bound the plain join is returned
    and AQE's skew-join splitting takes over.
    """
    from pyspark.sql import functions as F

    df = cut_lineage(df)  # small by purpose: computed once, then counted and joined
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df
