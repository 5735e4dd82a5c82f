"""Versioned Parquet tables without a table format.

Mutable tables (passengers, features, scores, concentrations) are written
as ``<root>/<name>/v=<n>`` and a marker file per version names the current
version, so a writer never overwrites the folder it reads from.  Tables that
grow are kept in hash buckets of their key: an upsert writes the buckets it
touches as the next version, and the marker lists where every bucket lives, so
a small batch costs its own buckets and not the whole table.  Append-only
tables (transactions, row errors, ledgers) live in ``<root>/<name>/data`` and
grow by appends (partitioned where useful).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farewatch.session import bounded_broadcast, cut_lineage, scratch_path

# Buckets of a keyed table when it is first written (a table keeps its number);
# a bucket is what one small upsert rewrites, so size it to about 1 GB.
BUCKETS = 32
BUCKET = "_bucket"


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.buckets = buckets
        self.root = root or scratch_path(spark, f"farewatch-store-{uuid.uuid4().hex[:8]}")
        # Current version per table as last read or written by this instance
        # (one writer per store: the jobs run one at a time).
        self._versions: dict[str, int] = {}

    # -- paths --------------------------------------------------------------
    def _path(self, name: str, *parts: str) -> str:
        return os.path.join(self.root, name, *parts)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    # -- versioned tables ---------------------------------------------------
    def version(self, name: str) -> int | None:
        if name in self._versions:
            return self._versions[name]
        p, fs = self._fs(self._path(name, "_pointer"))
        if not fs.exists(p):
            return None
        found = [st.getPath().getName() for st in fs.listStatus(p)]
        versions = [int(n[2:]) for n in found if n.startswith("v=") and n[2:].isdigit()]
        if not versions:
            return None
        self._versions[name] = max(versions)
        return self._versions[name]

    def read(self, name: str, schema=None, version: int | None = None) -> DataFrame | None:
        v = self.version(name) if version is None else version
        if v is None:
            return None
        layout = self._layout(name, v)
        if layout is None:
            return self._load([self._path(name, f"v={v}")], schema)
        return self._read_buckets(name, layout, layout["at"], schema)

    def _layout(self, name: str, v: int) -> dict | None:
        """The marker of a version: {"buckets": n, "schema": ..., "at": {bucket: version}}, or None for a table without buckets."""
        p, fs = self._fs(self._path(name, "_pointer", f"v={v}"))
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else None

    def _read_buckets(self, name: str, layout: dict, buckets, schema=None) -> DataFrame:
        paths = [self._path(name, f"v={layout['at'][b]}", f"{BUCKET}={b}") for b in buckets]
        schema = schema or layout["schema"]
        return self._load(paths, schema) if paths else self.spark.createDataFrame([], schema)

    def _load(self, paths: list[str], schema=None) -> DataFrame | None:
        """Parquet folder -> DataFrame; a folder without data files (an empty
        write) reads as None unless a schema is given."""
        r = self.spark.read
        if schema is not None:
            return r.schema(schema).parquet(*paths)
        try:
            return r.parquet(*paths)
        except AnalysisException as exc:
            if "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise

    def write(self, name: str, df: DataFrame, partition_by: str | list[str] | None = None) -> int:
        """Write the next version, then add its pointer entry."""
        v = (self.version(name) or 0) + 1
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
        w.parquet(self._path(name, f"v={v}"))
        return self._mark(name, v)

    def _mark(self, name: str, v: int, text: str = "") -> int:
        """One pointer entry (a marker file) per version, created after the data is committed.

        The current version is the largest entry and no write removes an
        entry, so a failure at any point leaves a complete version current.
        The file gets its name once it is complete.
        """
        p, fs = self._fs(self._path(name, "_pointer", f"v={v}"))
        part, _ = self._fs(self._path(name, "_pointer", f".v={v}"))
        stream = fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(part, p):
            raise RuntimeError(f"could not publish version {v} of {name}")
        self._versions[name] = v
        return v

    def upsert(self, name: str, new: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
               base: int | None = None) -> int:
        """Merge ``new`` into the table and rewrite only the buckets of ``key`` that ``new`` touches.

        ``merge(stored, new)`` gives the rows of the touched buckets and keeps
        every row's key.  A table without buckets is divided by its first upsert.
        ``base`` names the version to start from: 0 for none, default the current one.
        """
        newest = self.version(name)
        v = (newest if base is None else base) or None
        layout = None if v is None else self._layout(name, v)
        n = layout["buckets"] if layout else self.buckets

        def bucket(column: Column) -> Column:
            return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

        if layout:
            new = cut_lineage(new, f"{name}-upsert")  # read twice: for its buckets (at most n numbers) and its rows
            touched = {str(r[0]) for r in new.select(bucket(F.col(key))).distinct().collect()}
            if not touched:
                return v
            old = self._read_buckets(name, layout, sorted(touched & set(layout["at"]), key=int))
        else:
            touched, old = None, None if v is None else self.read(name, version=v)
        rows = new if old is None else merge(old, new)
        v = (newest or 0) + 1
        path = self._path(name, f"v={v}")
        (rows.withColumn(BUCKET, bucket(F.col(key))).hint("rebalance", F.col(BUCKET))
         .write.mode("overwrite").partitionBy(BUCKET).parquet(path))
        p, fs = self._fs(path)
        found = [st.getPath().getName() for st in fs.listStatus(p)]
        at = {b: w for b, w in layout["at"].items() if b not in touched} if layout else {}
        at |= {f.split("=")[1]: v for f in found if f.startswith(f"{BUCKET}=")}
        schema = layout["schema"] if layout else ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
        return self._mark(name, v, json.dumps({"buckets": n, "schema": schema, "at": at}))

    def read_keys(self, name: str, keys: DataFrame, key: str, schema, version: int | None = None) -> DataFrame:
        """The stored rows of ``keys`` (one column); opens only the buckets that may hold one."""
        v = self.version(name) if version is None else version or None
        layout = None if v is None else self._layout(name, v)
        if layout is None:
            stored = None if v is None else self.read(name, schema, v)
            return self.spark.createDataFrame([], schema) if stored is None else stored.join(keys, key, "left_semi")
        wanted = keys.select(F.pmod(F.xxhash64(key), F.lit(layout["buckets"])).cast("string").alias("b")).distinct()
        buckets = sorted({r["b"] for r in wanted.collect()} & set(layout["at"]), key=int)
        return self._read_buckets(name, layout, buckets, schema).join(keys, key, "left_semi")

    def expire(self, name: str, keep: int = 3) -> list[int]:
        """Remove the versions that none of the newest ``keep`` markers refers to; returns them.

        Run it when no reader of an older version is left.
        """
        p, fs = self._fs(self._path(name, "_pointer"))
        if not fs.exists(p):
            return []
        found = (st.getPath().getName() for st in fs.listStatus(p))
        versions = sorted(int(f[2:]) for f in found if f.startswith("v="))
        used = set(versions[-keep:])
        for v in versions[-keep:]:
            used |= set((self._layout(name, v) or {"at": {}})["at"].values())
        gone = [v for v in versions if v not in used]
        for v in versions[:-keep]:
            marker, _ = self._fs(self._path(name, "_pointer", f"v={v}"))
            fs.delete(marker, False)
        for v in gone:
            data, _ = self._fs(self._path(name, f"v={v}"))
            fs.delete(data, True)
        return gone

    def changed_buckets(self, name: str, old: int, new: int) -> tuple[DataFrame, DataFrame] | None:
        """The rows of two versions in the buckets that differ, or None if one of them cannot be compared or is gone."""
        layouts = [self._layout(name, v) if self._exists(self._path(name, "_pointer", f"v={v}")) else None for v in (old, new)]
        if None in layouts or layouts[0]["buckets"] != layouts[1]["buckets"]:
            return None
        a, b = (x["at"] for x in layouts)
        differ = sorted((k for k in a.keys() | b.keys() if a.get(k) != b.get(k)), key=int)
        return tuple(self._read_buckets(name, x, [k for k in differ if k in x["at"]]) for x in layouts)

    # -- append-only tables -------------------------------------------------
    def read_log(self, name: str, schema=None) -> DataFrame | None:
        path = self._path(name, "data")
        if not self._exists(path):
            return None
        return self._load([path], schema)

    def append(self, name: str, df: DataFrame, partition_by: str | list[str] | None = None) -> None:
        w = df.write.mode("append")
        if partition_by:
            w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
        w.parquet(self._path(name, "data"))

    def append_once(self, name: str, df: DataFrame, key: list[str], schema) -> None:
        """Append the rows of ``df`` whose ``key`` is not in the log yet; of repeats within ``df`` one."""
        df = df.dropDuplicates(key)
        stored = self.read_log(name, schema)
        if stored is not None:
            uploads = bounded_broadcast(df.select(key[0]).distinct())
            stored = stored.join(uploads, key[0], "left_semi").select(*key)
            df = df.join(stored, key, "left_anti").select(*df.columns)
        self.append(name, df)

    def write_part(self, name: str, part: str, df: DataFrame, partition_by: str) -> None:
        """Replace one part (a folder ``column=value``) of a log; parts belong to one writer each."""
        df.write.mode("overwrite").partitionBy(partition_by).parquet(self._path(name, "data", part))
