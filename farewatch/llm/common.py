"""Helpers shared by the training-data operators: shared folder, file access, small keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farewatch.session import scratch_path

# Words everywhere in this subpackage: runs of bytes that are not ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the cluster's ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex[:12]}")


def save(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    Cuts the lineage: a lost executor costs at most the tasks after this point.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder or file named by Spark, usable in tasks."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    elif "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def unit_hash(key: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) from the text form of ``key`` (null counts as '')."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


# For oracle SQL: a one-row table of the CRC-32 byte table, and the checksum of a text by it.
CRC32_TABLE_SQL = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS crc_table FROM (SELECT unnest(range(0::BIGINT, 256)) AS i))"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes; needs ``crc`` of CRC32_TABLE_SQL in FROM."""
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen({text}) * 2, 2), "
            f"lambda i: ('0x' || hex(encode({text}))[i:i + 1])::BIGINT)), "
            "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)")
