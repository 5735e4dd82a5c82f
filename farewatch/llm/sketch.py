"""Distributed count-min prefilter and lookups by part.

A *part* is what one task wrote when the texts were copied to the shared
folder; its number is stored with every row, so later scans know it whatever
their own splits are.

Pass 1 turns each part's keys into sketch cells (two hash rows), merges equal cells
and ships them as gap-coded cell lists, about a byte per key and row, with the
counts of cells met several times, grouped by segment of the cell range.
Merging a segment adds the parts' counts, list by list, up to a largest number;
the cells counted twice or more go back to the parts that hold them, with the
logarithm of their count.  A key whose cells are all returned is estimated
repeated; collisions only raise an estimate, so no repeated key is lost.  Nothing of the merged sketch reaches the driver, and a
task sees one segment, or the answers for one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from farewatch.llm.common import filesystem, save, shared_folder
from farewatch.llm.texthash import Hasher, TextBlock, mix, text_blocks

SKETCH_ROWS = 2
CELLS_PER_KEY = 4
# Segments grow with the sketch, so that a flush has some hundred cells for each.
SEGMENT_BITS = (22, 26)
SEGMENTS_BITS = 12
FLUSH_KEYS = 2_000_000
# Counts stop here; their codes are exact up to EXACT_CODES, then eight steps for each doubling.
COUNT_CAP = 2**30
EXACT_CODES = 64
# Stands for a null doc_id inside tasks.
NULL_ID = -2**63
_ROW_SALT = 0x9E3779B97F4A7C15

CELLS = "row int, segment long, part long, gaps binary, several binary"
ANSWERS = "part long, row int, segment long, gaps binary, counts binary"


def copy_by_part(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id long, text, part) of all rows, written once; rows of a part lie in one file."""
    return save(keyed(docs, F.spark_partition_id().cast("long")), name)


def keyed(docs: DataFrame, part: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"))


def cell_bits(n_keys: int) -> int:
    """log2 of the cells of a sketch row for about ``n_keys`` keys."""
    return max(SEGMENT_BITS[0], int(CELLS_PER_KEY * max(1, n_keys) - 1).bit_length())


def segment_bits(bits: int) -> int:
    """log2 of the cells of one segment of a sketch of ``bits``."""
    return min(max(SEGMENT_BITS[0], bits - SEGMENTS_BITS), SEGMENT_BITS[1])


def count_code(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: 1 stays 1, large ones are on a logarithmic scale."""
    scaled = EXACT_CODES + np.floor(8 * np.log2(np.maximum(counts, 1) / EXACT_CODES))
    return np.where(counts <= EXACT_CODES, counts, np.minimum(scaled, 255)).astype(np.uint8)


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys + np.uint64(_ROW_SALT * (row + 1) % 2**64)) >> np.uint64(64 - bits)


def encode_gaps(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as gaps of one or two bytes (the largest code adds on)."""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    kind = np.uint8 if len(gaps) and values[-1] / len(gaps) < 100 else np.uint16
    most = np.iinfo(kind).max
    more = gaps // most
    out = np.full(len(gaps) + int(more.sum()), most, dtype=kind)
    out[np.cumsum(more + 1) - 1] = gaps % most
    return bytes([kind().itemsize]) + out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, dtype=np.uint8 if data[0] == 1 else np.uint16, offset=1)
    return np.cumsum(codes, dtype=np.int64)[codes != np.iinfo(codes.dtype).max]


def sketch_records(part: int, keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(row, segment, part, gaps of the distinct cells, counts of those met several times) of one flush of a part's keys."""
    width = segment_bits(bits)
    for row in range(SKETCH_ROWS):
        cells, counts = np.unique(cells_of(keys, row, bits), return_counts=True)
        segments = (cells >> np.uint64(width)).astype(np.int64)
        edges = np.flatnonzero(np.diff(segments, prepend=-1, append=-1)) if len(cells) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            local = cells[a:b] & np.uint64((1 << width) - 1)
            several = np.flatnonzero(counts[a:b] > 1)
            yield row, int(segments[a]), part, encode_gaps(local), np.stack([several, counts[a:b][several]]).astype("<u4").tobytes()


def segment_cells(gaps: bytes, several: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a record and their counts."""
    cells = decode_gaps(gaps)
    counts = np.ones(len(cells), dtype=np.int64)
    at, more = np.frombuffer(several, dtype="<u4").reshape(2, -1)
    counts[at] = more
    return cells, counts


def _merge_segment(width: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << width, dtype=np.uint32)
        for gaps, several in zip(group["gaps"], group["several"], strict=True):
            cells, counts = segment_cells(gaps, several)
            total[cells] = np.minimum(total[cells] + counts, COUNT_CAP)
        out = []
        for part, own in group.groupby("part", sort=False):
            kept = np.unique(np.concatenate([c[total[c] > 1] for c in map(decode_gaps, own["gaps"])]))
            if len(kept):
                out.append((part, key[0], key[1], encode_gaps(kept), count_code(total[kept]).tobytes()))
        return pd.DataFrame(out, columns=["part", "row", "segment", "gaps", "counts"])
    return run


def write_by_part(df: DataFrame, name: str) -> str:
    """Write ``df`` as one folder per part in the shared folder; returns its path."""
    path = shared_folder(df.sparkSession, name)
    df.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def read_part(path: str, part: int):
    """The rows of one part of ``write_by_part`` as a pyarrow table, or None; for use in tasks."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, root = filesystem(f"{path}/part={part}")
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return None
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in sorted(files)]) if files else None


class Estimates:
    """Counts of a part's keys, from the answers of the merged sketch."""

    def __init__(self, path: str, part: int, bits: int):
        self.bits, self.rows = bits, []
        table = read_part(path, part)
        frame = table.to_pandas() if table is not None else pd.DataFrame(columns=["row", "segment", "gaps", "counts"])
        for row in range(SKETCH_ROWS):
            own = frame[frame["row"] == row].sort_values("segment", kind="stable")
            cells = [decode_gaps(g) + (s << segment_bits(bits)) for s, g in zip(own["segment"], own["gaps"], strict=True)]
            counts = [np.frombuffer(c, dtype=np.uint8) for c in own["counts"]]
            cells = np.concatenate(cells) if cells else np.zeros(0, dtype=np.int64)
            counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.uint8)
            if len(cells) and (np.diff(cells) < 0).any():
                order = np.argsort(cells, kind="stable")
                cells, counts = cells[order], counts[order]
            self.rows.append((cells, counts))

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Code (``count_code``) of each key's estimated count, never below the true one's; 1 if not repeated."""
        out = np.ones(len(keys), dtype=np.uint8)
        open_ = np.arange(len(keys))
        lowest = np.full(len(keys), 255, dtype=np.uint8)
        for row, (cells, counts) in enumerate(self.rows):
            if not len(cells) or not len(open_):
                return out
            wanted = cells_of(keys[open_], row, self.bits).astype(np.int64)
            at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            hit = cells[at] == wanted
            open_, at = open_[hit], at[hit]
            lowest[open_] = np.minimum(lowest[open_], counts[at])
        out[open_] = lowest[open_]
        return out


def part_blocks(batch, hasher: Hasher) -> Iterator[tuple[int, np.ndarray, TextBlock]]:
    """(part, doc ids with NULL_ID where null, block of texts) of an Arrow batch (doc_id, text, part)."""
    parts = batch.column("part").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1, append=parts[-1:] - 1)) if len(parts) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for block in text_blocks(batch.column("text").slice(a, b - a), hasher):
            yield int(parts[a]), ids[a + block.rows], block


def build(copy: DataFrame, keys_of: Callable, n_keys: int, name: str) -> tuple[str, int]:
    """Sketch all keys of ``copy`` and write the answers by part: (path, cell bits).

    ``keys_of(batches)`` yields (part, array of keys) from Arrow batches.
    """
    import pyarrow as pa

    bits = cell_bits(n_keys)

    def run(batches):
        schema = pa.schema([("row", pa.int32()), ("segment", pa.int64()), ("part", pa.int64()), ("gaps", pa.binary()),
                            ("several", pa.binary())])
        held, size, at = [], 0, None

        def flush():
            nonlocal held, size
            records = list(sketch_records(at, np.concatenate(held), bits)) if size else []
            held, size = [], 0
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records), schema.types, strict=True)],
                                                 schema=schema)

        for part, keys in keys_of(batches):
            if size and (part != at or size + len(keys) > FLUSH_KEYS):
                yield from flush()
            at = part
            held.append(keys)
            size += len(keys)
        yield from flush()

    merged = copy.mapInArrow(run, CELLS).groupBy("row", "segment").applyInPandas(
        _merge_segment(segment_bits(bits)), ANSWERS)
    return write_by_part(merged, name), bits
