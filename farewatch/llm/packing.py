"""Token-id output: best-fit-decreasing packing of documents into rows of fixed length.

Every document becomes the token ids of its whole text and an end id.  Ids
beyond a row's length are split off as full rows, without loss; the rests are
packed, longest first, each into the fullest row that still has room.  The
search for that row is a segment tree over remaining capacities, log2(length)
steps.

A task packs its own documents in blocks of bounded size, so nothing is
shuffled and a task's memory does not depend on its input.  The rows are
written as a Parquet table of binary little-endian matrices' rows with the
cumulative segment lengths and the positions, which restart in every segment.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from farewatch.llm.common import save

ROW_LENGTH = 2048
# Rests packed together: this many ids at most.
BLOCK_IDS = 4_000_000
# Packed rows that leave a task together.
SENT_ROWS = 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of the vocabulary: how texts are pre-split, and the free id that ends a document.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
# White-space runs of this length are cut out before the pattern is applied: its look-ahead
# walks back over a run one character at a time, and the engine's stack ends near a million.
LONG_RUN = 50_000
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

PACKED = ("part int, row long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
          "piece_offsets array<long>, n_tokens int")


class CapacityTree:
    """Open rows by remaining capacity; finds the smallest capacity that holds a length."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._step(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the tightest open row with room for ``need``."""
        node = need + self.leaves
        count = self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._step(capacity, -1)
        return capacity, self.rows[capacity].pop()

    def _step(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], row_length: int) -> list[list[int]]:
    """Rows of item numbers; every length must be in 1..row_length.  Equal lengths keep their order."""
    tree, rows = CapacityTree(row_length), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        if found is None:
            capacity, row = row_length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(item)
        if capacity > lengths[item]:
            tree.add(capacity - lengths[item], row)
    return rows


def load_encoding(vocabulary: bytes):
    """The byte-level BPE of a rank file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoding, text: str) -> np.ndarray:
    """Token ids of a text of any length.

    The pattern makes one piece of a white-space run at the end of a text, and of all
    but its last character before something else; a long run is cut there and
    encoded as that one piece, so the ids are those of the whole text.
    """
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out.append(encoding.encode_to_numpy(text[at:run.start()], disallowed_special=()))
        out.append(np.array(encoding._core_bpe.encode_single_piece(text[run.start():end].encode("utf-8")), dtype=np.uint32))
        at = end
    out.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(out) if len(out) > 1 else out[0]


def id_type(row_length: int, end_id: int):
    return np.dtype("<u2" if max(row_length, end_id + 1) <= 1 << 16 else "<u4")


def _pack_task(vocabulary: bytes, row_length: int, end_id: int, block_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoding, kind = TaskContext.get().partitionId(), load_encoding(vocabulary), id_type(row_length, end_id)
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
        names = [f.split()[0] for f in PACKED.split(", ")]
        rows, rests, held, number = [], [], 0, 0

        def add(pieces):
            nonlocal number
            ids = np.full(row_length, end_id, dtype=kind)
            places = np.zeros(row_length, dtype=kind)
            ends = np.cumsum([0, *(len(p[2]) for p in pieces)])
            for (_, _, own), a, b in zip(pieces, ends[:-1], ends[1:], strict=True):
                ids[a:b] = own
                places[a:b] = np.arange(b - a)
            rows.append((part, number, ids.tobytes(), places.tobytes(), ends.astype(np.int32), [p[0] for p in pieces],
                         [p[1] for p in pieces], int(ends[-1])))
            number += 1

        def batch_of():
            nonlocal rows
            done, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        def pack():
            nonlocal rests, held
            done, rests, held = rests, [], 0
            for members in best_fit_decreasing([len(r[2]) for r in done], row_length):
                add([done[i] for i in members])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode_text(encoding, text.as_py() or "").astype(kind)
                ids = np.append(ids, np.array([end_id], dtype=kind))
                whole = len(ids) // row_length * row_length
                for a in range(0, whole, row_length):
                    add([(doc, a, ids[a:a + row_length])])
                    if len(rows) >= SENT_ROWS:
                        yield batch_of()
                if whole < len(ids):
                    rests.append((doc, whole, ids[whole:]))
                    held += len(ids) - whole
                if held >= block_ids:
                    pack()
                if len(rows) >= SENT_ROWS:
                    yield batch_of()
        pack()
        if rows:
            yield batch_of()
    return run


def packed_rows(docs: DataFrame, vocabulary: str = VOCABULARY, row_length: int = ROW_LENGTH, end_id: int = END_ID,
                block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows (PACKED) of all documents, to be written once by the caller.

    ``input_ids`` and ``position_ids`` are ``row_length`` unsigned integers of
    two bytes (four if ids or lengths need it); places after ``cu_seqlens[-1]``
    hold the end id and position 0.  Segment i is ids
    ``cu_seqlens[i]:cu_seqlens[i + 1]`` of document ``doc_ids[i]``, starting at
    the document's id number ``piece_offsets[i]``.  A null text counts as empty;
    an empty text is the end id alone, so every row of ``docs`` (repeated ids
    and null ids included) is found in the result; an empty table gives no rows.
    Texts and runs of one kind of character may have any length (a task holds one
    text and its ids).  Other columns are not read.  ``vocabulary`` is a local rank file, read by the
    driver (under 1 MB) and sent to the tasks.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pack_task(content, row_length, end_id, block_ids), PACKED)


def pack_tokens(docs: DataFrame, **options) -> DataFrame:
    """``packed_rows``, written to the shared folder and read from there."""
    return save(packed_rows(docs, **options), "packed-ids")


def packed_digests(packed: DataFrame) -> DataFrame:
    """What the query reports of each packed row, read back from the written table."""
    return packed.select("part", "row", "n_tokens", (F.size("cu_seqlens") - 1).alias("n_segments"), "cu_seqlens", "doc_ids",
                         "piece_offsets", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def read_matrix(packed: DataFrame, column: str = "input_ids", row_length: int = ROW_LENGTH, end_id: int = END_ID) -> np.ndarray:
    """A small packed table's ids (or positions) as one matrix, for tests and inspection."""
    cells = [bytes(r[column]) for r in packed.orderBy("part", "row").select(column).collect()]
    return np.frombuffer(b"".join(cells), dtype=id_type(row_length, end_id)).reshape(-1, row_length)
