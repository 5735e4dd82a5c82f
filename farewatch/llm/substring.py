"""Substring deduplication: count-min prefilter, then exact grouping of the windows estimated repeated.

1. The texts are copied to the shared folder with their part number.
2. All windows of ``WINDOW`` words go through the distributed count-min sketch
   (``sketch``); most windows are unique and end here.
3. Windows estimated repeated are grouped exactly by a 96-bit key; a part sends
   each key once, with its smallest and largest document, so a window that a
   third of all documents share costs one row per part.
4. Each key's smallest document goes back to the parts; a last scan marks the
   covered words and writes the kept text.

Texts are scanned in place three times and never shuffled.
"""

from __future__ import annotations

from functools import cache
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from farewatch.llm import sketch
from farewatch.llm.common import WORD_PATTERN
from farewatch.llm.texthash import Hasher

WINDOW = 13
# k1 and k2 are a 96-bit key; span is the last document less the first (0 for most rows).
CANDIDATES = "k1 long, k2 int, part long, first long, span long"
KEPT = "doc_id long, n_words long, n_removed long, kept string"
FLUSH_CANDIDATES = 500_000


def _windows(block, hasher: Hasher, window: int):
    """(window hashes per seed, number of the text, number of the first word) of whole windows only."""
    owner = block.window_texts(window)
    whole = owner >= 0
    return [h[whole] for h in hasher.windows(block.hashes, window)], owner[whole], np.flatnonzero(whole)


def _sketch_keys(window: int):
    def keys_of(batches):
        hasher = Hasher(1)
        for batch in batches:
            for part, _, block in sketch.part_blocks(batch, hasher):
                (keys,), _, _ = _windows(block, hasher, window)
                yield part, keys
    return keys_of


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _reduce(k1, k2, ids):
    """One row per key: its smallest and largest document."""
    order = np.lexsort((ids, k2, k1))
    k1, k2, ids = k1[order], k2[order], ids[order]
    new = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    last = np.r_[new[1:], len(k1)] - 1
    return k1[new], k2[new], ids[new], ids[last]


def _candidate_task(path: str, bits: int, window: int):
    def run(batches):
        import pyarrow as pa

        hasher, at, estimates, held, size = Hasher(2), None, None, [], 0

        def flush():
            nonlocal held, size
            if size:
                k1, k2, first, last = _reduce(*(np.concatenate(x) for x in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2), pa.array(np.full(len(k1), at, dtype=np.int64)),
                     pa.array(first), pa.array(last - first)], names=["k1", "k2", "part", "first", "span"])
            held, size = [], 0

        for batch in batches:
            for part, ids, block in sketch.part_blocks(batch, hasher):
                if part != at:
                    yield from flush()
                    at, estimates = part, sketch.Estimates(path, part, bits)
                (k1, k2), owner, _ = _windows(block, hasher, window)
                doc = ids[owner]
                hit = (estimates.count(k1) > 1) & (doc != sketch.NULL_ID)
                held.append((k1[hit], short(k2[hit]), doc[hit]))
                size += int(hit.sum())
                if size >= FLUSH_CANDIDATES:
                    yield from flush()
        yield from flush()
    return run


def _remove_task(path: str, window: int):
    def run(batches):
        import pyarrow as pa

        hasher, at, keys = Hasher(2), None, None
        for batch in batches:
            for part, ids, block in sketch.part_blocks(batch, hasher):
                if part != at:
                    table = sketch.read_part(path, part)
                    keys = [np.zeros(0, dtype=np.int64)] * 3 if table is None else [
                        table.column(c).to_numpy() for c in ("k1", "k2", "first")]
                    at, keys = part, [k[np.argsort(keys[0], kind="stable")] for k in keys]
                covered = np.zeros(len(block.starts) + 1, dtype=np.int32)
                if len(keys[0]):
                    (k1, k2), owner, at_word = _windows(block, hasher, window)
                    k1, k2 = k1.view(np.int64), short(k2)
                    place = np.minimum(np.searchsorted(keys[0], k1), len(keys[0]) - 1)
                    gone = at_word[(keys[0][place] == k1) & (keys[1][place] == k2) & (keys[2][place] < ids[owner])]
                    np.add.at(covered, gone, 1)
                    np.add.at(covered, gone + window, -1)
                kept = np.cumsum(covered)[:-1] == 0
                words = np.diff(block.first)
                removed = words - np.diff(np.r_[0, np.cumsum(kept)][block.first])
                texts = []
                for i in range(len(block.rows)):
                    a, b = block.first[i], block.first[i + 1]
                    own = block.data[block.starts[a]:block.ends[b - 1]].tobytes().split() if b > a else []
                    texts.append(b" ".join(compress(own, kept[a:b].tolist()) if removed[i] else own).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == sketch.NULL_ID), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)),
                     pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document without the words of windows that start in an earlier document.

    Columns: doc_id, n_words, n_removed, kept (kept words joined by a space).
    "Earlier" is a smaller doc_id; windows are judged on the input.  A null text
    has no words; documents shorter than a window stay whole; rows that share a
    doc_id do not remove each other's words; rows with a null doc_id neither
    remove nor lose words; an empty table gives no rows.  Other columns are not read.
    """
    copy = sketch.copy_by_part(docs, "substring-copy")
    n_bytes = copy.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About one window a word; words of six bytes with their space (sizing only).
    path, bits = sketch.build(copy, _sketch_keys(window), n_bytes // 6, "substring-estimates")
    candidates = copy.mapInArrow(_candidate_task(path, bits, window), CANDIDATES)
    first = F.min("first").over(Window.partitionBy("k1", "k2"))
    answers = (candidates.withColumn("last", F.col("first") + F.col("span")).withColumn("first", first)
               .where(F.col("first") < F.col("last")).select("part", "k1", "k2", "first"))
    return copy.mapInArrow(_remove_task(sketch.write_by_part(answers, "substring-first"), window), KEPT)


@cache
def oracle_sql(window: int = WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM w WHERE len(ws) >= {window})),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS pos
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
