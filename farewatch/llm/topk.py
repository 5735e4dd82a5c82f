"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are term lists (term = position, weight = quantised component).
Documents are dealt into ranges; in id order, each block of a range keeps a
forward index (ids and a weight matrix) and, per term, the largest and smallest
weight.
For a query, the block bound is the sum over terms of the larger product with
the two; no document of the block can score above it.  Each query visits the
blocks in order of falling bounds and stops when the bound is below its kth
score; blocks that tie with the kth score are still visited, as ties go to
smaller ids.

Work is a grid of (query group x document range) cells, both of fixed size, so
a task's memory does not grow with the table.  A cell returns k rows per query
at most; the cells' rows meet in one ranked window per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from farewatch.llm.common import save

K = 5
QUERY_EVERY = 50
SCALE = 256
# Sizes of a block, of a range (a cell's documents) and of a query group.
BLOCK_ROWS = 512
RANGE_ROWS = 8192
GROUP_ROWS = 2048
EXACT_IN_DOUBLE = 2**53


def quantise(embedding: Column, scale: int = SCALE) -> Column:
    """array<long> of floor(scale * x); null for null vectors and for null or non-finite components."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.array(cells.tolist(), dtype=np.int64)


def scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point only where every sum is exact."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(1, queries.shape[1])
    if bound < EXACT_IN_DOUBLE:
        return (queries.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
    return queries @ block.T


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
                block_rows: int = BLOCK_ROWS, visited: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of a document range for each query: (query_id, vec_id, score) arrays.

    ``visited`` (if given) collects the number of blocks scored per query.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.arange(0, len(ids), block_rows)
    blocks = [slice(s, s + block_rows) for s in starts]
    high = np.stack([vectors[b].max(axis=0) for b in blocks])
    low = np.stack([vectors[b].min(axis=0) for b in blocks])
    bounds = scores(np.maximum(queries, 0), high) + scores(np.minimum(queries, 0), low)
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    lowest = np.iinfo(np.int64).min + 1  # its negative exists
    best = np.full((len(queries), k), lowest)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    seen = np.zeros(len(queries), dtype=np.int64)
    active = np.arange(len(queries))
    for turn in range(len(blocks)):
        at = by_bound[active, turn]
        open_ = (bounds[active, at] >= best[active, -1]) | (who[active, -1] == np.iinfo(np.int64).max)
        active, at = active[open_], at[open_]
        if not len(active):
            break
        seen[active] += 1
        for b in np.unique(at):
            rows = active[at == b]
            found = scores(queries[rows], vectors[blocks[b]])
            names = np.broadcast_to(ids[blocks[b]], found.shape)
            own = names == query_ids[rows][:, None]
            pool_score = np.concatenate([best[rows], np.where(own, lowest, found)], axis=1)
            pool_id = np.concatenate([who[rows], np.where(own, np.iinfo(np.int64).max, names)], axis=1)
            top = np.lexsort((pool_id, -pool_score), axis=1)[:, :k]
            best[rows] = np.take_along_axis(pool_score, top, axis=1)
            who[rows] = np.take_along_axis(pool_id, top, axis=1)
    if visited is not None:
        visited.extend(seen.tolist())
    real = who != np.iinfo(np.int64).max
    return np.repeat(query_ids, k).reshape(who.shape)[real], who[real], best[real]


def _cell_task(k: int, block_rows: int):
    def run(queries: pd.DataFrame, documents: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(documents):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, v, s = search_cell(queries["id"].to_numpy(), _matrix(queries["v"]), documents["id"].to_numpy(),
                              _matrix(documents["v"]), k, block_rows)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})
    return run


def exact_top_k(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE,
                range_rows: int = RANGE_ROWS, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best scores of every query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``query_every``;
    candidates are all rows but those with the query's own vec_id.  Vectors
    that are null, or hold null or non-finite components, take no part, nor do
    rows without vec_id.  Rows that repeat a vec_id and its quantised vector are one;
    several vectors of a vec_id all take part, as candidates and as queries
    (a query's best are then those of all its vectors, and a candidate may be
    among them once for each pair).  Vectors meet only vectors of their own length.  A query with no
    candidate has no row; an empty table gives none.
    """
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("id"), quantise(F.col("embedding"), scale).alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"))
    rows = save(rows.distinct().withColumn("d", F.size("v")), "topk-vectors")
    is_query = F.col("id") % query_every == 0
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("queries")).first()
    ranges, groups = -(-n["all"] // range_rows) or 1, -(-n["queries"] // group_rows) or 1
    # A range's documents are a hash slice of the table, blocked by id order inside the cell.
    documents = (rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
                 .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    queries = (rows.where(is_query).withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int"))
               .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))))
    key = ["d", "g", "r"]
    found = (queries.groupBy(*key).cogroup(documents.groupBy(*key))
             .applyInPandas(_cell_task(k, block_rows), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE_SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= {K}"""
