"""Isolation forest anomaly score (R2), distributed.

Liu, Ting, Zhou: "Isolation Forest", ICDM 2008.

Plan:
1. the rows are counted (all of them can be drawn by every tree);
2. per tree: a hash of (row, tree) keeps about 4x the tree's sample size of all
   rows; a row is replicated only for the trees that keep it, before the
   shuffle; the ``sample`` smallest hashes of a tree grow it;
3. all trees grow together, level by level: smallest and largest value of each
   feature per node, a non-constant feature and a threshold from a hash of
   (seed, tree, node), depth limit ceil(log2 sample).  The sample is dealt out
   by tree once and every level is a window over it; nothing random is left, so
   SQL grows the same forest;
4. the forest (at most trees x (2*sample - 1) nodes, checked) is broadcast and
   every row is scored by an Arrow pandas UDF: s = 2^(-E[h(x)] / c(sample)).

Contamination only shifts the decision function by a constant, which the
later min-max normalisation removes, so it is not needed here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from farewatch import constants as K

_EULER = 0.5772156649015329
# Draws of a row by the trees: (a + tree * b) modulo a prime, with a and b of 28 bits from the row's hash.
PRIME = 2**31 - 1

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.LongType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("psi", T.LongType()),
])


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + _EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _number(digest: Column, start: int, digits: int) -> Column:
    """The integer that some hexadecimal digits of a digest spell."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def draw_samples(features: DataFrame, cols: list[str], key: str, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """(tree, key, features): the ``psi`` rows of each tree with the smallest draws."""
    x = features.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    digest = _hash(F.lit(seed), F.col("key"))
    x = x.withColumn("a", _number(digest, 1, 7)).withColumn("b", _number(digest, 8, 7))
    most = int(min(1.0, 4.0 * psi / n) * PRIME)

    def draw(tree):
        return (F.col("a") + tree * F.col("b")) % PRIME

    trees = F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))
    kept = x.select("*", F.explode(F.filter(trees, lambda t: draw(t) <= most)).alias("tree")).withColumn("h", draw(F.col("tree")))
    # About 4 * psi rows of a tree are left; one exchange by tree serves the draw and every level.
    parts = max(1, min(n_trees, 2 * features.sparkSession.sparkContext.defaultParallelism))
    kept = kept.drop("a", "b").repartition(parts, "tree")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= psi).drop("rank", "h")


def grow_level(rows: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """Rows (tree, key, features, node, path) after every node that can be divided was: children of node i are 2i + 1 and 2i + 2."""
    node = Window.partitionBy("tree", "node")
    rows = rows.select("*", F.count(F.lit(1)).over(node).alias("size"), *[F.min(c).over(node).alias(f"lo_{c}") for c in cols],
                       *[F.max(c).over(node).alias(f"hi_{c}") for c in cols])
    varying = F.filter(F.array(*[F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.lit(i)) for i, c in enumerate(cols)]), lambda i: i.isNotNull())
    rows = rows.withColumn("varying", varying).withColumn("digest", _hash(F.lit(seed), F.col("tree"), F.col("node")))
    rows = rows.withColumn("feature", F.when((F.col("size") > 1) & (F.size("varying") > 0), F.get(
        "varying", (_number(F.col("digest"), 1, 8) % F.size("varying")).cast("int"))))

    def chosen(prefix: str) -> Column:
        return F.get(F.array(*[F.col(f"{prefix}{c}") for c in cols]), F.col("feature"))

    share = (_number(F.col("digest"), 9, 13).cast("double") + 0.5) / float(2**52)
    rows = rows.withColumn("threshold", chosen("lo_") + share * (chosen("hi_") - chosen("lo_")))
    step = F.array(F.struct("node", "feature", "threshold"))
    return rows.select(
        "tree", "key", *cols,
        F.when(F.col("feature").isNull(), F.col("node")).otherwise(
            2 * F.col("node") + F.when(chosen("") < F.col("threshold"), 1).otherwise(2)).alias("node"),
        F.when(F.col("feature").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"))


def grow_forest(samples: DataFrame, cols: list[str], psi: int, seed: int) -> DataFrame:
    """The node table (NODE_SCHEMA) of the trees grown from (tree, key, features)."""
    none = F.array().cast("array<struct<node: int, feature: int, threshold: double>>")
    rows = samples.select("tree", "key", *cols, F.lit(0).alias("node"), none.alias("path"))
    for _ in range(int(math.ceil(math.log2(max(psi, 2))))):
        rows = grow_level(rows, cols, seed)
    # A row names its leaf and every node above it; equal nodes of a tree are one.
    leaf = F.struct("node", F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"))
    nodes = (rows.select("tree", F.explode(F.concat("path", F.array(leaf))).alias("s")).select("tree", "s.*")
             .groupBy("tree", "node", "feature", "threshold").agg(F.count(F.lit(1)).alias("rows")))
    inner = F.col("feature") >= 0
    return nodes.select(
        "tree", "node", "feature", "threshold", F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("left"),
        F.when(inner, 2 * F.col("node") + 2).otherwise(-1).alias("right"), F.when(inner, -1).otherwise(F.col("rows")).cast("long").alias("size"),
        F.floor(F.log2(F.col("node") + 1.5)).cast("int").alias("depth"), F.lit(psi).cast("long").alias("psi"))


def fit_forest(features: DataFrame, cols=K.IFOREST_FEATURES, key: str = "passenger_id",
               n_trees: int = K.IFOREST_TREES, sample: int = K.IFOREST_SAMPLE,
               seed: int = K.IFOREST_SEED) -> pd.DataFrame:
    """Fit the forest; returns the (bounded) node table on the driver."""
    cols = list(cols)
    n = features.count()
    if n == 0:
        return pd.DataFrame(columns=[f.name for f in NODE_SCHEMA.fields])
    psi = min(sample, n)
    forest = grow_forest(draw_samples(features, cols, key, n, n_trees, psi, seed), cols, psi, seed).toPandas()
    bound = n_trees * (2 * psi - 1)
    if len(forest) > bound:
        raise RuntimeError(f"forest has {len(forest)} nodes, above the bound {bound}")
    return forest


def _pack(forest: pd.DataFrame) -> dict:
    forest = forest.sort_values(["tree", "node"])
    trees = sorted(forest["tree"].unique())
    width = int(forest.groupby("tree")["node"].max().max()) + 1
    shape = (len(trees), width)
    pack = {k: np.full(shape, fill, dtype=dt) for k, fill, dt in
            [("feature", -1, np.int32), ("threshold", 0.0, float), ("left", -1, np.int32),
             ("right", -1, np.int32), ("size", 0, np.int64), ("depth", 0, np.int32)]}
    pos = {t: i for i, t in enumerate(trees)}
    ti = forest["tree"].map(pos).to_numpy()
    ni = forest["node"].to_numpy()
    for k in pack:
        pack[k][ti, ni] = forest[k].to_numpy()
    pack["psi"] = int(forest["psi"].max())
    return pack


def path_lengths(x: np.ndarray, pack: dict) -> np.ndarray:
    """Mean path length over the forest for each row of x (vectorised)."""
    n_trees = pack["feature"].shape[0]
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in range(n_trees):
        feat, thr = pack["feature"][t], pack["threshold"][t]
        left, right = pack["left"][t], pack["right"][t]
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feat[node]
            inner = f >= 0
            if not inner.any():
                break
            fi = np.where(inner, f, 0)
            go_left = x[rows, fi] < thr[node]
            nxt = np.where(go_left, left[node], right[node])
            node = np.where(inner, nxt, node)
        total += pack["depth"][t][node] + c_factor(pack["size"][t][node])
    return total / n_trees


def score_forest(features: DataFrame, forest: pd.DataFrame, cols=K.IFOREST_FEATURES,
                 out: str = "anomaly_raw") -> DataFrame:
    """Raw anomaly score s in (0, 1] per row (higher = more anomalous)."""
    cols = list(cols)
    spark = features.sparkSession
    pack = spark.sparkContext.broadcast(_pack(forest))

    @F.pandas_udf(T.DoubleType())
    def s_udf(*series: pd.Series) -> pd.Series:
        p = pack.value
        x = np.column_stack([s.to_numpy(dtype=float) for s in series])
        h = path_lengths(x, p)
        return pd.Series(np.power(2.0, -h / c_factor([p["psi"]])[0]))

    args = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    return features.withColumn(out, s_udf(*args))


def anomaly_scores(features: DataFrame, key: str = "passenger_id", **kw) -> DataFrame:
    """R2 + R3: (key..., anomaly_raw, ml_score 0..100)."""
    from farewatch.operators.scoring import minmax_normalise
    from farewatch.session import cut_lineage

    keys = [c for c in ("upload_id", key) if c in features.columns]
    if len(keys) > 1:
        features = features.withColumn("_key", F.xxhash64(*keys))
        forest = fit_forest(features, key="_key", **kw)
    else:
        forest = fit_forest(features, key=key, **kw)
    if forest.empty:  # nothing to score: the right columns, no rows
        return minmax_normalise(features.select(*keys, F.lit(None).cast("double").alias("anomaly_raw")), "anomaly_raw", "ml_score")
    raw = score_forest(features.select(*keys, *K.IFOREST_FEATURES), forest).select(*keys, "anomaly_raw")
    raw = cut_lineage(raw)  # the UDF runs once; min/max and scores read the checkpoint
    return minmax_normalise(raw, "anomaly_raw", "ml_score")
