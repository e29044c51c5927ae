"""Isolation forest outlier removal (Liu, Ting and Zhou, 2008).

* Sampling: every row draws a hash for every tree, and each tree keeps the
  ``max_samples`` rows with the smallest one, so each tree sees its own
  subsample of the whole table.  Only rows whose hash is below a bound that
  about three times as many pass become (tree, row) pairs.
* Growing: ``groupBy(tree).applyInPandas`` builds the trees in parallel (one
  small group of <= max_samples rows per tree).
* Scoring: the trees (trees x <= 2*max_samples nodes, a fixed bound) go to
  every task in the closure of a ``pandas_udf`` on the numeric columns, which
  scores Arrow batches with NumPy, level by level; no other column leaves the JVM.
* Cut: rows whose score is above the (1 - contamination) quantile of the
  scores are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cache import remember

EULER = 0.5772156649015329
#: Rows that enter the draw of a tree, as a multiple of its sample.
DRAW_FACTOR = 3
SCORE_COL = "_iso_score"


def avg_path(n):
    """c(n): average path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, cols, max_depth: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf[cols].to_numpy(dtype=float)
    rng = np.random.default_rng(seed * 100_003 + tree)
    nodes = []  # node, feature, threshold, left, right, size

    def build(idx, depth):
        node = len(nodes)
        nodes.append([node, -1, 0.0, -1, -1, len(idx)])
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[node][1], nodes[node][2] = f, t
        nodes[node][3] = build(left, depth + 1)
        nodes[node][4] = build(right, depth + 1)
        return node

    build(np.arange(len(X)), 0)
    out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
    out.insert(0, "tree", tree)
    return out


NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int"


def fit_isolation_forest(df: DataFrame, cols, key: str, n_trees: int = 100, max_samples: int = 256,
                         seed: int = 42, n_rows: int | None = None):
    """Returns a dict of NumPy arrays describing the forest plus the fill
    values (exact column medians) used for missing inputs."""
    from pyspark.sql import Window

    from ..functions.quantiles import column_quantiles
    n = n_rows if n_rows is not None else df.count()
    psi = min(max_samples, n)
    medians = column_quantiles(df, cols, [0.5])
    fills = [float(medians[c][0]) if medians[c][0] is not None else 0.0 for c in cols]
    rows = df.select(F.col(key).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in zip(cols, fills)])
    bound = int(min(1.0, DRAW_FACTOR * psi / max(n, 1)) * (1 << 62))

    def draw(tree):
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col("_key")), 2)

    drawn = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) <= bound)))
    # a tree's window holds DRAW_FACTOR * psi rows or so
    w = Window.partitionBy("tree").orderBy("_h", "_key")
    sample = drawn.withColumn("_h", draw(F.col("tree"))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    grown = sample.select("tree", *cols).groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, cols, max_depth, seed), NODE_SCHEMA)
    nodes = grown.toPandas()   # n_trees x < 2 psi rows: bounded by the parameters
    width = int(nodes["node"].max()) + 1
    shape = (n_trees, width)
    arr = {k: np.full(shape, -1 if k != "threshold" else 0.0, dtype=float if k == "threshold" else np.int64)
           for k in ["feature", "threshold", "left", "right", "size"]}
    t, nd = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    for k in arr:
        arr[k][t, nd] = nodes[k].to_numpy()
    return {"forest": arr, "fills": fills, "psi": psi, "cols": list(cols)}


def _depths(forest: dict) -> np.ndarray:
    """Depth of each node of each tree, from level to level."""
    depth = np.zeros(forest["feature"].shape)
    trees, nodes = np.arange(len(depth)), np.zeros(len(depth), dtype=np.int64)
    level = 0
    while len(trees):
        depth[trees, nodes] = level
        inner = forest["feature"][trees, nodes] >= 0
        trees, nodes = trees[inner], nodes[inner]
        trees, nodes = np.concatenate([trees, trees]), np.concatenate([forest["left"][trees, nodes], forest["right"][trees, nodes]])
        level += 1
    return depth


def score_batch(X: np.ndarray, forest: dict, psi: int) -> np.ndarray:
    feat, thr, size = (forest[k] for k in ["feature", "threshold", "size"])
    n_trees = feat.shape[0]
    total = np.zeros(len(X))
    depth = _depths(forest)
    # a leaf leads to itself, so that all rows go through a tree level by level; its length of path is known beforehand
    leaf, own = feat < 0, np.broadcast_to(np.arange(feat.shape[1]), feat.shape)
    column, left, right = np.where(leaf, 0, feat), np.where(leaf, own, forest["left"]), np.where(leaf, own, forest["right"])
    length = depth + avg_path(size)
    for part in (slice(i, i + 4096) for i in range(0, len(X), 4096)):
        flat, first = np.ascontiguousarray(X[part]).ravel(), np.arange(len(X[part])) * X.shape[1]
        for t in range(n_trees):
            node, (f, at, lower, upper) = np.zeros(len(first), dtype=np.int64), (column[t], thr[t], left[t], right[t])
            for _ in range(int(depth[t].max())):
                node = np.where(flat[first + f[node]] < at[node], lower[node], upper[node])
            total[part] += length[t, node]
    mean_path = total / n_trees
    return np.power(2.0, -mean_path / float(avg_path(np.array([psi]))[0] or 1.0))


def score(df: DataFrame, model: dict, out_col: str = SCORE_COL) -> DataFrame:
    """Anomaly score in (0, 1]; higher = more isolated."""
    cols, fills, forest, psi = model["cols"], model["fills"], model["forest"], model["psi"]

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(score_batch(x.to_numpy(dtype=float), forest, psi) if len(x) else [], dtype=float)

    filled = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(f"x{i}") for i, (c, v) in enumerate(zip(cols, fills))])
    return df.withColumn(out_col, run(filled))


def remove_outliers(df: DataFrame, cols, key: str = "_row_id", contamination: float = 0.05,
                    seed: int = 42, n_trees: int = 100, max_samples: int = 256, n_rows: int | None = None):
    """Returns (rows kept, number removed).  Skipped without numeric
    columns."""
    if not cols:
        return df, 0
    model = fit_isolation_forest(df, cols, key, n_trees, max_samples, seed, n_rows)
    scored = score(df, model).persist(StorageLevel.MEMORY_AND_DISK)
    stats = scored.agg(F.percentile_approx(SCORE_COL, 1.0 - contamination, 10_000).alias("cut"),
                       F.count(F.lit(1)).alias("n")).first()
    kept = scored.where(F.col(SCORE_COL) <= F.lit(stats["cut"])).drop(SCORE_COL)
    n_kept = kept.count()
    return remember(kept, scored, df), int(stats["n"] - n_kept)
