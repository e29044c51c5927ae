"""E5 for three and more classes: one machine for every pair of classes, calibrated, and coupled.

* Every pair (i, j) has a squared-hinge machine on the random Fourier features of the rows of both classes, once
  on all rows and once without each fold.  An active-set Newton step of all machines is ONE pass over the rows: Gram
  matrices of the rows within the margin, summed in two levels; the D x D solves happen on the driver.
* Platt's sigmoid of a pair is fitted by Newton steps to the margins of held-out rows (each by the machine that has not
  seen its fold), or to the log odds they stand for, whichever has less log loss there, its targets smoothed by the class counts; six sums a pair and pass.
* The pairs' probabilities r_ij are coupled to those of the classes: the p of sum 1 that minimises
  sum (r_ji p_i - r_ij p_j)^2 (Wu, Lin and Weng, 2004).  The class predicted is that of the most pairs, ties by the
  sum of their margins.

A class without rows in a pair leaves a constant machine; its pairs count for the other class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 3
#: Machines whose matrices (D x D doubles each) a pass holds at once.
AT_ONCE = 24
NEWTON_STEPS = 30
#: Rows that are coupled at once, and that a task lifts at once (whatever the batches that Spark hands to it).
ROWS = 1000
LIFTED = 1024


def _p(name, doc, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


def _sigmoid(u: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(u, -500, 500)))


def log_odds(margins: np.ndarray) -> np.ndarray:
    """The squared hinge is least at 2p - 1: the log odds that a margin stands for, those of 0.005 at the ends."""
    m = np.clip(margins, -0.99, 0.99)
    return np.log((1.0 + m) / (1.0 - m))


def summed(rows: DataFrame, add, size: int) -> np.ndarray:
    """What ``add(total, batch)`` adds up to over all rows, ``LIFTED`` of them at a time: one array a task, merged in two levels."""
    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, len(batch), LIFTED):
                add(total, batch.iloc[at:at + LIFTED])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def merged(batches):
        total = np.zeros(size)
        for batch in batches:
            for blob in batch["sums"]:
                total += np.frombuffer(blob)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    level = rows.mapInPandas(partial, "sums binary")
    level = level.repartition(max(1, int(rows.rdd.getNumPartitions() ** 0.5))).mapInPandas(merged, "sums binary")
    return np.frombuffer(level.repartition(1).mapInPandas(merged, "sums binary").first()[0])


def fit_machines(rows: DataFrame, lift, size: int, problems: list, C: float, steps: int = NEWTON_STEPS) -> np.ndarray:
    """Weights (the last one the intercept) of every problem (class for +1, class for -1, fold left out or -1)."""
    weights = np.zeros((len(problems), size))
    penalty = np.eye(size) / (2.0 * C)
    penalty[-1, -1] = 1e-10
    block = size * size + size
    for first in range(0, len(problems), AT_ONCE):
        open_ = list(range(first, min(first + AT_ONCE, len(problems))))
        for _ in range(steps):
            now = [(problems[q], weights[q].copy()) for q in open_]

            def add(total, batch, now=now):
                Z, y, fold = lift(batch["x"]), batch["y"].to_numpy(), batch["fold"].to_numpy()
                for k, ((i, j, out), w) in enumerate(now):
                    of = np.flatnonzero(((y == i) | (y == j)) & (fold != out))
                    t = np.where(y[of] == i, 1.0, -1.0)
                    inside = t * (Z[of] @ w) < 1.0
                    A = Z[of[inside]]
                    total[k * block:k * block + size * size] += (A.T @ A).ravel()
                    total[k * block + size * size:(k + 1) * block] += A.T @ t[inside]

            sums = summed(rows, add, block * len(open_)).reshape(len(open_), block)
            still = []
            for q, s in zip(open_, sums):
                new = np.linalg.solve(s[:size * size].reshape(size, size) + penalty, s[size * size:])
                if not np.allclose(new, weights[q], rtol=1e-6, atol=1e-8):
                    still.append(q)
                weights[q] = new
            open_ = still
            if not open_:
                break
    return weights


def fit_sigmoids(rows: DataFrame, lift, pairs: list, held_out: np.ndarray, steps: int = NEWTON_STEPS) -> np.ndarray:
    """Slope, intercept and kind (0: of the margin, 1: of its log odds) of every pair's sigmoid: both kinds by Newton
    steps with halving, the one of less log loss is kept; ``held_out[fold, pair]`` are weights."""
    P = len(pairs)

    def counted(total, batch):
        y = batch["y"].to_numpy()
        for k, (i, j) in enumerate(pairs):
            total[2 * k:2 * k + 2] += (y == i).sum(), (y == j).sum()

    n = summed(rows, counted, 2 * P).reshape(P, 2)
    high, low = (n[:, 0] + 1) / (n[:, 0] + 2), 1 / (n[:, 1] + 2)
    best = np.zeros((P, 2, 2))
    best[:, :, 1] = np.log((n[:, :1] + 1) / (n[:, 1:] + 1))
    now, step, least = best.copy(), np.zeros((P, 2, 2)), np.full((P, 2), np.inf)
    for _ in range(steps):
        def add(total, batch, now=now):
            Z, y, fold = lift(batch["x"]), batch["y"].to_numpy(), batch["fold"].to_numpy()
            for k, (i, j) in enumerate(pairs):
                of = np.flatnonzero((y == i) | (y == j))
                margin = np.einsum("nd,nd->n", Z[of], held_out[fold[of], k])
                t = np.where(y[of] == i, high[k], low[k])
                for kind, m in enumerate((margin, log_odds(margin))):
                    u = now[k, kind, 0] * m + now[k, kind, 1]
                    p = _sigmoid(u)
                    v = p * (1.0 - p)
                    at = 6 * (2 * k + kind)
                    total[at:at + 6] += (np.logaddexp(0.0, u) - t * u).sum(), (m * (p - t)).sum(), (p - t).sum(), \
                        (m * m * v).sum(), (m * v).sum(), v.sum()

        for at, (loss, ga, gb, haa, hab, hbb) in zip(np.ndindex(P, 2), summed(rows, add, 12 * P).reshape(-1, 6)):
            if loss <= least[at]:
                best[at], least[at] = now[at], loss
                step[at] = -np.linalg.solve([[haa + 1e-12, hab], [hab, hbb + 1e-12]], [ga, gb])
            else:
                step[at] /= 2
        if (np.abs(step) <= 1e-9 * (1 + np.abs(best))).all():
            break
        now = best + step
    kind = least.argmin(1)
    return np.column_stack([best[np.arange(P), kind], kind])


def calibrated(margins: np.ndarray, sigmoids: np.ndarray) -> np.ndarray:
    """The probability of every pair's first class, from ``margins[row, pair]``."""
    m = np.where(sigmoids[:, 2] == 1, log_odds(margins), margins)
    return _sigmoid(m * sigmoids[:, 0] + sigmoids[:, 1])


def coupled(r: np.ndarray, pairs: list, classes: int) -> np.ndarray:
    """Class probabilities from ``r[row, pair]``, the probability of the pair's first class."""
    R = np.zeros((len(r), classes, classes))
    for k, (i, j) in enumerate(pairs):
        R[:, i, j] = np.clip(r[:, k], 1e-7, 1 - 1e-7)
        R[:, j, i] = 1.0 - R[:, i, j]
    # stationary point under the sum: [Q e; e' 0] [p; multiplier] = [0; 1]
    M = np.zeros((len(r), classes + 1, classes + 1))
    M[:, :classes, :classes] = -R.transpose(0, 2, 1) * R
    at = np.arange(classes)
    M[:, at, at] = (R ** 2).sum(1)
    M[:, :classes, classes] = M[:, classes, :classes] = 1.0
    right = np.zeros((len(r), classes + 1, 1))
    right[:, classes] = 1.0
    p = np.maximum(np.linalg.solve(M, right)[:, :classes, 0], 0.0)
    return p / p.sum(1, keepdims=True)


class CoupledPairs(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """rawPrediction (pairs won, ties by margins), probability and prediction from the lifted features."""
    inputCol = _p("inputCol", "vector column of the lifted features", TypeConverters.toString)
    nClasses = _p("nClasses", "number of classes", TypeConverters.toInt)
    weights = _p("weights", "row-major weights of every pair, intercept last", TypeConverters.toListFloat)
    sigmoids = _p("sigmoids", "slope, intercept and kind of every pair", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol="z", nClasses=3, weights=None, sigmoids=None, predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        K = self.getOrDefault(self.nClasses)
        pairs = list(combinations(range(K), 2))
        W = np.asarray(self.getOrDefault(self.weights)).reshape(len(pairs), -1)
        S = np.asarray(self.getOrDefault(self.sigmoids)).reshape(-1, 3)

        @F.pandas_udf("raw array<double>, probability array<double>")
        def scored(zs: pd.Series) -> pd.DataFrame:
            raw, probability = [], []
            for a in range(0, len(zs), ROWS):
                m = np.stack(zs.iloc[a:a + ROWS].to_numpy()) @ W[:, :-1].T + W[:, -1]
                votes, total = np.zeros((len(m), K)), np.zeros((len(m), K))
                for k, (i, j) in enumerate(pairs):
                    votes[:, i] += m[:, k] > 0
                    votes[:, j] += m[:, k] <= 0
                    total[:, i] += m[:, k]
                    total[:, j] -= m[:, k]
                raw.extend(votes + total / (3 * (np.abs(total) + 1)))
                probability.extend(coupled(calibrated(m, S), pairs, K))
            return pd.DataFrame({"raw": raw, "probability": probability})

        names = df.columns
        both = df.withColumn("__scored", scored(vector_to_array(self.getOrDefault(self.inputCol))))
        raw = F.col("__scored.raw")
        out = {"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.col("__scored.probability")),
               self.getPredictionCol(): (F.array_position(raw, F.array_max(raw)) - 1).cast("double")}
        return both.select(*[f"`{c}`" for c in names if c not in out], *[v.alias(c) for c, v in out.items()])


def fit_pairs(df: DataFrame, features_col: str, label_col: str, rff, classes: int, C: float, prediction_col: str) -> CoupledPairs:
    """The calibrated machines of all pairs over ``rff`` (a fitted lift with ``lift`` and ``outputCol``)."""
    x = vector_to_array(features_col)
    rows = df.select(x.alias("x"), F.col(label_col).cast("double").alias("y"),
                     F.pmod(F.xxhash64(x), F.lit(FOLDS)).cast("int").alias("fold")).persist(StorageLevel.MEMORY_AND_DISK)
    raised = rff.lift()

    def lift(xs: pd.Series) -> np.ndarray:
        Z = raised(np.stack(xs.to_numpy()))
        return np.column_stack([Z, np.ones(len(Z))])

    size = rff.size() + 1
    pairs = list(combinations(range(classes), 2))
    problems = [(i, j, out) for out in (-1, *range(FOLDS)) for i, j in pairs]
    weights = fit_machines(rows, lift, size, problems, C).reshape(FOLDS + 1, len(pairs), size)
    sigmoids = fit_sigmoids(rows, lift, pairs, weights[1:])
    rows.unpersist()
    return CoupledPairs(inputCol=rff.getOrDefault(rff.outputCol), nClasses=classes, weights=weights[0].ravel().tolist(),
                        sigmoids=sigmoids.ravel().tolist(), predictionCol=prediction_col)
