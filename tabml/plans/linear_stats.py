"""Grid points of the linear family from sufficient statistics.

A linear, ridge, lasso or elastic-net fit needs no rows but the centred cross-products of features and label, and so
does its R2 on other rows.  One pass gives them for every fold; a fold's training part is the sum of the others, and
all grid points of all folds are solved from matrices of the size (features + 1) squared.

Partial sums are made in tasks with a running mean (no cancellation for data far from 0) and are merged in two steps, so the driver
receives about as many matrices as the square root of the number of tasks, for each fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models that ``solve`` fits.
LINEAR_FAMILY = ("Linear Regression", "Ridge", "Lasso", "ElasticNet")
_PARTIAL = "fold int, n double, mean binary, cross binary"


@dataclass
class Moments:
    """Number of rows, means and centred cross-products of the columns (features, label)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, Z: np.ndarray) -> "Moments":
        mean = Z.mean(axis=0)
        return cls(float(len(Z)), mean, (Z - mean).T @ (Z - mean))

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))


def _merge(into: dict, fold: int, m: Moments) -> None:
    into[fold] = into[fold] + m if fold in into else m


def _rows(found: dict) -> pd.DataFrame:
    return pd.DataFrame([(f, m.n, m.mean.tobytes(), m.cross.tobytes()) for f, m in found.items()], columns=["fold", "n", "mean", "cross"])


def _read(fold, n, mean, cross) -> tuple[int, Moments]:
    mean = np.frombuffer(mean)
    return int(fold), Moments(float(n), mean, np.frombuffer(cross).reshape(len(mean), len(mean)))


def _sum_rows(batches):
    found: dict = {}
    for pdf in batches:
        folds = pdf["fold"].to_numpy()
        for f in np.unique(folds):
            mine = pdf[folds == f]
            X = np.stack([np.asarray(v, dtype=float) for v in mine["x"]])
            _merge(found, int(f), Moments.of(np.column_stack([X, mine["y"].to_numpy(dtype=float)])))
    yield _rows(found)


def _sum_partials(batches):
    found: dict = {}
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            _merge(found, *_read(*row))
    yield _rows(found)


def moments(df: DataFrame, fold_col: str | None = None, features_col: str = "features", label_col: str = "label") -> dict[int, Moments]:
    """The moments of each value of ``fold_col`` (0 without one), in one pass.  Rows without a label are left out."""
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    x = df.select(fold.alias("fold"), vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL")
    tasks = x.rdd.getNumPartitions()
    partial = x.mapInPandas(_sum_rows, _PARTIAL)
    if tasks > 16:
        partial = partial.repartition(math.isqrt(tasks)).mapInPandas(_sum_partials, _PARTIAL)
    found: dict = {}
    for row in sorted(partial.collect(), key=lambda r: (r.fold, r.n, bytes(r.mean))):
        _merge(found, *_read(*row))
    return found


def solve(m: Moments, name: str, alpha: float = 1.0, l1_ratio: float = 0.5, tol: float = 1e-13, rounds: int = 100_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept: least squares; ridge with ``|y - Xw|^2 + alpha |w|^2``; lasso and elastic net with
    ``|y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2`` (lasso: l1 = 1), by coordinate descent."""
    S, c = m.cross[:-1, :-1] / m.n, m.cross[:-1, -1] / m.n
    d = len(c)
    if name == "Linear Regression":
        w = np.linalg.lstsq(S, c, rcond=None)[0]
    elif name == "Ridge":
        w = np.linalg.solve(S + np.eye(d) * (alpha / m.n), c) if alpha > 0 else np.linalg.lstsq(S, c, rcond=None)[0]
    else:
        l1 = alpha * (1.0 if name == "Lasso" else l1_ratio)
        l2 = 0.0 if name == "Lasso" else alpha * (1.0 - l1_ratio)
        w, slope, scale = np.zeros(d), np.zeros(d), np.diag(S) + l2  # slope = S w
        for _ in range(rounds):
            most = 0.0
            for j in range(d):
                if scale[j] <= 0:
                    continue
                rest = c[j] - slope[j] + S[j, j] * w[j]
                new = math.copysign(max(abs(rest) - l1, 0.0), rest) / scale[j]
                if new != w[j]:
                    most = max(most, abs(new - w[j]) * math.sqrt(S[j, j]))
                    slope += S[:, j] * (new - w[j])
                    w[j] = new
            if most <= tol * math.sqrt(max(m.cross[-1, -1] / m.n, 1e-300)):
                break
    return w, float(m.mean[-1] - w @ m.mean[:-1])


def r2(m: Moments, w: np.ndarray, intercept: float) -> float:
    """R2 of a linear model on the rows of ``m``; without spread of the label 1 if all are met, else 0."""
    off = m.mean[-1] - intercept - w @ m.mean[:-1]
    total = m.cross[-1, -1]
    rest = max(0.0, total - 2 * w @ m.cross[:-1, -1] + w @ m.cross[:-1, :-1] @ w) + m.n * off * off
    if total <= 0:
        return 1.0 if rest <= 0 else 0.0
    return float(1 - rest / total)


def grid_scores(train: Moments, validation: Moments, name: str, grid: list[dict]) -> list[float]:
    """R2 on the validation rows of every grid point fitted on the training rows."""
    return [r2(validation, *solve(train, name, **{k: float(v) for k, v in point.items()})) for point in grid]


def grid_by_folds(folds: dict[int, Moments], name: str, grid: list[dict]) -> list[list[float]]:
    """Scores (grid points x folds) where all folds have the same features: the training part of a fold is the sum of the others."""
    out = []
    for f in sorted(folds):
        train = None
        for g, m in folds.items():
            if g != f:
                train = m if train is None else train + m
        out.append(grid_scores(train, folds[f], name, grid))
    return [list(x) for x in zip(*out)]
