"""Cross-products of many columns, pairwise complete, as matrices.

With x a row's values less the columns' means (0 where missing) and m its mask of values, the sums of x'x, x'm, (x^2)'m and
m'm give the covariance of any two columns over the rows that have both, and each one's variance there.  A task adds
its batches to four matrices (columns squared); sums are merged in two steps, so the driver receives about as many as the square root
of the number of tasks.  No expression is made for a pair, so hundreds of columns will do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUMS = "xx binary, xm binary, sm binary, mm binary"
#: Columns whose means are one aggregate.
MEANS_AT_ONCE = 200


@dataclass
class Gram:
    """Sums over the rows that have both columns: products, first and second powers of the row's column, and rows."""

    xx: np.ndarray
    xm: np.ndarray
    sm: np.ndarray
    mm: np.ndarray

    def covariance(self) -> np.ndarray:
        """Population covariances, NaN without a common row."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.xx - self.xm * self.xm.T / self.mm) / self.mm

    def variance(self) -> np.ndarray:
        """Population variance of the row's column over the rows that have both."""
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = self.sm - self.xm * self.xm / self.mm
            # what is left of a column that is constant on these rows is rounding
            return np.where(spread <= 1e-14 * self.sm, 0.0, spread) / self.mm

    def correlation(self) -> np.ndarray:
        """Pearson's r; NaN where a column is constant."""
        var = self.variance()
        var = np.where(var > 0, var, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.covariance() / (np.sqrt(var) * np.sqrt(var.T))


def _sum_rows(d: int, means: np.ndarray):
    def work(batches):
        sums = [np.zeros((d, d)) for _ in range(4)]
        for pdf in batches:
            X = pdf.to_numpy(dtype=float) - means
            M = (~np.isnan(X)).astype(float)
            X = np.where(M > 0, X, 0.0)
            for total, part in zip(sums, (X.T @ X, X.T @ M, (X * X).T @ M, M.T @ M)):
                total += part
        yield pd.DataFrame([[s.tobytes() for s in sums]], columns=["xx", "xm", "sm", "mm"])
    return work


def _sum_sums(d: int):
    def work(batches):
        sums = [np.zeros(d * d) for _ in range(4)]
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                for total, part in zip(sums, row):
                    total += np.frombuffer(part)
        yield pd.DataFrame([[s.tobytes() for s in sums]], columns=["xx", "xm", "sm", "mm"])
    return work


def gram(df: DataFrame, cols) -> tuple[np.ndarray, Gram, np.ndarray]:
    """Means of numeric ``cols`` (booleans as 0/1; NaN without values), their cross-products, and which are constant (or without
    values): their products are rounding, not spread."""
    d, cols = len(cols), list(cols)
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    mean, flat = np.zeros(d), np.zeros(d, bool)
    for a in range(0, d, MEANS_AT_ONCE):
        of = range(a, min(d, a + MEANS_AT_ONCE))
        row = x.agg(*[e for i in of for e in (F.avg(f"c{i}").alias(f"m{i}"), (F.max(f"c{i}") > F.min(f"c{i}")).alias(f"v{i}"))]).first()
        for i in of:
            mean[i], flat[i] = np.nan if row[f"m{i}"] is None else row[f"m{i}"], not row[f"v{i}"]
    partial = x.mapInPandas(_sum_rows(d, np.nan_to_num(mean)), _SUMS)
    tasks = x.rdd.getNumPartitions()
    if tasks > 16:
        partial = partial.repartition(math.isqrt(tasks)).mapInPandas(_sum_sums(d), _SUMS)
    sums = [np.zeros((d, d)) for _ in range(4)]
    for r in partial.collect():
        for total, part in zip(sums, r):
            total += np.frombuffer(part).reshape(d, d)
    return mean, Gram(*sums), flat


def long_rows(cols, matrix: np.ndarray, flat: np.ndarray | None = None) -> list:
    """(col_a, col_b, value) of every ordered pair; null for NaN and, with ``flat``, for constant columns."""
    return [(a, b, None if np.isnan(matrix[i, j]) or (flat is not None and (flat[i] or flat[j])) else float(matrix[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
