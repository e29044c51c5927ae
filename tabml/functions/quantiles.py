"""Exact quantiles of many columns from one shuffle, at every size.

The values of all columns are unpivoted to (column, x) and counted per distinct value (partial sums on the
map side), running sums give every value its ranks, and only the two order statistics around each
position are kept:

    pos = p (n - 1);  q = x[floor(pos)] + (pos - floor(pos)) (x[ceil(pos)] - x[floor(pos)])

which is the linear interpolation of Spark's ``percentile`` and DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_sums


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column, x, n): how often each value of each column occurs (nulls left out)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols]))
    return (df.select(pairs.alias("p")).select("p.*").where(F.col("x").isNotNull())
            .groupBy("column", "x").agg(F.count(F.lit(1)).alias("n")))


def quantiles_of_counts(counts: DataFrame, probs) -> dict:
    """{column: [q(p) for p in probs]} of ``value_counts`` rows."""
    probs = [float(p) for p in probs]
    total = counts.groupBy("column").agg(F.sum("n").alias("size"))
    cum = prefix_sums(counts, "x", ["n"], group="column").join(F.broadcast(total), "column")
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    wanted, picks = F.lit(False), []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("size") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo, at_hi = (first <= lo) & (lo <= last), (first <= hi) & (hi <= last)
        wanted = wanted | at_lo | at_hi
        picks += [F.max(F.when(at_lo, F.col("x"))).alias(f"lo{i}"), F.max(F.when(at_hi, F.col("x"))).alias(f"hi{i}"),
                  F.max(pos - lo).alias(f"fr{i}")]
    out = {}
    # at most two rows per column and position reach this aggregate
    for r in cum.where(wanted).groupBy("column").agg(*picks).collect():
        out[r["column"]] = [r[f"lo{i}"] if r[f"fr{i}"] == 0 else r[f"lo{i}"] + r[f"fr{i}"] * (r[f"hi{i}"] - r[f"lo{i}"])
                            for i in range(len(probs))]
    return out


def exact_quantiles(df: DataFrame, cols, probs) -> dict:
    """{column: [q(p) for p in probs]} (Nones for an all-null column)."""
    cols = list(cols)
    if not cols:
        return {}
    counts = value_counts(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    found = quantiles_of_counts(counts, probs)
    counts.unpersist()
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def column_quantiles(df: DataFrame, cols, probs, approx: bool = False, accuracy: int = 10_000) -> dict:
    """{column: [q(p)...]}: exact, or Spark's sketch where the caller asks for ``approx``."""
    cols, probs = list(cols), [float(p) for p in probs]
    if not approx:
        return exact_quantiles(df, cols, probs)
    arr = F.array(*[F.lit(p) for p in probs])
    row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), arr, accuracy).alias(f"q{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"q{i}"] for i, c in enumerate(cols)}
