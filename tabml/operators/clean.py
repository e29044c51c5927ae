"""A10-A12 ingestion checks: duplicate rows, row minimum, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """A data condition that stops the workflow (the reference's st.stop)."""


def drop_duplicate_rows(df: DataFrame, count_removed: bool = True):
    """A10: exact full-row dedupe; nulls compare equal.  Returns
    ``(deduped, n_removed)``; ``n_removed`` is None when not counted.

    ``dropDuplicates`` is a hash aggregate on all columns with a map-side
    partial step, so duplicate copies collapse before the shuffle.
    """
    out = df.dropDuplicates()
    if not count_removed:
        return out, None
    n_before = df.count()
    n_after = out.count()
    return out, n_before - n_after


def duplicate_report(df: DataFrame) -> DataFrame:
    """One-row table (rows, distinct_rows, removed) in a single job."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(
        F.sum("_n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_rows"),
    ).withColumn("removed", F.col("rows") - F.col("distinct_rows"))


def require_min_rows(df: DataFrame, minimum: int = 10) -> None:
    """Stop when fewer than ``minimum`` rows; reads at most that many."""
    n = df.limit(minimum).count()
    if n < minimum:
        raise DataError(f"Dataset has {n} rows; at least {minimum} are needed.")


def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First ``n`` rows by a key (ordered, so it is deterministic).
    Planned as TakeOrderedAndProject: a per-partition top-n, no full sort."""
    if isinstance(order_by, str):
        order_by = [order_by]
    return df.orderBy(*order_by).limit(n)
