"""Exploratory tables.  Each operator is one (or two) aggregate jobs
over the whole table, then a free unpivot of the single result row."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (column_roles, datetime_columns, is_datetime,
                                 numeric_columns, string_columns)
from ..functions.quantiles import column_quantiles, quantiles_of_counts, value_counts
from ..functions.stack import unpivot_wide
from .gram import gram, long_rows

QUANTILE_ACCURACY = 10_000


def _numeric(df, cols):
    cols = cols if cols is not None else numeric_columns(df, include_bool=True)
    return cols


def _as_double(c: str):
    return F.col(c).cast("double")


def column_summary(df: DataFrame) -> DataFrame:
    """B1 (df.info): column, dtype, non_null, in schema order (position)."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(f"{c}__non_null") for c in cols])
    long = unpivot_wide(wide, cols, ["non_null"])
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    return (long.join(F.broadcast(types), "column")
            .select("position", "column", "dtype", F.col("non_null").cast("bigint").alias("non_null")))


def missing_values(df: DataFrame) -> DataFrame:
    """B2: null count per column (NaN was turned into null at load)."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__missing") for c in cols])
    return unpivot_wide(wide, cols, ["missing"]).select(
        "column", F.coalesce(F.col("missing"), F.lit(0)).cast("bigint").alias("missing"))


def histograms(df: DataFrame, cols=None, bins: int = 30) -> DataFrame:
    """Equal-width histogram per numeric column -> column, bin, lo, hi, n.

    Pass 1: min/max of every column in one aggregate.  Pass 2: the rows are
    unpivoted to (column, value) inside the scan stage and counted per
    (column, bin); the partial aggregate leaves at most cols x bins rows per
    task before the shuffle.  Empty bins are not listed.
    """
    cols = _numeric(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, n bigint")
    rng = df.agg(*[F.min(_as_double(c)).alias(f"{c}__lo") for c in cols],
                 *[F.max(_as_double(c)).alias(f"{c}__hi") for c in cols]).first()
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_double(c).alias("x"),
                 F.lit(rng[f"{c}__lo"]).cast("double").alias("lo"),
                 F.lit(rng[f"{c}__hi"]).cast("double").alias("hi"))
        for c in cols]))
    long = df.select(pairs.alias("p")).select("p.*").where(F.col("x").isNotNull())
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    binned = long.withColumn(
        "bin",
        F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int"))
    counts = binned.groupBy("column", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return counts.select(
        "column", "bin",
        (F.col("lo") + F.col("bin") * w).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("hi"),
        F.col("n").cast("bigint").alias("n"))


def box_stats(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Min, q1, median, q3, max, whiskers (furthest values within 1.5 IQR)
    and outlier count per numeric column.  Two aggregate jobs in total.

    Exact linear-interpolated percentiles (the reference's definition), or the
    bounded-memory sketch with ``approx=True``.
    """
    cols = _numeric(df, cols)
    quartiles = column_quantiles(df, cols, [0.25, 0.5, 0.75], approx, QUANTILE_ACCURACY)
    aggs = []
    for c in cols:
        x = _as_double(c)
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    first = df.agg(*aggs).first().asDict()
    for c, qs in quartiles.items():
        first[f"{c}__q"] = None if not qs or qs[0] is None else qs
    fences = {}
    for c in cols:
        qs = first[f"{c}__q"]
        if qs is None:
            fences[c] = (None, None)
            continue
        iqr = qs[2] - qs[0]
        fences[c] = (qs[0] - 1.5 * iqr, qs[2] + 1.5 * iqr)
    aggs2 = []
    for c in cols:
        x = _as_double(c)
        lo, hi = fences[c]
        if lo is None:
            aggs2 += [F.lit(None).cast("double").alias(f"{c}__wl"), F.lit(None).cast("double").alias(f"{c}__wh"),
                      F.lit(0).cast("long").alias(f"{c}__no")]
            continue
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs2 += [F.min(F.when(inside, x)).alias(f"{c}__wl"),
                  F.max(F.when(inside, x)).alias(f"{c}__wh"),
                  F.sum(F.when(x.isNotNull() & ~inside, 1).otherwise(0)).cast("long").alias(f"{c}__no")]
    second = df.agg(*aggs2).first()
    rows = []
    for c in cols:
        qs = first[f"{c}__q"] or [None, None, None]
        rows.append((c, first[f"{c}__min"], qs[0], qs[1], qs[2], first[f"{c}__max"],
                     second[f"{c}__wl"], second[f"{c}__wh"], int(second[f"{c}__no"] or 0)))
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, q3 double, max double, "
              "whisker_lo double, whisker_hi double, n_outliers bigint")


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pearson r for every ordered pair of numeric columns (booleans as
    0/1), pairwise complete; a constant column gives null.  One pass (``gram``)."""
    cols = _numeric(df, cols)
    schema = "col_a string, col_b string, r double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    _, products, flat = gram(df, cols)
    return df.sparkSession.createDataFrame(long_rows(cols, np.clip(products.correlation(), -1.0, 1.0), flat), schema)


def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows, columns per type."""
    roles = column_roles(df)
    # One job: collapse copies with a partial hash aggregate on all columns,
    # then count rows, distinct rows and null cells from the grouped rows.
    nulls = [F.col(c).isNull().cast("long") for c in df.columns]
    row_nulls = nulls[0]
    for c in nulls[1:]:
        row_nulls = row_nulls + c
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_row.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                         F.sum(row_nulls * F.col("_n")).alias("missing_cells"))
    return totals.select(
        F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("bigint").alias("missing_cells"),
        F.coalesce(F.col("rows") - F.col("distinct_rows"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.lit(len(roles["numeric"])).cast("bigint").alias("n_numeric"),
        F.lit(len(roles["categorical"])).cast("bigint").alias("n_categorical"),
        F.lit(len(roles["datetime"])).cast("bigint").alias("n_datetime"),
        F.lit(len(roles["other"])).cast("bigint").alias("n_other"))


def profile_numeric(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Distinct, missing, mean, sample std, min, 5 quantiles, max,
    zeros, negatives, skewness, kurtosis (Spark's population moments, excess
    kurtosis) per numeric column.

    One shuffle of (column, value) counts gives the distinct counts and the exact
    quantiles (``approx=True``: sketches instead); one wide aggregate gives the rest.
    """
    cols = _numeric(df, cols)
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    if approx:
        d_row = df.agg(*[F.approx_count_distinct(_as_double(c)).alias(c) for c in cols]).first().asDict()
        quantiles = column_quantiles(df, cols, probs, True, QUANTILE_ACCURACY)
    else:
        counts = value_counts(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
        d_row = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
        quantiles = quantiles_of_counts(counts, probs)
        counts.unpersist()
    aggs = []
    for c in cols:
        x = _as_double(c)
        varies = F.max(x) > F.min(x)
        aggs += [
            F.sum(x.isNull().cast("long")).alias(f"{c}__missing"),
            F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
            F.sum((x == 0).cast("long")).alias(f"{c}__zeros"),
            F.sum((x < 0).cast("long")).alias(f"{c}__negatives"),
            F.when(varies, F.skewness(x)).alias(f"{c}__skewness"), F.when(varies, F.kurtosis(x)).alias(f"{c}__kurtosis"),
        ]
    row = df.agg(*aggs).first().asDict()
    out = []
    for c in cols:
        qs = quantiles.get(c) or [None] * 5
        out.append((c, int(d_row.get(c) or 0), int(row[f"{c}__missing"] or 0), row[f"{c}__mean"], row[f"{c}__std"],
                    row[f"{c}__min"], *qs, row[f"{c}__max"], int(row[f"{c}__zeros"] or 0),
                    int(row[f"{c}__negatives"] or 0), row[f"{c}__skewness"], row[f"{c}__kurtosis"]))
    return df.sparkSession.createDataFrame(
        out, "column string, distinct bigint, missing bigint, mean double, std double, min double, "
             "p05 double, q1 double, median double, q3 double, p95 double, max double, zeros bigint, "
             "negatives bigint, skewness double, kurtosis double")


def profile_categorical(df: DataFrame, cols=None) -> DataFrame:
    """Strings and dates -> distinct, missing, top value (smallest on
    ties), its frequency, min/max length, min/max value.

    Rows are unpivoted to (column, value) in the scan stage and counted per
    (column, value) with a partial aggregate; top value uses ``min_by`` over
    (-count, value), so no column's values are ever gathered in one task.
    """
    if cols is None:
        cols = string_columns(df) + datetime_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, distinct bigint, missing bigint, top string, top_freq bigint, "
                "min_len bigint, max_len bigint, min_value string, max_value string")
    kinds = {f.name: ("date" if is_datetime(f.dataType) else "text") for f in df.schema.fields}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 F.lit(kinds[c] == "text").alias("is_text"))
        for c in cols]))
    long = df.select(pairs.alias("p")).select("p.*")
    counted = long.groupBy("column", "value", "is_text").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    out = counted.groupBy("column").agg(
        F.sum(F.when(present, 1).otherwise(0)).cast("bigint").alias("distinct"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).cast("bigint").alias("missing"),
        F.min_by(F.when(present, F.col("value")),
                 F.when(present, F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(present, F.col("n"))).cast("bigint").alias("top_freq"),
        F.min(F.when(present & F.col("is_text"), F.length("value"))).cast("bigint").alias("min_len"),
        F.max(F.when(present & F.col("is_text"), F.length("value"))).cast("bigint").alias("max_len"),
        F.min(F.when(present & ~F.col("is_text"), F.col("value"))).alias("min_value"),
        F.max(F.when(present & ~F.col("is_text"), F.col("value"))).alias("max_value"),
    )
    return out


def profile(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """The three profile tables."""
    return {"overview": profile_overview(df),
            "numeric": profile_numeric(df, approx=approx),
            "categorical": profile_categorical(df)}
