"""Exact running sums in the order of a column, per group, without a global sort.

The order column is cut into ranges at approximate quantiles (a bounded array per group); a row's range
follows from its value alone, so every evaluation of the plan agrees on it.  Range totals (ranges x
groups rows) become offsets, and a window runs inside each range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per group.
RANGES = 1024
_STEP = int(math.sqrt(RANGES))


def prefix_sums(df: DataFrame, order_col: str, value_cols, descending: bool = False, group: str | None = None) -> DataFrame:
    """``df`` with inclusive running sums ``cum_<c>`` of ``value_cols`` in ``order_col`` order, within
    each ``group``.  Rows of equal order value should be summed up before."""
    key = "_prefix_group"
    rows = df.withColumn(key, F.col(group) if group else F.lit(0))
    probs = F.array(*[F.lit((i + 1) / RANGES) for i in range(RANGES - 1)])
    cuts = F.broadcast(rows.groupBy(key).agg(F.percentile_approx(order_col, probs, 20 * RANGES).alias("_cuts")))
    x = F.col(order_col)
    coarse = F.size(F.filter(F.sequence(F.lit(_STEP), F.lit(RANGES - 1), F.lit(_STEP)), lambda i: F.get("_cuts", i - 1) < x))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_coarse") * _STEP + 1, F.lit(_STEP)), lambda c: c < x))
    ranged = (rows.join(cuts, rows[key].eqNullSafe(cuts[key])).drop(cuts[key]).withColumn("_coarse", coarse)
              .withColumn("_range", F.col("_coarse") * _STEP + fine).drop("_cuts", "_coarse"))
    order = F.desc if descending else F.asc
    totals = ranged.groupBy(key, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    earlier = Window.partitionBy(key).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group
    offsets = totals.select(F.col(key).alias("_g"), F.col("_range").alias("_r"),
                            *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in value_cols])
    inside = Window.partitionBy(key, "_range").orderBy(order(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(f"_cum_{c}") for c in value_cols])
    out = local.join(offsets, local[key].eqNullSafe(offsets["_g"]) & (local["_range"] == offsets["_r"]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(f"_cum_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in value_cols])
