"""Unpivot helpers: one wide aggregate row becomes a long (column, ...) table.

Operators compute every per-column statistic in ONE aggregate job (one scan,
map-side partial aggregation) and then turn the single result row into a long
table with ``stack``; the unpivot works on one row, so it costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def unpivot_wide(row_df: DataFrame, columns: list[str], stats: list[str],
                 prefix_sep: str = "__", name_col: str = "column") -> DataFrame:
    """``row_df`` holds columns ``<col>__<stat>``; return rows (column, stat...)."""
    if not columns:
        raise ValueError("no columns to unpivot")
    parts = []
    for c in columns:
        parts.append(f"'{c.replace(chr(39), chr(39) * 2)}'")
        parts.extend(q(f"{c}{prefix_sep}{s}") for s in stats)
    names = ", ".join([name_col] + stats)
    expr = f"stack({len(columns)}, {', '.join(parts)}) as ({names})"
    return row_df.select(F.expr(expr))
