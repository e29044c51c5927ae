"""Deterministic hash draws shared by splitting, folds, bootstrap and sampling.

Every random choice in the library is a function of ``(seed, key)`` so a job
gives the same rows after a retry, on any cluster size, and the DuckDB oracle
can reproduce it with ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_bucket(key) -> Column:
    """First 32 bits of md5(key as text) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(_as_col(key).cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded_text(seed: int, key) -> Column:
    return F.concat(F.lit(f"{seed}:"), _as_col(key).cast("string"))


def seeded_bucket(seed: int, key) -> Column:
    """md5 bucket of the text ``'<seed>:<key>'``."""
    return F.conv(F.substring(F.md5(seeded_text(seed, key)), 1, 8), 16, 10).cast("bigint")


def seeded_hash60(seed: int, key) -> Column:
    """60-bit md5 draw: practically collision free at 10^12 rows."""
    return F.conv(F.substring(F.md5(seeded_text(seed, key)), 1, 15), 16, 10).cast("bigint")


def row_key(df, key_cols=None, name: str = "_row_id"):
    """Add an explicit row key: the given natural key joined by '-', or a
    64-bit hash of the whole row when no key is given."""
    if key_cols:
        if isinstance(key_cols, str):
            key_cols = [key_cols]
        if len(key_cols) == 1:
            return df.withColumn(name, F.col(key_cols[0]).cast("string"))
        return df.withColumn(name, F.concat_ws("-", *[F.col(c).cast("string") for c in key_cols]))
    return df.withColumn(name, F.xxhash64(*[F.col(c) for c in df.columns]).cast("string"))
