"""Schema walks and small column-name helpers (driver side, on names only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, include_bool: bool = False, exclude=()) -> list[str]:
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if is_numeric(f.dataType) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType) and f.name not in exclude]


def datetime_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType) and f.name not in exclude]


def column_roles(df: DataFrame, exclude=()) -> dict[str, list[str]]:
    """Split columns into numeric / categorical / datetime / other."""
    roles = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if is_numeric(f.dataType):
            roles["numeric"].append(f.name)
        elif is_string(f.dataType):
            roles["categorical"].append(f.name)
        elif is_datetime(f.dataType):
            roles["datetime"].append(f.name)
        else:
            roles["other"].append(f.name)
    return roles


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into null once, right after load, so every later
    operator deals with a single notion of missing."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


_KEPT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def sanitize_names(names, number_collisions: bool = True) -> list[str]:
    """Names of ASCII letters, digits and underscores that do not begin with a digit.

    Other characters vanish; what is left empty is named by its place, and a leading digit gets
    the word ``feature_`` before it.  A name that is taken is counted up: ``_2``, ``_3``."""
    taken: set = set()

    def spelled(place, name):
        kept = "".join(ch for ch in str(name) if ch in _KEPT)
        return f"feature_{kept or place}" if not kept or kept[0].isdigit() else kept

    def free(base):
        ways = (base if n == 1 else f"{base}_{n}" for n in range(1, len(taken) + 2))
        return next(w for w in ways if w not in taken) if number_collisions else base

    out = []
    for place, name in enumerate(names):
        out.append(free(spelled(place, name)))
        taken.add(out[-1])
    return out
