"""Files and Spark SQL as the input table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import nan_to_null

FILE_FORMATS = ("csv", "parquet", "json")
_EXT = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json",
        ".jsonl": "json", ".xlsx": "xlsx"}


class SourceError(ValueError):
    """Raised before any Spark job when a source is unusable."""


def format_from_path(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in _EXT:
        raise SourceError(f"Unsupported file type '{ext or path}'. Use csv, parquet, json or xlsx.")
    return _EXT[ext]


def validate_source(config: dict) -> dict:
    """Check a source description before any Spark job runs.

    ``{"kind": "file", "path": ..., "format": optional}`` or
    ``{"kind": "database", "db_type": "sqlite"|"postgresql"|"mysql", ...}``.
    """
    kind = config.get("kind")
    if kind == "file":
        path = config.get("path")
        if not path:
            raise SourceError("No file given.")
        fmt = config.get("format") or format_from_path(path)
        if fmt not in FILE_FORMATS + ("xlsx",):
            raise SourceError(f"Unsupported file format '{fmt}'.")
        return {**config, "format": fmt}
    if kind == "database":
        db = config.get("db_type")
        if db == "sqlite":
            need = ("path", "query")
        elif db in ("postgresql", "mysql"):
            need = ("host", "port", "database", "user", "password", "query")
        else:
            raise SourceError(f"Unsupported database type '{db}'.")
        missing = [k for k in need if config.get(k) in (None, "")]
        if missing:
            raise SourceError(f"Missing {db} settings: {', '.join(missing)}.")
        return dict(config)
    raise SourceError(f"Unknown source kind '{kind}'.")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               json_lines: bool = False, schema=None) -> DataFrame:
    """A1-A3: read a file or folder into one DataFrame; NaN becomes null.

    CSV: header row, inferred types (pass ``schema`` on large data to skip
    the inference pass).  JSON: one document holding an array of records
    (``multiLine``); ``json_lines=True`` reads JSON lines, which splits.
    """
    fmt = fmt or format_from_path(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.options(header=True, inferSchema=schema is None).csv(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
    elif fmt == "json":
        df = reader.option("multiLine", not json_lines).json(path)
    else:
        raise SourceError(f"Unsupported file format '{fmt}'.")
    return nan_to_null(df)


def read_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> DataFrame:
    """User SQL text becomes the input table.  ``tables`` are exposed as
    temporary views, so the user has all of Spark SQL (joins, windows,
    grouping sets) and Catalyst optimises the whole plan."""
    if not query or not query.strip():
        raise SourceError("Empty SQL query.")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return nan_to_null(spark.sql(query))
