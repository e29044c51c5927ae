"""Helpers shared by the operators: partitions, shared tables and schemas."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package


#: Rows of an Arrow batch: whole texts come in batches, so this bounds a task's memory.
BATCH_ROWS = 2048
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that a join may broadcast.
BROADCAST_KEYS = 1 << 19


def ready(spark: SparkSession) -> None:
    """Executors can import the library from here on, and get texts in batches of ``BATCH_ROWS`` unless the
    session names a smaller or its own size."""
    ship_package(spark)
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def settle() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def settled(work):
    """``work`` on batches, with ``settle`` at the end of the task."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            settle()
    return run


def shuffle_parts(df: DataFrame) -> int:
    """Partitions for a shuffle whose bytes follow those of ``df``'s scan: the
    session's setting, and no fewer than the scan has."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


@contextmanager
def cleaned(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files: else they stay until the driver happens to collect its garbage,
    and those of several steps lie on disk at once."""
    before = spark.conf.get(_CLEAN_CONF, None)
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_CONF)
        else:
            spark.conf.set(_CLEAN_CONF, before)


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back: lineage
    and shuffle files end there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    with cleaned(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str):
    """A 64-bit key of a row's content (equal rows get equal keys)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
