"""Exact, repeatable row operations driven by hashes.

``rank_within_groups`` is the building block: the exact 0-based position of
each row inside its group when ordered by a hash.  It never gathers a group
into one task (a hot class holding a third of the rows is spread over many
range partitions): one range shuffle on (group, hash), per-partition counts
(a table of partitions x groups rows), and a broadcast join of offsets.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cache import remember
from ..functions.hashing import seeded_bucket, seeded_hash60

# The offsets table has one row per (range partition, group); it is broadcast
# only while it stays under this many rows.
MAX_OFFSET_ROWS = 2_000_000
# Target rows per partition for tables the ML steps iterate over.
ROWS_PER_PARTITION = 250_000


def partitions_for(n_rows: int, rows_per_partition: int = ROWS_PER_PARTITION, cap: int = 100_000, least: int = 1) -> int:
    """Partition count proportional to the data: ~rows_per_partition rows each at scale, and
    ``least`` (the cluster's cores) as soon as each gets a few hundred rows."""
    n = max(n_rows, 1)
    return max(1, min(cap, math.ceil(n / rows_per_partition)), min(least, math.ceil(n / 512)))


def _null_safe_join_cond(left, right, cols):
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(right[c])
        cond = e if cond is None else cond & e
    return cond


def rank_within_groups(df: DataFrame, group_cols, order_col: str, num_partitions: int | None = None,
                       rank_col: str = "_rank", size_col: str | None = "_group_size") -> DataFrame:
    """Add ``rank_col`` = exact 0-based rank of the row within its group by
    ``order_col`` (ties broken arbitrarily) and ``size_col`` = group size."""
    group_cols = list(group_cols or [])
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = group_cols + [order_col]
    ranged = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # Two actions read the ranged rows (counts, then the ranks): keep them so
    # both see the same partitions.  A lost block is recomputed through the
    # same range partitioner, so it lands in the same place.
    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    stats = (ranged.groupBy("_pid", *group_cols)
             .agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    rows = stats.limit(MAX_OFFSET_ROWS + 1).collect()
    if len(rows) > MAX_OFFSET_ROWS:
        raise ValueError("too many (partition, group) cells for an offsets table")
    rows.sort(key=lambda r: r["_pid"])
    running, totals = {}, {}
    for r in rows:
        g = tuple(r[c] for c in group_cols)
        totals[g] = totals.get(g, 0) + r["_cnt"]
    offsets = []
    for r in rows:
        g = tuple(r[c] for c in group_cols)
        start = running.get(g, 0)
        running[g] = start + r["_cnt"]
        offsets.append((r["_pid"], *g, start - r["_first"], totals[g]))
    schema_fields = ["_pid int"] + [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group_cols] \
        + ["_base bigint", "_gsize bigint"]
    off_df = spark.createDataFrame(offsets, ", ".join(schema_fields))
    o = off_df.alias("o")
    r_ = ranged.alias("r")
    joined = r_.join(F.broadcast(o), _null_safe_join_cond(r_, o, ["_pid"] + group_cols), "inner")
    out = joined.select(*[F.col(f"r.`{c}`") for c in df.columns],
                        (F.col("r._mid") + F.col("o._base")).alias(rank_col),
                        F.col("o._gsize").alias(size_col or "_gsize"))
    if size_col is None:
        out = out.drop("_gsize")
    return remember(out, ranged)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 42,
                     stratify: str | None = None, exact: bool = True,
                     split_col: str = "is_test", num_partitions: int | None = None) -> DataFrame:
    """Repeatable split by a hash of (seed, key).

    exact=True: within each group (the class when ``stratify`` is given,
    else the whole table) the ceil(test_size * n) rows with the smallest
    60-bit hash go to test, like the reference's exact test count.
    exact=False: a shuffle-free cut on the hash (test share within
    sampling error of ``test_size``)."""
    h = seeded_hash60(seed, F.col(key))
    if not exact:
        cut = int(test_size * (1 << 60))
        return df.withColumn(split_col, h < F.lit(cut))
    groups = [stratify] if stratify else []
    ranked = rank_within_groups(df.withColumn("_h", h), groups, "_h", num_partitions)
    n_test = F.ceil(F.col("_group_size") * F.lit(test_size))
    return remember(ranked.withColumn(split_col, F.col("_rank") < n_test).drop("_h", "_rank", "_group_size"),
                    ranked)


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None,
                 fold_col: str = "fold", num_partitions: int | None = None) -> DataFrame:
    """fold numbers 0..k-1.  Stratified: (rank of the hash within the
    class) mod k, so every class is spread evenly.  Otherwise: md5 bucket of
    (seed, key) mod k, a projection with no shuffle."""
    if stratify is None:
        return df.withColumn(fold_col, F.pmod(seeded_bucket(seed, F.col(key)), F.lit(k)).cast("int"))
    ranked = rank_within_groups(df.withColumn("_h", seeded_hash60(seed, F.col(key))), [stratify], "_h",
                                num_partitions, size_col=None)
    return remember(ranked.withColumn(fold_col, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_h", "_rank"),
                    ranked)


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def upsample_minority(df: DataFrame, label: str, key: str, seed: int = 42,
                      ratio: float = 0.5) -> tuple[DataFrame, bool]:
    """Binary classes with min/max count ratio under ``ratio``: the
    minority is bootstrapped (drawn with replacement) to the majority count
    and unioned with the majority.  The original minority rows are not kept
    (they are the population the draws come from).

    Exact bootstrap as an equi-join: minority rows get positions 0..m-1 in
    hash order; draw ``i`` (``spark.range(M)``, distributed) picks position
    pmod(md5(seed:i), m): a join with ~M/m rows per key, which Spark broadcasts
    where the minority side is small.
    Returns (df, applied)."""
    counts = class_counts(df, label)
    if len(counts) != 2:
        return df, False
    (cls_min, m), (cls_max, big) = sorted(counts.items(), key=lambda kv: (kv[1], str(kv[0])))
    if big == 0 or m / big >= ratio:
        return df, False
    minority = df.where(F.col(label) == F.lit(cls_min))
    majority = df.where(F.col(label) == F.lit(cls_max))
    pos = (rank_within_groups(minority.withColumn("_h", seeded_hash60(seed, F.col(key))), [], "_h",
                              partitions_for(m), size_col=None)
           .drop("_h"))
    spark = df.sparkSession
    draws = spark.range(0, big, 1, partitions_for(big)).select(
        F.col("id").alias("_draw"),
        F.pmod(seeded_bucket(seed, F.col("id")), F.lit(m)).alias("_rank"))
    picked = draws.join(pos, "_rank").select(*df.columns)
    out = majority.unionByName(picked)
    return remember(out.coalesce(partitions_for(2 * big)), pos, df), True
