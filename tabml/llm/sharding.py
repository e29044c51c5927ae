"""Balanced label propagation: linked documents move together, sizes stay even.

Documents that share a group (here: an equal text) are linked.  Starting from hashed shards, every round
joins each group's weight per shard back to its members: a member wants the shard where most of its
group is, among those with room.  Moves are admitted under quotas: between two
shards as much as moves the other way, and beyond that what the target's capacity leaves, the largest
gains first.  Documents without links want nothing and fill what is left at the end, so
capacities hold exactly under the law:

* ``rows``: the shards' row counts differ by one at most;
* ``bytes``: each shard's size is within one document of an even share.

Only DataFrame functions are used.  A hot group is never gathered: it is counted per shard,
admitted by hash fractions and ranked in hash buckets of bounded size.  Quotas (shards x
shards) and cells (x gain x 64 hash buckets) are small tables that do not grow with the
rows.  Every round's labels of the linked documents are written to the shared folder.

Defined cases: a null text has size 1, crc32 0 and no links; empty texts are equal texts; repeated rows are
separate rows of one group; a null id is placed like any other; fewer rows than shards leave
shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .frames import stored

SHARDS = 16
ROUNDS = 8
#: Rows of a hash bucket that are ranked together.
BUCKET_ROWS = 50_000
#: Rows of one group in a bucket, about: a group of more is in as many buckets of its own as that takes.
GROUP_ROWS = 512
#: Hash buckets of groups in an admission cell.
CELLS = 64


def _fraction(*cols):
    """A hash of the columns in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _ranked(df: DataFrame, part: str, rows: int, by_group: bool) -> DataFrame:
    """``df`` with ``before`` (weight) and ``rank`` of each row within ``part``: exact, by hash buckets
    of bounded size and the buckets' offsets."""
    n = max(1, math.ceil(rows / BUCKET_ROWS))
    bucket = F.floor(_fraction("key", "copy", F.lit("place")) * n)
    if by_group:  # groups stay together as far as a bucket reaches
        df = df.withColumn("b1", F.floor(_fraction("grp", F.lit("place")) * n)).withColumn("b2", F.floor(_fraction("key", "copy") * F.ceil(F.col("n") / GROUP_ROWS)))
    else:
        df = df.withColumn("b1", bucket).withColumn("b2", F.lit(0).cast("long"))
    sums = df.groupBy(part, "b1", "b2").agg(F.sum("weight").alias("w"), F.count("*").alias("c"))
    earlier = Window.partitionBy(part).orderBy("b1", "b2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, "b1", "b2", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w0"),
                          F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    inside = Window.partitionBy(part, "b1", "b2").orderBy("grp", "key", "copy")
    return (df.withColumn("w1", F.coalesce(F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("c1", F.row_number().over(inside) - 1)
            .join(offsets, [part, "b1", "b2"])
            .withColumn("before", F.col("w0") + F.col("w1")).withColumn("rank", F.col("c0") + F.col("c1"))
            .drop("b1", "b2", "w0", "w1", "c0", "c1"))


def _round(labels: DataFrame, capacity: float, shards: int, number: int) -> DataFrame:
    """Round ``number`` of propagation: ``labels`` with new shards and a column ``wished``."""
    counts = labels.groupBy("grp", "shard").agg(F.sum("weight").alias("w"))
    used = F.broadcast(counts.groupBy("shard").agg(F.sum("w").alias("used")))
    room = F.broadcast(labels.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(used, "shard", "left")
                       .select("shard", F.greatest(F.lit(capacity) - F.coalesce("used", F.lit(0)), F.lit(0.0)).alias("room")))
    open_ = counts.join(room, "shard").where(F.col("room") > 0.01 * capacity)
    # a group that has no member in a shard with room takes one by hash
    first = labels.select("grp").distinct().join(open_, "grp", "left_anti").select(
        "grp", F.floor(_fraction("grp") * shards).cast("int").alias("shard"), F.lit(0).cast("long").alias("w")).join(room, "shard").where(
        F.col("room") > 0.01 * capacity).select("grp", "shard", "w")
    best = (open_.select("grp", "shard", "w").unionByName(first)
            .groupBy("grp").agg(F.max(F.struct("w", F.xxhash64("grp", "shard").alias("tie"), "shard")).alias("best"))
            .select("grp", F.col("best.shard").alias("target"), F.col("best.w").alias("there")))
    wishes = counts.select("grp", "shard", F.col("w").alias("here")).join(best, "grp").where(
        (F.col("shard") != F.col("target")) & (F.col("there") >= F.col("here"))).withColumn(
        "gain", F.floor(F.log2(F.col("there") - F.col("here") + 1.0))).withColumn("cell", F.floor(_fraction("grp", F.lit("cell")) * CELLS))
    cells = wishes.groupBy("shard", "target", "gain", "cell").agg(F.sum("here").alias("w"))
    flow = cells.groupBy("shard", "target").agg(F.sum("w").alias("wish"))
    back = flow.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("wish").alias("back"))
    both = flow.join(back, ["shard", "target"], "left").withColumn("swap", F.least("wish", F.coalesce("back", F.lit(0))))
    rest = Window.partitionBy("target")
    quota = (both.withColumn("rest", F.col("wish") - F.col("swap")).withColumn("all", F.sum("rest").over(rest))
             .join(room.withColumnRenamed("shard", "target"), "target")
             .select("shard", "target", (F.col("swap") + F.when(F.col("all") > 0, F.col("rest") * F.least(F.lit(1.0), F.col("room") / F.col("all")))
                                         .otherwise(0.0)).alias("quota")))
    before = Window.partitionBy("shard", "target").orderBy(F.desc("gain"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    admitted = (cells.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).join(quota, ["shard", "target"])
                .withColumn("part", (F.col("quota") - F.col("before")) / F.col("w")).where("part > 0").select("shard", "target", "gain", "cell", "part"))
    allowed = wishes.join(admitted, ["shard", "target", "gain", "cell"]).select("grp", "shard", "target", "part")
    moved = F.coalesce(_fraction("key", "copy", F.lit(number)) < F.col("part"), F.lit(False))
    return (labels.join(allowed, ["grp", "shard"], "left")
            .select("key", "copy", "grp", "n", "weight", F.when(moved, F.col("target")).otherwise(F.col("shard")).alias("shard"),
                    F.col("part").isNotNull().alias("wished")))


def balanced_shards(nodes: DataFrame, shards: int = SHARDS, law: str = "rows", rounds: int = ROUNDS) -> DataFrame:
    """``nodes``: key, copy (together unique), grp (null: no links) and size.  Returns key, copy, shard, slot."""
    if law not in ("rows", "bytes"):
        raise ValueError("law: rows or bytes")
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    nodes = nodes.select("key", "copy", "grp", weight.alias("weight"))
    # a table of its own, so that the joins with it can split a hot group
    groups = stored(nodes.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    total, rows = nodes.agg(F.sum("weight"), F.count("*")).first()
    total = total or 0
    edges = [total * s // shards for s in range(shards + 1)]
    linked = nodes.join(groups, "grp").withColumn("shard", F.floor(_fraction("key", "copy", F.lit("start")) * shards).cast("int"))
    labels = stored(linked.select("key", "copy", "grp", "n", "weight", "shard"), "shard-labels")
    for number in range(rounds if total else 0):
        done = stored(_round(labels, total / shards, shards, number), "shard-labels")
        labels = done.drop("wished")
        if done.where("wished").isEmpty():
            break
    wanted = F.element_at(F.array(*[F.lit(edges[s + 1] - edges[s]).cast("long") for s in range(shards)]), F.col("shard") + 1)
    placed = stored(_ranked(labels, "shard", rows, True).withColumn("kept", F.col("before") < wanted), "shard-ranks")
    kept = placed.where("kept")
    held = {r.shard: (r.w, r.c) for r in kept.groupBy("shard").agg(F.sum("weight").alias("w"), F.count("*").alias("c")).collect()}
    free = placed.where("NOT kept").select("key", "copy", "grp", "weight").unionByName(
        nodes.join(groups, "grp", "left_anti"))
    pool = _ranked(free.withColumn("all", F.lit(0)), "all", rows, False)
    # what each shard still takes, as bounds on the pool's weight
    bounds, at = [], 0
    for s in range(shards):
        bounds.append(at)
        at += max(0, edges[s + 1] - edges[s] - held.get(s, (0, 0))[0])
    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    # the last shard whose bound is not above, among shards that take anything
    takes = [b < e for b, e in zip(bounds, [*bounds[1:], at])]
    shard = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), F.lit(-1), lambda acc, s: F.when(
        (F.get(bound, s) <= F.col("before")) & F.get(F.array(*[F.lit(t) for t in takes]), s), s).otherwise(acc))
    last = max((s for s in range(shards) if takes[s]), default=shards - 1)
    pool = stored(pool.withColumn("shard", F.when(F.col("before") >= at, F.lit(last)).otherwise(shard)).select("key", "copy", "shard", "rank"), "shard-pool")
    starts = pool.groupBy("shard").agg(F.min("rank").alias("start"))
    filled = F.array(*[F.lit(held.get(s, (0, 0))[1]).cast("long") for s in range(shards)])
    late = pool.join(F.broadcast(starts), "shard").select(
        "key", "copy", "shard", (F.col("rank") - F.col("start") + F.element_at(filled, F.col("shard") + 1)).alias("slot"))
    return kept.select("key", "copy", "shard", F.col("rank").alias("slot")).unionByName(late)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    law: str = "rows", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
                       F.when(text.isNotNull(), F.xxhash64(text)).alias("grp"))
    rows = rows.withColumn("key", F.xxhash64("id", "grp"))
    rows = stored(rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("size"))), "shard-rows")
    places = balanced_shards(rows, shards, law, rounds)
    return rows.join(places, ["key", "copy"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """The per-document contract columns (law ``rows``)."""
    return shard_documents(docs.select("doc_id", "text")).withColumn("grown_shard", F.lit(None).cast(T.IntegerType()))
