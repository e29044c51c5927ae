"""Derived views over the driver's tables, used by the checks and the demo.

Each view is built from the whole input tables by Spark, so its work grows
with them.  The DuckDB oracle builds the same views with the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_key() -> F.Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])


def orders_dup(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.unionAll(o.where(F.col("o_orderkey") % 10 == 0))


def orders_null(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority")),
    })


def part_null(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumns({
        "p_size": F.when(F.col("p_partkey") % 9 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")),
        "p_retailprice": F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("p_retailprice")),
    })


def pred_class(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = lineitem_key()
    return li.select(k.alias("row_id"), F.col("l_returnflag").alias("label"),
                     F.when(md5_bucket(k) % 10 < 2, F.lit("N")).otherwise(F.col("l_returnflag"))
                     .alias("prediction"))


def pred_binary(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.col("toxic").alias("label"),
                     ((md5_bucket(F.col("doc_id")) % 100) / 100.0 + 0.2 * F.col("toxic")).alias("score"))


def pred_value(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(lineitem_key().alias("row_id"), F.col("l_extendedprice").alias("label"),
                     (F.lit(1500.0) * F.col("l_quantity")).alias("prediction"))


def doc_stats(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents")
    return lb.join(d, "doc_id").select(
        "doc_id", "quality", "toxic", "lang", "source", "n_chars",
        F.size(F.split(F.col("text"), " ")).cast("bigint").alias("n_words"),
        (F.length(F.regexp_replace(F.col("text"), "[A-Za-z ]", "")) / (1 + F.length(F.col("text"))))
        .alias("non_letter"))


def doc_label(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents")
    return lb.join(d, "doc_id").select("doc_id", "quality", "toxic", "lang", "source", "n_chars")


def lineitem_keyed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("row_id", lineitem_key())
