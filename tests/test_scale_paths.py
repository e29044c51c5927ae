"""The branches taken only on large tables, forced here with small thresholds."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paths import SF_MID
from tabml.functions import quantiles as Q
from tabml.operators import explore
from tabml.operators import features as FE
from tabml.operators import metrics as M
from tabml.operators import rows as RW
from tabml.plans import views as V


def test_shuffle_free_split_is_close_to_share(spark):
    li = V.lineitem_keyed(spark, SF_MID)
    out = RW.train_test_split(li, "row_id", 0.3, 42, exact=False)
    share = out.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert abs(share - 0.3) < 0.01


def test_quantiles_exact_and_sketch(spark):
    li = V.table(spark, SF_MID, "lineitem")
    exact = Q.column_quantiles(li, ["l_extendedprice"], [0.5])["l_extendedprice"][0]
    sketch = Q.column_quantiles(li, ["l_extendedprice"], [0.5], approx=True)["l_extendedprice"][0]
    assert exact == np.median(li.select("l_extendedprice").toPandas())
    assert abs(sketch - exact) / exact < 0.01
    profile = {r["column"]: r for r in explore.profile_numeric(li, ["l_discount"]).collect()}["l_discount"]
    assert profile["distinct"] == li.select("l_discount").distinct().count()


def test_auc_of_many_scores_is_exact_and_repeatable(spark):
    n = 250_000
    rng = np.random.default_rng(0)
    s = rng.permutation(n) / n
    y = (rng.random(n) < 0.3 + 0.2 * s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "label": y})).repartition(13)
    rank = np.argsort(np.argsort(s)) + 1
    p = y.sum()
    want = (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    for _ in range(2):
        assert np.isclose(M.auc_roc(df).first()[0], want, rtol=1e-12)
    curve = M.roc_curve(df).orderBy(F.desc("threshold")).toPandas()
    assert curve["tpr"].is_monotonic_increasing and curve["fpr"].is_monotonic_increasing and len(curve) == n


def test_scores_survive_offsets_and_constants(spark):
    rows = [(i, 1e9 + i, float(i), i // 5, 7.0, float(i // 5)) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, big double, x double, c int, flat double, split double")
    f = {r["feature"]: r["score"] for r in FE.f_classif_scores(df, ["big", "x", "flat", "split"], "c").collect()}
    assert np.isclose(f["big"], f["x"]) and f["flat"] is None and f["split"] == float("inf")
    g = {r["feature"]: r["score"] for r in FE.f_regression_scores(df, ["big", "flat", "x"], "x").collect()}
    assert g["big"] == g["x"] == float("inf") and g["flat"] is None
    r = {(a["col_a"], a["col_b"]): a["r"] for a in explore.correlation_matrix(df, ["big", "x", "flat"]).collect()}
    assert np.isclose(r["big", "x"], 1) and r["x", "flat"] is None and r["flat", "flat"] is None
    shifted = df.selectExpr("big as label", "big + 0.5 as prediction")
    assert np.isclose(M.r2(shifted).first()[0], 1 - 10 * 0.25 / 82.5)
    flat = df.selectExpr("flat as label", "flat as prediction")
    assert M.r2(flat).first()[0] == 1.0
    one = df.selectExpr("1 as label", "x as score")
    assert M.auc_roc(one).first()[0] is None and M.roc_curve(one).first()["fpr"] is None
    nulls = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None)], "label string, prediction string")
    assert M.confusion_matrix(nulls).agg(F.sum("n")).first()[0] == 3


def test_rank_survives_a_hot_group(spark):
    # one class holds most rows: ranks stay exact and the group is spread
    li = V.lineitem_keyed(spark, SF_MID).withColumn(
        "g", F.when(F.col("l_returnflag") == "N", F.lit("hot")).otherwise(F.col("l_returnflag")))
    ranked = RW.rank_within_groups(li.select("row_id", "g", "l_extendedprice"), ["g"], "l_extendedprice",
                                   num_partitions=8)
    parts = ranked.where("g = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    stats = ranked.groupBy("g").agg(F.min("_rank"), F.max("_rank"), F.count(F.lit(1)), F.countDistinct("_rank"))
    for r in stats.collect():
        assert r[1] == 0 and r[2] == r[3] - 1 and r[4] == r[3]
