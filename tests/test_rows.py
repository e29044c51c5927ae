import math

from pyspark.sql import functions as F

from paths import SF_MID
from tabml.operators import rows as RW
from tabml.plans import views as V


def test_rank_within_groups_is_exact(spark):
    li = V.lineitem_keyed(spark, SF_MID).select("row_id", "l_returnflag", "l_extendedprice")
    ranked = RW.rank_within_groups(li, ["l_returnflag"], "l_extendedprice", num_partitions=7).toPandas()
    pdf = ranked.sort_values(["l_returnflag", "_rank"])
    for _, g in pdf.groupby("l_returnflag"):
        assert list(g["_rank"]) == list(range(len(g)))
        assert g["l_extendedprice"].is_monotonic_increasing
        assert (g["_group_size"] == len(g)).all()


def test_stratified_split_is_disjoint_complete_and_proportional(spark):
    lb = V.table(spark, SF_MID, "labels")
    out = RW.train_test_split(lb, "doc_id", 0.3, 42, stratify="toxic").toPandas()
    assert len(out) == lb.count() and out["doc_id"].is_unique
    for _, g in out.groupby("toxic"):
        assert abs(g["is_test"].sum() - 0.3 * len(g)) <= 1


def test_split_is_repeatable_and_seeded(spark):
    lb = V.table(spark, SF_MID, "labels")
    a = RW.train_test_split(lb, "doc_id", 0.3, 42).where("is_test").select("doc_id").collect()
    b = RW.train_test_split(lb, "doc_id", 0.3, 42, num_partitions=3).where("is_test").select("doc_id").collect()
    c = RW.train_test_split(lb, "doc_id", 0.3, 7).where("is_test").select("doc_id").collect()
    assert sorted(a) == sorted(b)
    assert sorted(a) != sorted(c)


def test_stratified_folds_are_balanced(spark):
    lb = V.table(spark, SF_MID, "labels")
    out = RW.assign_folds(lb, "doc_id", 5, stratify="quality").toPandas()
    for _, g in out.groupby("quality"):
        counts = g["fold"].value_counts()
        assert counts.max() - counts.min() <= 1 and set(counts.index) == set(range(5))


def test_upsample_balances_binary_classes(spark):
    lb = V.table(spark, SF_MID, "labels")
    out, applied = RW.upsample_minority(lb, "toxic", "doc_id")
    assert applied
    counts = {r["toxic"]: r["count"] for r in out.groupBy("toxic").count().collect()}
    assert counts[0] == counts[1]
    # every drawn row is a real minority row
    minority = {r["doc_id"] for r in lb.where("toxic = 1").collect()}
    drawn = {r["doc_id"] for r in out.where("toxic = 1").select("doc_id").distinct().collect()}
    assert drawn <= minority


def test_partitions_for_scales_with_rows():
    assert RW.partitions_for(10) == 1
    assert RW.partitions_for(10**9) == math.ceil(10**9 / RW.ROWS_PER_PARTITION)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from tabml.functions.quantiles import exact_quantiles
    li = V.table(spark, SF_MID, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    got = exact_quantiles(li, cols, [0.05, 0.25, 0.5, 0.75, 0.95])
    pdf = li.select(*cols).toPandas()
    for c in cols:
        want = np.percentile(pdf[c].to_numpy(), [5, 25, 50, 75, 95])
        assert np.allclose(got[c], want, rtol=1e-12)
