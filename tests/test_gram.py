"""Cross-products of many columns, modes and places of sorted values, against NumPy and pandas."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabml.operators import explore, features
from tabml.operators.gram import gram
from tabml.operators.target import encode_label_table, impute_target, infer_input_defaults, input_stats, modes, sorted_places


def gaps(n=300, d=6, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) + 1e6
    X[rng.random(X.shape) < 0.2] = np.nan
    X[:, -1] = 7.0
    return X


def table(spark, X):
    cols = [f"c{i}" for i in range(X.shape[1])]
    return spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in X], ", ".join(f"{c} double" for c in cols)), cols


def test_pairwise_complete_correlation_equals_pandas(spark):
    X = gaps()
    df, cols = table(spark, X)
    want = pd.DataFrame(X, columns=cols).corr()
    for parts in (1, 40):
        got = {(r.col_a, r.col_b): r.r for r in explore.correlation_matrix(df.repartition(parts), cols).collect()}
        assert len(got) == 36
        for (a, b), v in got.items():
            assert (v is None) if "c5" in (a, b) else abs(v - want.loc[a, b]) < 1e-9
    cov = {(r.col_a, r.col_b): r.cov for r in features.covariance_matrix(df, cols).collect()}
    frame = pd.DataFrame(X, columns=cols)
    for a in cols[:5]:
        for b in cols[:5]:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            assert abs(cov[a, b] - np.cov(both[a], both[b], ddof=0)[0, 1]) < 1e-6


def test_columns_that_are_constant_where_both_are_known(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, None), (None, 9.0)], "a double, b double")
    got = {(r.col_a, r.col_b): r.r for r in explore.correlation_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] == 1.0
    none = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert all(r.r is None for r in explore.correlation_matrix(none, ["a", "b"]).collect())
    assert all(r.r is None for r in explore.correlation_matrix(none.where("false"), ["a", "b"]).collect())


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(0, 1, (60, 500))
    df = spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>").select(*[F.col("x")[i].alias(f"c{i}") for i in range(500)])
    mean, products, flat = gram(df, df.columns)
    assert np.allclose(products.correlation(), np.corrcoef(X.T), atol=1e-10) and np.allclose(mean, X.mean(axis=0)) and not flat.any()


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", None, 2), ("b", None, 2), ("a", None, None), (None, None, None)], "s string, t string, n int")
    assert modes(df, ["s", "t"]) == {"s": "a", "t": "x"} and modes(df, ["n"]) == {"n": 2}
    assert modes(df.where("false"), ["s"]) == {}
    assert [r.s for r in impute_target(df, "s", "mode").collect()].count("a") == 3
    defaults = {r["column"]: r["default"] for r in infer_input_defaults(df).collect()}
    assert defaults == {"s": "a", "t": "x", "n": "2.0"}
    assert input_stats(df, "n", ["s"])["n_distinct"] == 2 and input_stats(df, "s", ["n"])["id_unique"] == []


def test_places_of_sorted_values(spark):
    values = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("v"))
    got = {r.v: r.place for r in sorted_places(values, "v", "place").collect()}
    assert got == {f"{i:05d}": i for i in range(5000)}
    rows = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "t string")
    assert sorted((str(r.t), r.label) for r in encode_label_table(rows, "t").collect()) == sorted([("b", 1), ("None", None), ("a", 0), ("b", 1)], key=str)
