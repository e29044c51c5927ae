"""Model conversions against NumPy closed forms on fixture-derived tables."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paths import SF_SMALL, SF_MID
from tabml.operators import features as FE
from tabml.operators import neighbors as NB
from tabml.operators import outliers as OUT
from tabml.plans import views as V
from tabml.plans.models import CLASSIFIERS, REGRESSORS, FitContext, make_model, param_grid

COLS = ["l_quantity", "l_discount", "l_tax"]


def _lineitem(spark):
    li = V.table(spark, SF_SMALL, "lineitem")
    df = VectorAssembler(inputCols=COLS, outputCol="features").transform(
        li.withColumn("label", F.col("l_extendedprice") / 1000.0))
    pdf = li.select(*COLS, (F.col("l_extendedprice") / 1000.0).alias("y")).toPandas()
    return df, pdf[COLS].to_numpy(), pdf["y"].to_numpy()


def _centered(X, y):
    return X - X.mean(0), y - y.mean()


def test_ridge_matches_closed_form(spark):
    df, X, y = _lineitem(spark)
    alpha = 50.0
    Xc, yc = _centered(X, y)
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    m = make_model("regression", "Ridge", FitContext(n_rows=len(y), label_std=y.std()), alpha=alpha).fit(df)
    assert np.allclose(m.coefficients.toArray(), w, rtol=1e-4, atol=1e-6)
    assert abs(m.intercept - (y.mean() - X.mean(0) @ w)) < 1e-4


def _coordinate_descent(X, y, alpha, l1):
    Xc, yc = _centered(X, y)
    n, d = Xc.shape
    w = np.zeros(d)
    for _ in range(5000):
        for j in range(d):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            z = (Xc[:, j] ** 2).sum() / n + alpha * (1 - l1)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / z
    return w


@pytest.mark.parametrize("name,alpha,l1", [("Lasso", 0.05, 1.0), ("ElasticNet", 0.05, 0.5)])
def test_l1_models_match_coordinate_descent(spark, name, alpha, l1):
    df, X, y = _lineitem(spark)
    params = {"alpha": alpha} if name == "Lasso" else {"alpha": alpha, "l1_ratio": l1}
    est = make_model("regression", name, FitContext(n_rows=len(y), label_std=y.std()), **params)
    est.setTol(1e-12)
    m = est.fit(df)
    assert np.allclose(m.coefficients.toArray(), _coordinate_descent(X, y, alpha, l1), rtol=1e-3, atol=1e-4)


def test_logistic_matches_newton(spark):
    ds = V.doc_stats(spark, SF_MID)
    cols = ["non_letter", "toxic"]
    df = VectorAssembler(inputCols=cols, outputCol="features").transform(
        ds.withColumn("label", F.col("quality").cast("double")))
    pdf = ds.select(*cols, "quality").toPandas()
    X = np.column_stack([pdf[cols].to_numpy(), np.ones(len(pdf))])
    y = pdf["quality"].to_numpy(float)
    C = 0.5
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ w))
        reg = np.diag([1 / C, 1 / C, 0.0])
        g = X.T @ (p - y) + reg @ w
        H = X.T @ (X * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    m = make_model("classification", "Logistic Regression", FitContext(n_rows=len(y)), C=C).fit(df)
    assert np.allclose(m.coefficients.toArray(), w[:2], rtol=1e-3, atol=1e-4)


def test_factory_knows_every_model_and_grid():
    ctx = FitContext(n_rows=100, label_std=1.0, n_classes=2)
    for name in CLASSIFIERS:
        assert make_model("classification", name, ctx) is not None
        assert param_grid("classification", name)
    for name in REGRESSORS:
        assert make_model("regression", name, ctx) is not None
    assert len(param_grid("classification", "XGBoost")) == 27
    assert len(param_grid("classification", "Random Forest")) == 9


def test_knn_matches_brute_force(spark):
    e = V.table(spark, SF_SMALL, "embeddings").limit(200).toPandas()
    X = np.stack(e["embedding"].map(lambda v: np.asarray(v, float)))
    y = e["label"].to_numpy(float)
    q, r = X[:40], X[40:]
    qdf = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(40)], "_qid long, _vec array<double>")
    rdf = spark.createDataFrame([(int(i), X[i].tolist(), float(y[i])) for i in range(40, len(X))],
                                "_rid long, _vec array<double>, _y double")
    pred = {r_["_qid"]: r_["_pred"] for r_ in
            NB.knn_predict(NB.knn_candidates(qdf, rdf, 5, block_rows=32), "regression").collect()}
    d = ((q[:, None, :] - r[None, :, :]) ** 2).sum(-1)
    nn = np.argsort(d, axis=1, kind="stable")[:, :5]
    want = y[40:][nn].mean(1)
    assert np.allclose([pred[i] for i in range(40)], want)


def test_pca_matches_numpy(spark):
    li = V.table(spark, SF_SMALL, "lineitem").select(*COLS)
    X = li.toPandas().to_numpy(float)
    means, comps, var = FE.fit_pca(li, COLS, 2)
    Xc = X - X.mean(0)
    _, s, vt = np.linalg.svd(Xc, full_matrices=False)
    for k in range(2):
        v = vt[k] * np.sign(vt[k][np.argmax(np.abs(vt[k]))])
        assert np.allclose(comps[k], v, atol=1e-6)
    assert np.allclose(var, s[:2] ** 2 / (len(X) - 1), rtol=1e-6)


def test_isolation_forest_flags_planted_extremes(spark):
    part = V.table(spark, SF_SMALL, "part")
    planted = part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 100 == 0,
                                                      F.col("p_retailprice") * 50).otherwise(F.col("p_retailprice")))
    kept, removed = OUT.remove_outliers(planted, ["p_size", "p_retailprice"], key="p_partkey")
    n = part.count()
    assert abs(removed - 0.05 * n) <= 2
    kept_keys = {r["p_partkey"] for r in kept.select("p_partkey").collect()}
    assert not any(k % 100 == 0 for k in kept_keys)
