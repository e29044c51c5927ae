"""Grids of the linear family from sufficient statistics: equal to refitting on the rows."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabml.plans.linear_stats import Moments, grid_by_folds, grid_scores, moments, r2, solve
from tabml.plans.models import FitContext, make_model


def rows(seed=1, n=400, d=4, shift=0.0):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) + shift
    return X, X @ np.array([3.0, -2.0, 0.0, 0.5][:d]) + rng.normal(0, 0.7, n) + 5


def table(spark, X, y, folds=None):
    folds = np.zeros(len(y), int) if folds is None else folds
    return spark.createDataFrame([(Vectors.dense(x), float(v), int(f)) for x, v, f in zip(X, y, folds)], ["features", "label", "fold"])


def test_moments_equal_numpy_far_from_zero(spark):
    X, y = rows(shift=1e8)
    folds = np.arange(400) % 3
    got = moments(table(spark, X, y, folds).repartition(20), "fold")
    assert sorted(got) == [0, 1, 2]
    for f, m in got.items():
        Z = np.column_stack([X, y])[folds == f]
        assert m.n == len(Z) and np.allclose(m.mean, Z.mean(axis=0), rtol=1e-14)
        assert np.allclose(m.cross, (Z - Z.mean(axis=0)).T @ (Z - Z.mean(axis=0)), rtol=1e-6, atol=1e-3)
    total = got[0] + got[1] + got[2]
    assert np.allclose(total.cross, Moments.of(np.column_stack([X, y])).cross, rtol=1e-6, atol=1e-3)


@pytest.mark.parametrize("name,params,close", [("Linear Regression", {}, 1e-9), ("Ridge", {"alpha": 3.0}, 1e-9), ("Lasso", {"alpha": 0.4}, 1e-6),
                                               ("ElasticNet", {"alpha": 0.4, "l1_ratio": 0.3}, 1e-6)])
def test_solutions_and_scores_equal_refitting(spark, name, params, close):
    X, y = rows()
    A, B = table(spark, X[:300], y[:300]), (X[300:], y[300:])
    est = make_model("regression", name, FitContext(n_rows=300, label_std=float(y[:300].std())), **params)
    model = est.setTol(1e-12).fit(A)
    w, b = solve(Moments.of(np.column_stack([X[:300], y[:300]])), name, **params)
    off = y[300:] - B[0] @ w - b
    score = 1 - (off ** 2).sum() / ((y[300:] - y[300:].mean()) ** 2).sum()
    got = grid_scores(moments(A)[0], moments(table(spark, *B))[0], name, [params])[0]
    assert abs(got - score) < 1e-9
    e = y[300:] - B[0] @ model.coefficients.toArray() - model.intercept
    refit = 1 - (e ** 2).sum() / ((y[300:] - y[300:].mean()) ** 2).sum()
    assert abs(got - refit) < close


def test_lasso_meets_its_optimality_conditions():
    X, y = rows(d=4)
    m = Moments.of(np.column_stack([X, y]))
    for name, alpha, l1 in (("Lasso", 0.3, 1.0), ("ElasticNet", 0.5, 0.5)):
        w, b = solve(m, name, alpha, l1)
        g = X.T @ (y - X @ w - b) / len(y) - (0 if name == "Lasso" else alpha * (1 - l1)) * w
        assert (np.abs(g) <= alpha * l1 + 1e-9).all() and np.allclose(g[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-9)
    assert not solve(m, "Lasso", 1e6)[0].any()


def test_folds_are_trained_on_the_others():
    X, y = rows()
    folds = {f: Moments.of(np.column_stack([X, y])[np.arange(400) % 4 == f]) for f in range(4)}
    grid = [{"alpha": 0.1}, {"alpha": 50.0}]
    got = grid_by_folds(folds, "Ridge", grid)
    for i, p in enumerate(grid):
        for f in range(4):
            out = np.arange(400) % 4 == f
            Z = X[~out] - X[~out].mean(axis=0)
            w = np.linalg.solve(Z.T @ Z + p["alpha"] * np.eye(4), Z.T @ y[~out])
            e = y[out] - y[~out].mean() - (X[out] - X[~out].mean(axis=0)) @ w
            assert abs(got[i][f] - (1 - (e ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum())) < 1e-9


def test_flat_columns_and_labels():
    flat = Moments.of(np.column_stack([np.ones(5), np.arange(5.0), np.full(5, 2.0)]))
    for name in ("Linear Regression", "Ridge", "Lasso", "ElasticNet"):
        w, b = solve(flat, name)
        assert np.allclose(w, 0) and b == 2.0 and r2(flat, w, b) == 1.0
    assert r2(flat, np.array([0.0, 1.0]), 0.0) == 0.0
