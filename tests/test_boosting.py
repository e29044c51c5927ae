"""Second-order boosting: trees against a search over all splits, both plans, missing values, saving, explanations."""
import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabml.operators import explain as X
from tabml.operators.clean import DataError
from tabml.operators.metrics import feature_importance
from tabml.plans import boosting as B
from tabml.plans.models import FitContext, make_model


def _points(n=700, seed=3):
    rng = np.random.default_rng(seed)
    A = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 5, n), rng.integers(0, 60, n) / 4]).astype(float)
    y = A[:, 0] * 2 + np.where(A[:, 1] > 2, 40.0, 0.0) * (A[:, 2] > 7) + rng.normal(size=n)
    return A, y


def _frame(spark, A, y, parts=3):
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(A, y))],
                                 ["_row_id", "features", "label"]).repartition(parts, "_row_id")


def _split(A, g, rows, l2, least):
    """Best (gain, feature, value) of some rows with Hessians of 1, from every value of every feature."""
    best = (-math.inf, 0, 0.0)
    for j in range(A.shape[1]):
        for v in np.unique(A[rows, j])[:-1]:
            go = A[rows, j] <= v
            if least <= go.sum() <= len(rows) - least:
                a, b = g[rows][go], g[rows][~go]
                gain = a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - g[rows].sum() ** 2 / (len(rows) + l2)
                if gain > best[0] + 1e-9:
                    best = (gain, j, v)
    return best


@pytest.mark.parametrize("steep", [False, True])
def test_leaves_are_split_one_by_one_by_greatest_gain(spark, steep):
    A, y = _points(900)
    if steep:
        y = np.exp(A[:, 0] / 2) + y   # one leaf after the other at one end
    model = make_model("regression", "LightGBM", FitContext(n_rows=len(y)), n_estimators=1).fit(_frame(spark, A, y))
    g = y.mean() - y
    heap, want = [], []

    def offer(rows, path):
        gain, j, v = _split(A, g, rows, 0.0, 20)
        if gain > B.MIN_GAIN:
            heapq.heappush(heap, (-gain, path, j, v, rows.tolist()))
    offer(np.arange(len(y)), "")
    while heap and len(want) < 30:
        gain, path, j, v, rows = heapq.heappop(heap)
        want.append((path, j, v, -gain))
        rows = np.array(rows)
        go = A[rows, j] <= v
        offer(rows[go], path + "L")
        offer(rows[~go], path + "R")
    left = model.trees()[0]["left"]
    got = sorted(((left[n] - 1) // 2, path, f, at, gain) for _, n, path, f, at, gain, _, _ in model.nodes() if f >= 0)
    assert [x[1:4] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[4] for x in got], [x[3] for x in want])
    assert not steep or max(len(x[0]) for x in want) > 8   # no limit of depth


@pytest.mark.parametrize("name", ["XGBoost", "LightGBM"])
@pytest.mark.parametrize("task", ["regression", "two", "three"])
def test_jobs_for_passes_give_the_trees_of_one_task(spark, monkeypatch, name, task):
    A, y = _points()
    A[::17, 2] = np.nan
    label = y if task == "regression" else np.digitize(y, [45] if task == "two" else [25, 60]).astype(float)
    df = _frame(spark, A, label)
    ctx = FitContext(n_rows=len(y), n_classes=3 if task == "three" else 2)
    est = make_model("regression" if task == "regression" else "classification", name, ctx, n_estimators=3, max_depth=3)
    one = est.fit(df)
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    monkeypatch.setattr(B, "PASS_BYTES", 40_000)   # two nodes a pass
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    many = est.fit(df)
    for column in ("size", "feature", "threshold", "left", "right"):
        assert one.getOrDefault(column) == many.getOrDefault(column)
    assert np.allclose(one.getOrDefault("value"), many.getOrDefault("value"))
    assert len(one.trees()) == 3 * (3 if task == "three" else 1)


def test_three_classes_are_one_softmax_model(spark, tmp_path):
    A, y = _points()
    label = np.digitize(y, [25, 60]).astype(float)
    df = _frame(spark, A, label)
    model = make_model("classification", "XGBoost", FitContext(n_rows=len(y), n_classes=3), n_estimators=10).fit(df)
    out = model.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).toPandas()
    P = np.stack(out["p"])
    assert np.allclose(P.sum(axis=1), 1)
    assert (P.argmax(axis=1) == out["prediction"]).all()
    assert (out["prediction"] == out["label"]).mean() > 0.95
    share = np.bincount(label.astype(int)) / len(label)
    loss = -np.log(P[np.arange(len(P)), out["label"].astype(int)]).mean()
    assert loss < 0.3 * -(share * np.log(share)).sum()
    model.write().save(str(tmp_path / "m"))
    again = B.BoostedTrees.load(str(tmp_path / "m"))
    assert [r[0] for r in again.transform(df).orderBy("_row_id").select("rawPrediction").collect()] == [
        r[0] for r in model.transform(df).orderBy("_row_id").select("rawPrediction").collect()]
    assert again.numClasses == 3


@pytest.mark.parametrize("classes", [2, 3])
def test_shapley_values_add_up_to_the_margins(spark, classes):
    A, y = _points(200)
    df = _frame(spark, A, np.digitize(y, [45] if classes == 2 else [25, 60]).astype(float))
    model = make_model("classification", "LightGBM", FitContext(n_rows=200, n_classes=classes), n_estimators=4).fit(df)
    phi, base = X.tree_shap(model, df, ["a", "b", "c"])
    sums = {(int(r[0]), r[1]): r[2] for r in phi.groupBy("row_id", "class").agg(F.sum("phi")).collect()}
    for r in model.transform(df).select("_row_id", vector_to_array("rawPrediction").alias("m")).collect():
        for c in ([1] if classes == 2 else range(3)):
            assert sums[r[0], c] + base[0 if classes == 2 else c] == pytest.approx(r[1][c], abs=1e-9)


def test_importances_by_gain_and_by_number_of_splits(spark):
    A, y = _points()
    df = _frame(spark, A, y)
    for name in ("XGBoost", "LightGBM"):
        model = make_model("regression", name, FitContext(n_rows=len(y)), n_estimators=5).fit(df)
        got = {r[0]: r[1] for r in feature_importance(model, ["a", "b", "c"], spark=spark).collect()}
        assert sum(got.values()) == pytest.approx(1)
        splits = [(n[3], n[5]) for n in model.nodes() if n[3] >= 0]
        each = {j: [g for f, g in splits if f == j] for j in range(3)}
        raw = [len(each[j]) if name == "LightGBM" else np.mean(each[j] or [0]) for j in range(3)]
        assert [got[c] for c in "abc"] == pytest.approx((np.array(raw) / sum(raw)).tolist())


def test_nothing_to_split_wrong_labels_and_limits(spark):
    df = _frame(spark, np.ones((40, 2)), np.arange(40.0))
    flat = make_model("regression", "XGBoost", FitContext(n_rows=40), n_estimators=2).fit(df)
    assert {round(r[0], 9) for r in flat.transform(df).select("prediction").collect()} == {19.5}
    nothing = _frame(spark, np.full((40, 2), np.nan), np.arange(40.0))
    assert len(make_model("regression", "LightGBM", FitContext(n_rows=40), n_estimators=1).fit(nothing).nodes()) == 1
    with pytest.raises(DataError):
        make_model("classification", "XGBoost", FitContext(n_rows=40, n_classes=2)).fit(df)
    with pytest.raises(DataError):
        B.HistogramBoosting(maxDepth=0).fit(df)
    with pytest.raises(DataError):
        make_model("regression", "XGBoost", FitContext(n_rows=0)).fit(df.where("false"))


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(0)
    A = np.column_stack([rng.normal(size=3000), rng.integers(0, 7, 3000)])
    cuts = B.bin_cuts(_frame(spark, A, np.zeros(3000)), "features", 64)
    assert cuts[1].tolist() == [0, 1, 2, 3, 4, 5]
    held = np.bincount(np.searchsorted(cuts[0], A[:, 0], side="left"))
    assert len(held) == 64 and held.max() < 1.3 * 3000 / 64


def test_sums_are_as_wide_as_the_bins_and_travel_in_runs_of_features(spark, monkeypatch):
    rng = np.random.default_rng(3)
    A = np.column_stack([rng.integers(0, 2, (600, 5)), rng.normal(size=600), rng.integers(0, 4, (600, 3))]).astype(float)
    y = 3 * A[:, 0] + A[:, 5] + A[:, 8] * A[:, 2]
    df = _frame(spark, A, y)
    est = make_model("regression", "XGBoost", FitContext(n_rows=600), n_estimators=2, max_depth=3)
    one = est.fit(df)
    seen = []
    summed = B._Plan.sums

    def watched(self, *args):
        for c, node, each in summed(self, *args):
            seen.append(each.shape)
            yield c, node, each

    monkeypatch.setattr(B._Plan, "sums", watched)
    plan = B._Plan("regression", 1, (2, 2, 2, 2, 2, 200, 4, 4, 4), 2.0, 1.0, 1.0, 1, 0.3, 3, np.inf, 1, False)
    tree = B.Tree()
    block = pd.Series({"bins": rng.integers(0, 2, (50, 9)).astype(np.uint8).tobytes(), "label": y[:50].tobytes(), "margin": np.zeros(50).tobytes()})
    assert len(list(plan.sums([tree.arrays()], [], [(0, 0)], [[block]]))) == 1 and seen == [(3, 222)]
    monkeypatch.setattr(B._Plan, "sums", summed)
    monkeypatch.setattr(B, "RUN_BINS", 7)
    assert plan.runs() == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8), (8, 9)]
    for name in ("TASK_ROWS", "PASS_ROWS"):
        monkeypatch.setattr(B, name, 100)
    many = est.fit(df)
    for column in ("size", "feature", "threshold", "left", "right"):
        assert one.getOrDefault(column) == many.getOrDefault(column)
    assert np.allclose(one.getOrDefault("value"), many.getOrDefault("value"))
