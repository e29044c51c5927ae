"""The whole flow: prepare, fit, evaluate, save/load, batch and stream scoring."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_MID, SF_SMALL
from tabml.operators import neighbors as NB
from tabml.operators.clean import DataError, require_min_rows
from tabml.functions.columns import sanitize_names
from tabml.plans import views as V
from tabml.plans.recipe import Recipe, prepare
from tabml.plans.score import ScoringBundle, load_bundle, save_bundle, score
from tabml.plans.train import (best_model, compare_models, cross_validate, evaluate, fit_model,
                               full_pipeline, grid_search)


@pytest.fixture(scope="module")
def fitted(spark):
    fr = prepare(V.doc_stats(spark, SF_MID), target="quality", key="doc_id")
    model = fit_model(fr, "Random Forest")
    return fr, model


def test_forest_beats_majority(spark, fitted):
    fr, model = fitted
    res = evaluate(fr, model)
    majority = fr.test.groupBy("label").count().agg(F.max("count")).first()[0] / fr.test.count()
    assert res["accuracy"] > majority
    assert 0.5 < res["auc"] <= 1.0


def test_save_load_score_is_identical(spark, fitted, tmp_path):
    fr, model = fitted
    bundle = ScoringBundle.from_fit(fr, full_pipeline(fr, model))
    rows = V.doc_stats(spark, SF_MID).drop("quality")
    before = score(bundle, rows, passthrough=["doc_id"]).select("doc_id", "prediction").toPandas().sort_values("doc_id")
    save_bundle(bundle, str(tmp_path / "model"))
    # the scratch table that the imputer was fitted on is not needed any more
    imputer = next(s for s in bundle.pipeline.stages if type(s).__name__ == "KnnImputerModel")
    imputer._set(donorPath=str(tmp_path / "gone"))
    again = load_bundle(spark, str(tmp_path / "model"))
    after = score(again, rows, passthrough=["doc_id"]).select("doc_id", "prediction").toPandas().sort_values("doc_id")
    assert before["prediction"].tolist() == after["prediction"].tolist()
    assert set(before["prediction"]) <= {0, 1}


def test_stream_score_equals_batch(spark, fitted, tmp_path):
    from tabml.streaming.score_stream import (file_stream, needs_batches, run_to_table, score_files,
                                              score_stream_batches)
    fr, model = fitted
    bundle = ScoringBundle.from_fit(fr, full_pipeline(fr, model))
    rows = V.doc_stats(spark, SF_MID).drop("quality")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = score(bundle, rows, passthrough=["doc_id"]).select("doc_id", "prediction").toPandas()
    batch = batch.sort_values("doc_id")
    # the auto recipe imputes with KNN: micro-batches are scored as static frames
    assert needs_batches(bundle)
    q = score_stream_batches(bundle, file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"),
                             str(tmp_path / "ckpt"), passthrough=["doc_id"])
    q.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "prediction").toPandas()
    assert streamed.sort_values("doc_id")["prediction"].tolist() == batch["prediction"].tolist()
    # a projection-only pipeline runs as a plain streaming query
    fr2 = prepare(V.doc_stats(spark, SF_MID), target="quality", key="doc_id",
                  recipe=Recipe(impute="mean", outliers=False))
    b2 = ScoringBundle.from_fit(fr2, full_pipeline(fr2, fit_model(fr2, "Logistic Regression")))
    run_to_table(score_files(spark, b2, str(tmp_path / "in"), rows.schema, passthrough=["doc_id"]),
                 "tabml_stream_out", str(tmp_path / "ckpt2"))
    s2 = spark.table("tabml_stream_out").select("doc_id", "prediction").toPandas().sort_values("doc_id")
    b2_batch = score(b2, rows, passthrough=["doc_id"]).select("doc_id", "prediction").toPandas()
    assert s2["prediction"].tolist() == b2_batch.sort_values("doc_id")["prediction"].tolist()


def test_grid_search_and_cross_validation(spark, fitted):
    fr, _ = fitted
    best, table = grid_search(fr, "Logistic Regression", [{"C": 0.1}, {"C": 10.0}], parallelism=2)
    assert best in ({"C": 0.1}, {"C": 10.0}) and len(table) == 2
    folds, mean, std = cross_validate(fr, "Gaussian Naive Bayes")
    assert len(folds) == 5 and 0 <= mean <= 1 and std >= 0


def test_compare_models_small_set(spark, fitted):
    fr, _ = fitted
    board, errors = compare_models(fr, ["Random Forest", "Logistic Regression", "K-Nearest Neighbors"])
    assert not errors and board.count() == 3
    assert best_model(board).count() == 1


def test_regression_flow(spark):
    fr = prepare(V.doc_stats(spark, SF_MID).drop("n_words"), target="n_chars", key="doc_id",
                 recipe=Recipe(outliers=False))
    assert fr.task == "regression"
    for name in ["Ridge", "SVR", "LightGBM"]:
        res = evaluate(fr, fit_model(fr, name, {"n_estimators": 10} if name == "LightGBM" else None))
        assert res["r2"] is not None and np.isfinite(res["r2"])


def test_knn_imputer_fills_every_gap(spark):
    df = V.part_null(spark, SF_SMALL)
    cols = ["p_partkey", "p_size", "p_retailprice"]
    out = NB.KnnImputer(inputCols=cols, k=3).fit(df).transform(df)
    assert out.count() == df.count()
    assert out.where(F.col("p_size").isNull() | F.col("p_retailprice").isNull()).count() == 0


def test_guards():
    assert sanitize_names(["a b", "1x", "a b", "%%"]) == ["ab", "feature_1x", "ab_2", "feature_3"]


def test_min_rows_guard(spark):
    with pytest.raises(DataError):
        require_min_rows(V.table(spark, SF_SMALL, "region"), 10)


def test_split_features_and_roles(spark):
    from tabml.functions.columns import column_roles
    from tabml.operators.target import split_features
    o = V.table(spark, SF_SMALL, "orders")
    t, feats = split_features(o)
    assert t == "o_orderpriority" and "o_orderpriority" not in feats
    roles = column_roles(o)
    assert roles["datetime"] == ["o_orderdate"] and "o_totalprice" in roles["numeric"]
