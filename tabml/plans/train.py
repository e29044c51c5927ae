"""Fit, predict and evaluate one model on a prepared ``FitResult``;
F2/F3 tuning and cross-validation; F5/F6 comparison and best model."""

from __future__ import annotations

import statistics
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import rows as RW
from .linear_stats import LINEAR_FAMILY, grid_scores, moments
from .models import CLASSIFIERS, REGRESSORS, make_model, param_grid
from .recipe import FEATURES, KEY, LABEL, FitResult, build_feature_pipeline, resample_part

CLASSIFICATION = "classification"


def fit_model(fr: FitResult, name: str, params: dict | None = None, train: DataFrame | None = None):
    est = make_model(fr.task, name, fr.context(), **(params or {}))
    return est.fit(train if train is not None else fr.train)


def predictions(model, df: DataFrame) -> DataFrame:
    """(key, label, prediction[, score]) where score = P(class 1) for binary
    models that give probabilities."""
    out = model.transform(df)
    cols = [F.col(KEY), F.col(LABEL), F.col("prediction").cast("double").alias("prediction")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias("score"))
    return out.select(*cols)


def evaluate(fr: FitResult, model, df: DataFrame | None = None) -> dict:
    """Metrics of G1-G3 / G6-G8 as plain numbers (one small aggregate each)."""
    pred = predictions(model, df if df is not None else fr.test).persist(StorageLevel.MEMORY_AND_DISK)
    if fr.task == CLASSIFICATION:
        # one job: the (label, prediction) cell counts, at most classes^2 rows
        cells = M.per_class_counts(pred).collect()
        total = sum(r["support"] for r in cells)
        acc = sum(r["tp"] for r in cells) / total if total else 0.0
        f1 = 0.0
        for r in cells:
            p = r["tp"] / (r["tp"] + r["fp"]) if r["tp"] + r["fp"] else 0.0
            q = r["tp"] / (r["tp"] + r["fn"]) if r["tp"] + r["fn"] else 0.0
            f1 += (2 * p * q / (p + q) if p + q else 0.0) * r["support"]
        res = {"accuracy": acc, "f1": f1 / total if total else 0.0}
        res["warnings"] = M.accuracy_warnings(acc, sum(1 for r in cells if r["support"] > 0))
        if fr.n_classes == 2 and "score" in pred.columns:
            res["auc"] = M.auc_roc(pred, score="score", positive=1.0).first()[0]
        else:
            res["auc"] = None
    else:
        row = M.regression_metrics(pred).first()
        res = {"r2": row["r2"], "mse": row["mse"], "mae": row["mae"]}
    res["predictions"] = pred
    return res


def full_pipeline(fr: FitResult, model) -> PipelineModel:
    """Feature stages + model: what A13 saves and I2 applies."""
    return PipelineModel(stages=list(fr.feature_model.stages) + [model])


def fold_count(fr: FitResult) -> int:
    """5 folds, or the smallest class count when it is 2-4; 0 = skip (a
    class with one row)."""
    if fr.task != CLASSIFICATION:
        return 5
    smallest = fr.split_train.groupBy(LABEL).count().agg(F.min("count")).first()[0]
    if smallest is None or smallest < 2:
        return 0
    return min(5, int(smallest))


def assigned_folds(fr: FitResult, k: int) -> DataFrame:
    """Fold numbers of the training part before outliers and balancing, so that copies of a row never lie in two folds."""
    raw = fr.split_train
    if fr.task == CLASSIFICATION:
        return RW.assign_folds(raw, KEY, k, seed=fr.recipe.seed, stratify=LABEL,
                               num_partitions=RW.partitions_for(fr.n_train))
    return RW.assign_folds(raw, KEY, k, seed=fr.recipe.seed)


def _fold_parts(fr: FitResult, folded: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training part (outliers removed and balanced on its own) and validation part of a fold."""
    tr = folded.where(F.col("fold") != fold).drop("fold")
    va = folded.where(F.col("fold") == fold).drop("fold")
    if fr.recipe.resample != "before_split":
        tr = resample_part(tr, fr.recipe, fr.numeric, fr.task == CLASSIFICATION and fr.n_classes == 2)
    return tr, va


def _score(fr, model, df):
    pred = predictions(model, df)
    if fr.task == CLASSIFICATION:
        return M.accuracy(pred).first()[0]
    return M.regression_metrics(pred).first()["r2"]


def grid_search(fr: FitResult, name: str, grid: list[dict] | None = None, parallelism: int = 4):
    """every grid point x every fold; outliers, balancing and the whole feature pipeline are redone
    on each fold's training part (no leak from the validation part), once
    per fold, and the grid points of one fold run in parallel threads (each
    fit is itself a distributed job).  The linear family is not refitted: one pass over a fold gives
    the cross-products that all its grid points are solved and scored from (``linear_stats``).
    Returns (best params, table of (params, mean score))."""
    grid = grid if grid is not None else param_grid(fr.task, name)
    k = fold_count(fr)
    if k < 2:
        return (grid[0] if grid else {}), []
    folded = assigned_folds(fr, k).persist(StorageLevel.MEMORY_AND_DISK)
    scores = [[0.0] * k for _ in grid]
    for f in range(k):
        tr, va = _fold_parts(fr, folded, f)
        fm, _, _ = build_feature_pipeline(tr, fr.numeric, fr.categorical, fr.other, fr.recipe, fr.task)
        if fr.task != CLASSIFICATION and name in LINEAR_FAMILY:
            both = fm.transform(tr).select(LABEL, FEATURES, F.lit(0).alias("_part")).unionByName(
                fm.transform(va).select(LABEL, FEATURES, F.lit(1).alias("_part")))
            parts = moments(both, "_part", FEATURES, LABEL)
            for i, s in enumerate(grid_scores(parts[0], parts[1], name, grid)):
                scores[i][f] = s
            continue
        tr_t = fm.transform(tr).select(KEY, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        va_t = fm.transform(va).select(KEY, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)

        def one(i, tr_t=tr_t, va_t=va_t):
            model = make_model(fr.task, name, fr.context(), **grid[i]).fit(tr_t)
            return i, _score(fr, model, va_t)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for i, s in pool.map(one, range(len(grid))):
                scores[i][f] = s
        tr_t.unpersist()
        va_t.unpersist()
    folded.unpersist()
    means = [sum(s) / k for s in scores]
    best = max(range(len(grid)), key=lambda i: (means[i], -i))
    return grid[best], list(zip(grid, means))


def cross_validate(fr: FitResult, name: str, params: dict | None = None):
    """fold, score per fold, plus mean and population std."""
    k = fold_count(fr)
    if k < 2:
        return [], None, None
    folded = assigned_folds(fr, k).persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for f in range(k):
        tr, va = _fold_parts(fr, folded, f)
        fm, _, _ = build_feature_pipeline(tr, fr.numeric, fr.categorical, fr.other, fr.recipe, fr.task)
        model = make_model(fr.task, name, fr.context(), **(params or {})).fit(
            fm.transform(tr).select(KEY, LABEL, FEATURES))
        out.append((f, _score(fr, model, fm.transform(va).select(KEY, LABEL, FEATURES))))
    folded.unpersist()
    vals = [s for _, s in out]
    return out, sum(vals) / len(vals), statistics.pstdev(vals)


def compare_models(fr: FitResult, names: list[str] | None = None, params: dict | None = None,
                   parallelism: int = 3):
    """fit every chosen model with default settings on the one cached
    train/test pair; metrics rounded to 4 decimals; a failing model is
    reported and skipped.  Returns (leaderboard DataFrame, errors).

    Models are fitted from ``parallelism`` driver threads: each fit is a
    sequence of distributed jobs, and running a few at once keeps the
    cluster busy while one model waits on its driver-side steps."""
    names = names or (CLASSIFIERS if fr.task == CLASSIFICATION else REGRESSORS)
    params = params or {}
    rows, errors = [], {}

    def one(pos_name):
        pos, name = pos_name
        try:
            model = fit_model(fr, name, params.get(name))
            m = evaluate(fr, model)
            m.pop("predictions").unpersist()
            m.pop("warnings", None)
            return pos, name, m, None
        except Exception as e:  # noqa: BLE001 - reported per model, as the reference does
            return pos, name, None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(one, enumerate(names)))
    for pos, name, m, err in results:
        if err:
            errors[name] = err
            continue
        if fr.task == CLASSIFICATION:
            auc = "N/A" if m["auc"] is None else f"{m['auc']:.4f}"
            rows.append((pos, name, round(m["accuracy"], 4), round(m["f1"], 4), auc))
        else:
            rows.append((pos, name, round(m["r2"], 4), round(m["mse"], 4), round(m["mae"], 4)))
    spark = fr.train.sparkSession
    schema = ("position int, model string, accuracy double, f1 double, auc_roc string"
              if fr.task == CLASSIFICATION else "position int, model string, r2 double, mse double, mae double")
    return spark.createDataFrame(rows, schema), errors


def best_model(leaderboard: DataFrame, metric: str | None = None) -> DataFrame:
    """highest accuracy (or r2); the first listed wins ties."""
    metric = metric or ("accuracy" if "accuracy" in leaderboard.columns else "r2")
    return leaderboard.orderBy(F.desc(metric), F.asc("position")).limit(1)
