"""One factory for every model the reference offers.

Each name maps to a ``pyspark.ml`` estimator (or one of ours for RBF SVM and
KNN).  Penalties are converted so the optimum equals the reference
library's objective:

* logistic ``C``  -> regParam = 1 / (C n), no standardisation
* ridge ``alpha`` -> regParam = alpha s / n (s = population std of the label)
* lasso ``alpha`` -> regParam = alpha, elasticNetParam = 1
* elastic net     -> A = alpha l1, B = alpha (1 - l1) s;
                     regParam = A + B, elasticNetParam = A / (A + B)
* boosting        -> ``boosting``: second-order gain; growth by levels with an L2 penalty of 1
                     ("XGBoost"), by leaves with 31 leaves of 20 rows at least ("LightGBM")
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor

CLASSIFIERS = ["Random Forest", "XGBoost", "LightGBM", "Logistic Regression", "SVC",
               "K-Nearest Neighbors", "Gaussian Naive Bayes"]
REGRESSORS = ["Linear Regression", "Ridge", "Lasso", "ElasticNet", "SVR", "K-Nearest Neighbors",
              "Random Forest", "XGBoost", "LightGBM"]

# Spark's deepest allowed tree; stands in for "no depth limit" (an explicit larger depth is an error).
MAX_TREE_DEPTH = 30
# Tree ensembles: cache each row's node id between levels (deep trees then
# skip re-walking every tree per level; the cache is checkpointed into
# spark.checkpoint.dir every 10 iterations) and give the per-level histogram
# aggregation room for many nodes per pass.
TREE_OPTS = {"cacheNodeIds": True, "maxMemoryInMB": 1024, "checkpointInterval": 10}
# Regularisation that the two boosted models have by default.
BOOSTING = {
    "XGBoost": {"growth": "level", "l2": 1.0, "minHessian": 1.0, "minRows": 1, "maxLeaves": 0},
    "LightGBM": {"growth": "leaf", "l2": 0.0, "minHessian": 1e-3, "minRows": 20, "maxLeaves": 31},
}

# Defaults of the comparison table (library defaults).
COMPARE_DEFAULTS = {
    "Random Forest": {"n_estimators": 100, "max_depth": None},
    "XGBoost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3},
    "LightGBM": {"n_estimators": 100, "max_depth": -1, "learning_rate": 0.1},
    "Logistic Regression": {"C": 1.0},
    "SVC": {"C": 1.0, "gamma": "scale"},
    "SVR": {"C": 1.0, "gamma": "scale"},
    "K-Nearest Neighbors": {"n_neighbors": 5},
    "Gaussian Naive Bayes": {},
    "Linear Regression": {},
    "Ridge": {"alpha": 1.0},
    "Lasso": {"alpha": 1.0},
    "ElasticNet": {"alpha": 1.0, "l1_ratio": 0.5},
}


@dataclass(frozen=True)
class FitContext:
    """Training-set facts some conversions need."""
    n_rows: int
    label_std: float = 1.0
    n_classes: int = 2
    features_col: str = "features"
    label_col: str = "label"
    seed: int = 42


def _depth(d, unlimited):
    if d is None or d == -1:
        return unlimited
    if int(d) > MAX_TREE_DEPTH:
        raise ValueError(f"Spark's trees are at most {MAX_TREE_DEPTH} levels deep")
    return int(d)


def _boosting(task, name, p, ctx, common):
    from .boosting import HistogramBoosting
    depth = 0 if p["max_depth"] is None or int(p["max_depth"]) <= 0 else int(p["max_depth"])
    if name == "XGBoost" and depth == 0:
        depth = MAX_TREE_DEPTH
    return HistogramBoosting(task=task, nClasses=max(2, ctx.n_classes), rounds=int(p["n_estimators"]), rate=float(p["learning_rate"]),
                             maxDepth=depth, **BOOSTING[name], **common)


def make_model(task: str, name: str, ctx: FitContext, **params):
    """Return an unfitted estimator for ``name`` with ``params`` applied."""
    p = {**COMPARE_DEFAULTS.get(name, {}), **params}
    common = dict(featuresCol=ctx.features_col, labelCol=ctx.label_col)
    n = max(ctx.n_rows, 1)
    s = ctx.label_std if ctx.label_std and ctx.label_std > 0 else 1.0
    if task == "classification":
        if name == "Random Forest":
            return RandomForestClassifier(numTrees=int(p["n_estimators"]),
                                          maxDepth=_depth(p["max_depth"], MAX_TREE_DEPTH),
                                          featureSubsetStrategy=str(p.get("max_features", "sqrt")), bootstrap=bool(p.get("bootstrap", True)),
                                          seed=ctx.seed, **TREE_OPTS, **common)
        if name in ("XGBoost", "LightGBM"):
            return _boosting(task, name, p, ctx, common)
        if name == "Logistic Regression":
            return LogisticRegression(regParam=1.0 / (float(p["C"]) * n), elasticNetParam=0.0,
                                      standardization=False, maxIter=1000, **common)
        if name == "Gaussian Naive Bayes":
            return NaiveBayes(modelType="gaussian", **common)
        if name == "SVC":
            from .kernel import RbfSVC
            return RbfSVC(C=float(p["C"]), gamma=str(p["gamma"]), seed=ctx.seed,
                          nClasses=ctx.n_classes, **common)
        if name == "K-Nearest Neighbors":
            from ..operators.neighbors import KNeighbors
            return KNeighbors(k=int(p["n_neighbors"]), task="classification", **common)
    else:
        if name == "Linear Regression":
            return LinearRegression(regParam=0.0, **common)
        if name == "Ridge":
            return LinearRegression(regParam=float(p["alpha"]) * s / n, elasticNetParam=0.0,
                                    standardization=False, **common)
        if name == "Lasso":
            return LinearRegression(regParam=float(p["alpha"]), elasticNetParam=1.0,
                                    standardization=False, maxIter=1000, **common)
        if name == "ElasticNet":
            a = float(p["alpha"]) * float(p["l1_ratio"])
            b = float(p["alpha"]) * (1.0 - float(p["l1_ratio"])) * s
            return LinearRegression(regParam=a + b, elasticNetParam=(a / (a + b)) if a + b > 0 else 0.0,
                                    standardization=False, maxIter=1000, **common)
        if name == "Random Forest":
            return RandomForestRegressor(numTrees=int(p["n_estimators"]),
                                         maxDepth=_depth(p["max_depth"], MAX_TREE_DEPTH),
                                         featureSubsetStrategy=str(p.get("max_features", "all")), bootstrap=bool(p.get("bootstrap", True)),
                                         seed=ctx.seed, **TREE_OPTS, **common)
        if name in ("XGBoost", "LightGBM"):
            return _boosting(task, name, p, ctx, common)
        if name == "SVR":
            from .kernel import RbfSVR
            return RbfSVR(C=float(p["C"]), gamma=str(p["gamma"]), epsilon=float(p.get("epsilon", 0.1)),
                          seed=ctx.seed, **common)
        if name == "K-Nearest Neighbors":
            from ..operators.neighbors import KNeighbors
            return KNeighbors(k=int(p["n_neighbors"]), task="regression", **common)
    raise ValueError(f"Unknown {task} model '{name}'")


def param_grid(task: str, name: str) -> list[dict]:
    """the reference's fixed grids, as a list of parameter dicts in
    grid order (first point wins ties)."""
    import itertools
    grids = {
        "Random Forest": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, None]},
        "XGBoost": {"n_estimators": [50, 100, 200], "max_depth": [3, 6, 9], "learning_rate": [0.01, 0.1, 0.2]},
        "LightGBM": {"n_estimators": [50, 100, 200], "max_depth": [5, 10, -1], "learning_rate": [0.01, 0.1, 0.2]},
        "Logistic Regression": {"C": [0.1, 1, 10]},
        "SVC": {"C": [0.1, 1, 10], "gamma": ["scale", "auto"]},
        "SVR": {"C": [0.1, 1, 10], "gamma": ["scale", "auto"]},
        "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7, 9]},
        "Ridge": {"alpha": [0.1, 1, 10]},
        "Lasso": {"alpha": [0.1, 1, 10]},
        "ElasticNet": {"alpha": [0.1, 1, 10], "l1_ratio": [0.1, 0.5, 0.9]},
        "Gaussian Naive Bayes": {},
        "Linear Regression": {},
    }
    g = grids.get(name, {})
    keys = sorted(g)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[g[k] for k in keys])] or [{}]
