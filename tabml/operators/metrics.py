"""Evaluation tables over (label, prediction[, score]).

Classification metrics start from ONE partial aggregate: counts per
(label, prediction) cell, a table of at most classes^2 rows.  Everything
else (precision, recall, F1, the report, the confusion grid) is derived from
that small table.  Ranking metrics (AUC, ROC) reduce rows to one row per
distinct score and run a distributed prefix sum over it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cache import remember
from ..functions.prefix import prefix_sums


def _cells(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return (df.select(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p"))
            .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))


def per_class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class, tp, fp, fn, support over the union of true and predicted classes."""
    cells = _cells(df, label, prediction)
    true_side = cells.groupBy(F.col("y").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = true_side.join(pred_side, "class", "full")
    return both.select(
        "class",
        F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
        (F.coalesce("predicted", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fp"),
        (F.coalesce("support", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("bigint").alias("fn"),
        F.coalesce("support", F.lit(0)).cast("bigint").alias("support"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def per_class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    c = per_class_counts(df, label, prediction)
    precision = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = c.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """G1: share of rows with label == prediction."""
    return df.agg(F.avg((F.col(label).cast("string") == F.col(prediction).cast("string")).cast("double"))
                  .alias("accuracy"))


def accuracy_warnings(acc: float, n_test_classes: int) -> list[str]:
    """G1 warnings: 0 %, 100 %, or one class in the test set."""
    out = []
    if n_test_classes < 2:
        out.append("Only one class is present in the test set.")
    if acc == 1.0:
        out.append("Accuracy is 100 %: check for leakage or a trivial target.")
    if acc == 0.0:
        out.append("Accuracy is 0 %.")
    return out


def f1_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted F1."""
    s = per_class_scores(df, label, prediction)
    return s.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          class_names: dict | None = None) -> DataFrame:
    """Class, precision, recall, f1, support, plus rows 'accuracy',
    'macro avg', 'weighted avg'.  Classes are the union of observed true and
    predicted values; 0 on an empty division."""
    kept = s = per_class_scores(df, label, prediction).persist(StorageLevel.MEMORY_AND_DISK)  # one row per class
    if class_names:
        m = F.create_map(*[x for k, v in class_names.items() for x in (F.lit(str(k)), F.lit(str(v)))])
        s = s.withColumn("class", F.coalesce(F.element_at(m, F.col("class")), F.col("class")))
    per = s.select(F.col("class"), "precision", "recall", "f1", "support", F.lit(0).alias("_order"))
    total = F.sum("support")
    acc = s.agg(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                (F.sum("tp").cast("double") / total).alias("f1"), total.cast("bigint").alias("support"),
                F.lit(1).alias("_order"))
    macro = s.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                  total.cast("bigint").alias("support"), F.lit(2).alias("_order"))
    weighted = s.agg(F.lit("weighted avg").alias("class"),
                     (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
                     total.cast("bigint").alias("support"), F.lit(3).alias("_order"))
    return remember(per.unionByName(acc).unionByName(macro).unionByName(weighted), kept)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts for every (true, predicted) pair over the observed classes,
    zeros included; a missing label or prediction is a class of its own.  The
    grid is the product of the class list with itself: that is the result."""
    cells = _cells(df, label, prediction).persist(StorageLevel.MEMORY_AND_DISK)
    classes = cells.select(F.col("y").alias("c")).union(cells.select(F.col("p").alias("c"))).distinct()
    grid = classes.select(F.col("c").alias("actual")).crossJoin(classes.select(F.col("c").alias("predicted")))
    joined = grid.join(cells, grid["actual"].eqNullSafe(cells["y"]) & grid["predicted"].eqNullSafe(cells["p"]), "left")
    return remember(joined.select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")), cells)


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    pos = (F.col(label) == F.lit(positive)).cast("long")
    return (df.select(F.col(score).cast("double").alias("s"), pos.alias("is_pos"))
            .groupBy("s").agg(F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg")))


def auc_roc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Exact ROC AUC by the rank-sum rule, tied scores counted half:
    AUC = sum_s pos(s) * (neg below s + neg(s)/2) / (P * N); null with one class."""
    counts = _score_counts(df, label, score, positive)
    cum = prefix_sums(counts, "s", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return cum.agg(
        F.try_divide(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Threshold, fpr, tpr at every distinct score (descending)."""
    counts = _score_counts(df, label, score, positive)
    cum = prefix_sums(counts, "s", ["pos", "neg"], descending=True)
    tot = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return cum.select(
        F.col("s").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.lit(float(tot["N"] or 0))).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.lit(float(tot["P"] or 0))).alias("tpr"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """G6-G8 in one aggregate: r2 = 1 - SSE/SST (not squared correlation), mse, mae.  A
    constant label has r2 1 if every prediction is right, else 0."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    n = F.count(F.lit(1))
    sse = F.sum((y - p) ** 2)
    sst = F.var_pop(y) * n
    r2 = F.when(sst == 0, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(sse, sst))
    return df.agg(r2.alias("r2"), F.try_divide(sse, n).alias("mse"), F.avg(F.abs(y - p)).alias("mae"))


def r2(df, label="label", prediction="prediction"):
    return regression_metrics(df, label, prediction).select("r2")


def mse(df, label="label", prediction="prediction"):
    return regression_metrics(df, label, prediction).select("mse")


def mae(df, label="label", prediction="prediction"):
    return regression_metrics(df, label, prediction).select("mae")


def actual_vs_predicted(df: DataFrame, label: str = "label", prediction: str = "prediction",
                        keep=()) -> DataFrame:
    """The (actual, predicted) pairs with the least-squares line of
    prediction on actual (slope and intercept from one aggregate)."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    line = df.agg(F.regr_slope(p, y).alias("slope"), F.regr_intercept(p, y).alias("intercept")).first()
    slope, icpt = line["slope"], line["intercept"]
    fitted = (F.lit(slope) * y + F.lit(icpt)) if slope is not None else F.lit(None).cast("double")
    return df.select(*keep, y.alias("actual"), p.alias("predicted"),
                     F.lit(slope).cast("double").alias("slope"), F.lit(icpt).cast("double").alias("intercept"),
                     fitted.alias("fitted"))


def feature_importance(model, feature_names, top: int = 10, spark=None):
    """Tree importances, or |coefficients| for linear models (mean
    |coefficient| across classes for a multinomial model); None when the
    model has neither.  Model parameters are small: built on the driver."""
    import numpy as np
    vals = None
    if hasattr(model, "featureImportances"):
        vals = np.asarray(model.featureImportances.toArray(), dtype=float)
    elif hasattr(model, "coefficientMatrix") and model.coefficientMatrix.numRows > 1:
        vals = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        vals = np.abs(np.asarray(model.coefficients.toArray(), dtype=float))
    if vals is None:
        return None
    pairs = sorted(zip(feature_names, vals.tolist()), key=lambda t: (-t[1], t[0]))[:top]
    spark = spark or __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    return spark.createDataFrame(pairs, "feature string, importance double")
