"""RBF-kernel SVC and SVR via random Fourier features.

The RBF kernel exp(-gamma |x - y|^2) is approximated by
z(x) = sqrt(2 / D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi)
(Rahimi and Recht, 2007), so the kernel machine becomes a linear one on z:

* SVC: ``LinearSVC`` on z, penalty regParam = 1 / (C n); probabilities by
  Platt scaling (a logistic fit on the margin).  3+ classes: calibrated and
  coupled pairs (``pairwise``).
* SVR: squared epsilon-insensitive loss on z, solved by an active-set Newton
  iteration; each step is ONE distributed pass that sums Z'Z and Z't over the
  active rows (D x D partial sums per task), and the D x D solve happens on
  the driver.

z is computed in Arrow batches with NumPy (one matrix product per batch).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairwise import fit_pairs

RFF_COL = "_rff"
N_COMPONENTS = 256


def _p(name, doc, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


def resolve_gamma(df: DataFrame, features_col: str, gamma) -> tuple[float, int]:
    """'scale' -> 1 / (d Var(X)) over all entries; 'auto' -> 1 / d."""
    arr = vector_to_array(features_col)
    st = df.select(arr.alias("x")).select(F.explode("x").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("var")).first()
    d = len(df.select(features_col).first()[0])
    if gamma == "scale":
        var = st["var"] or 0.0
        return (1.0 / (d * var) if var > 0 else 1.0), d
    if gamma == "auto":
        return 1.0 / d, d
    return float(gamma), d


class RandomFourierFeatures(Transformer, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    weights = _p("weights", "row-major D x d frequencies", TypeConverters.toListFloat)
    offsets = _p("offsets", "D phases", TypeConverters.toListFloat)
    outputCol = _p("outputCol", "output vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", weights=None, offsets=None, outputCol=RFF_COL):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def draw(d: int, gamma: float, n_components: int, seed: int, features_col: str, output_col: str = RFF_COL):
        rng = np.random.default_rng(seed)
        W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, d))
        b = rng.uniform(0.0, 2.0 * np.pi, size=n_components)
        return RandomFourierFeatures(featuresCol=features_col, weights=W.ravel().tolist(),
                                     offsets=b.tolist(), outputCol=output_col)

    def size(self) -> int:
        return len(self.getOrDefault(self.offsets))

    def lift(self):
        """A function from rows of features to rows of z."""
        b = np.asarray(self.getOrDefault(self.offsets))
        W = np.asarray(self.getOrDefault(self.weights)).reshape(b.size, -1)
        scale = np.sqrt(2.0 / b.size)
        return lambda X: scale * np.cos(X @ W.T + b)

    def _transform(self, df: DataFrame) -> DataFrame:
        raised = self.lift()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(xs: pd.Series) -> pd.Series:
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            return pd.Series(list(raised(np.stack([np.asarray(v, dtype=float) for v in xs]))))

        return df.withColumn(self.getOrDefault(self.outputCol),
                             array_to_vector(rff(vector_to_array(self.getFeaturesCol()))))


class PlattScaling(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """probability = sigmoid(a * margin + c) for binary margins."""
    a = _p("a", "slope", TypeConverters.toFloat)
    c = _p("c", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, a=1.0, c=0.0):
        super().__init__()
        self._setDefault(a=1.0, c=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df):
        m = vector_to_array("rawPrediction")[1]
        p = 1.0 / (1.0 + F.exp(-(F.lit(self.getOrDefault(self.a)) * m + F.lit(self.getOrDefault(self.c)))))
        return df.withColumn("probability", array_to_vector(F.array(1.0 - p, p)))


class _RbfParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    C = _p("C", "inverse penalty", TypeConverters.toFloat)
    gamma = _p("gamma", "'scale', 'auto' or a number", TypeConverters.toString)
    nComponents = _p("nComponents", "random features", TypeConverters.toInt)


class RbfSVC(Estimator, _RbfParams, DefaultParamsReadable, DefaultParamsWritable):
    nClasses = _p("nClasses", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, C=1.0, gamma="scale", nComponents=N_COMPONENTS, nClasses=2, seed=42,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(C=1.0, gamma="scale", nComponents=N_COMPONENTS, nClasses=2, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        gamma, d = resolve_gamma(df, fc, self.getOrDefault(self.gamma))
        rff = RandomFourierFeatures.draw(d, gamma, self.getOrDefault(self.nComponents), self.getSeed(), fc)
        if self.getOrDefault(self.nClasses) > 2:
            return PipelineModel(stages=[rff, fit_pairs(df, fc, lc, rff, self.getOrDefault(self.nClasses),
                                                        self.getOrDefault(self.C), self.getPredictionCol())])
        z = rff.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
        n = z.count()
        svc = LinearSVC(featuresCol=RFF_COL, labelCol=lc, regParam=1.0 / (self.getOrDefault(self.C) * n),
                        standardization=False, maxIter=100)
        fitted = svc.fit(z)
        margins = fitted.transform(z).select(vector_to_array("rawPrediction")[1].alias("m"), F.col(lc))
        from pyspark.ml.feature import VectorAssembler
        platt_in = VectorAssembler(inputCols=["m"], outputCol="_m").transform(margins)
        lr = LogisticRegression(featuresCol="_m", labelCol=lc, regParam=0.0).fit(platt_in)
        platt = PlattScaling(a=float(lr.coefficients[0]), c=float(lr.intercept))
        z.unpersist()
        return PipelineModel(stages=[rff, fitted, platt])


class LinearOnArray(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """prediction = z . w + intercept (z from RandomFourierFeatures)."""
    coefficients = _p("coefficients", "weights", TypeConverters.toListFloat)
    intercept = _p("intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, coefficients=None, intercept=0.0, predictionCol="prediction"):
        super().__init__()
        self._setDefault(intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df):
        w = np.asarray(self.getOrDefault(self.coefficients))
        c = self.getOrDefault(self.intercept)

        @F.pandas_udf(T.DoubleType())
        def dot(zs: pd.Series) -> pd.Series:
            if len(zs) == 0:
                return pd.Series([], dtype=float)
            return pd.Series(np.stack([np.asarray(v, dtype=float) for v in zs]) @ w + c)

        return df.withColumn(self.getPredictionCol(), dot(vector_to_array(RFF_COL)))


class RbfSVR(Estimator, _RbfParams, DefaultParamsReadable, DefaultParamsWritable):
    epsilon = _p("epsilon", "insensitive tube half-width", TypeConverters.toFloat)
    maxIter = _p("maxIter", "Newton steps", TypeConverters.toInt)

    @keyword_only
    def __init__(self, C=1.0, gamma="scale", epsilon=0.1, nComponents=N_COMPONENTS, seed=42, maxIter=20,
                 featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(C=1.0, gamma="scale", epsilon=0.1, nComponents=N_COMPONENTS, maxIter=20, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        gamma, d = resolve_gamma(df, fc, self.getOrDefault(self.gamma))
        D = self.getOrDefault(self.nComponents)
        rff = RandomFourierFeatures.draw(d, gamma, D, self.getSeed(), fc)
        z = (rff.transform(df).select(vector_to_array(RFF_COL).alias("z"), F.col(lc).cast("double").alias("y"))
             .persist(StorageLevel.MEMORY_AND_DISK))
        eps, lam = self.getOrDefault(self.epsilon), 1.0 / (2.0 * self.getOrDefault(self.C))
        w = np.zeros(D + 1)  # last entry: intercept (not penalised)
        penalty = np.eye(D + 1) * lam
        penalty[D, D] = 0.0
        size = (D + 1) * (D + 2) + 1  # Gram matrix, right side, active rows
        active_prev = None
        for _ in range(self.getOrDefault(self.maxIter)):
            w_now = w.copy()

            def partial(batches, w_now=w_now):
                total = np.zeros(size)
                G = total[:(D + 1) ** 2].reshape(D + 1, D + 1)
                h = total[(D + 1) ** 2:-1]
                for pdf in batches:
                    if pdf.empty:
                        continue
                    Z = np.column_stack([np.stack([np.asarray(v, dtype=float) for v in pdf["z"]]),
                                         np.ones(len(pdf))])
                    y = pdf["y"].to_numpy(dtype=float)
                    r = y - Z @ w_now
                    act = np.abs(r) > eps
                    Za = Z[act]
                    G += Za.T @ Za
                    h += Za.T @ (y[act] - np.sign(r[act]) * eps)
                    total[-1] += int(act.sum())
                yield pd.DataFrame({"sums": [total.tobytes()]})

            def merged(batches):
                total = np.zeros(size)
                for pdf in batches:
                    for blob in pdf["sums"]:
                        total += np.frombuffer(blob)
                yield pd.DataFrame({"sums": [total.tobytes()]})

            # one array per task, summed in two levels
            level = z.mapInPandas(partial, "sums binary")
            level = level.repartition(max(1, int(z.rdd.getNumPartitions() ** 0.5))).mapInPandas(merged, "sums binary")
            sums = np.frombuffer(level.repartition(1).mapInPandas(merged, "sums binary").first()[0])
            G = sums[:(D + 1) ** 2].reshape(D + 1, D + 1)
            h = sums[(D + 1) ** 2:-1]
            n_act = float(sums[-1])
            w_new = np.linalg.solve(G + penalty + 1e-10 * np.eye(D + 1), h)
            done = np.allclose(w_new, w, rtol=1e-6, atol=1e-9) or (active_prev == n_act and n_act == 0)
            w = w_new
            active_prev = n_act
            if done:
                break
        z.unpersist()
        head = LinearOnArray(coefficients=w[:D].tolist(), intercept=float(w[D]),
                             predictionCol=self.getPredictionCol())
        return PipelineModel(stages=[rff, head])
