"""Custom ``pyspark.ml`` stages for the feature pipeline.

Each fitted stage keeps its statistics as JSON-able Params, so a
PipelineModel holding them saves and loads with the default ML writers, and
its ``transform`` is a plain projection (column expressions, whole-stage
codegen, no Python at scoring time).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE


def _p(name, doc, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


class _Base(Params, DefaultParamsReadable, DefaultParamsWritable):
    pass


class ColumnMeanImputer(Estimator, HasInputCols, _Base):
    """Mean fill for numeric columns (the scalable alternative to KNN)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        return ColumnMeanImputerModel(inputCols=cols, fills=[float(row[c] or 0.0) for c in cols])


class ColumnMeanImputerModel(Model, HasInputCols, _Base):
    fills = _p("fills", "fill value per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        cols, fills = self.getInputCols(), self.getOrDefault(self.fills)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(cols, fills)})


class PolynomialTerms(Transformer, HasInputCols, _Base):
    """Degree-2 terms without bias, replacing the input columns."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def outputNames(self):
        return [n for n, _ in FE.polynomial_names(self.getInputCols())]

    def _transform(self, df):
        cols = self.getInputCols()
        terms = FE.polynomial_names(cols)
        rest = [F.col(c) for c in df.columns if c not in cols]
        return df.select(*rest, *[e.cast("double").alias(n) for n, e in terms])


class StandardScale(Estimator, HasInputCols, _Base):
    """(x - mean) / population std; a constant column becomes 0."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        stats = FE.scaling_stats(df, self.getInputCols())
        cols = self.getInputCols()
        return StandardScaleModel(inputCols=cols, means=[float(stats[c][0] or 0.0) for c in cols],
                                  stds=[float(stats[c][1] or 0.0) for c in cols])


class StandardScaleModel(Model, HasInputCols, _Base):
    means = _p("means", "column means", TypeConverters.toListFloat)
    stds = _p("stds", "population standard deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        stats = dict(zip(self.getInputCols(), zip(self.getOrDefault(self.means), self.getOrDefault(self.stds))))
        return df.withColumns(FE.scale_exprs(stats))


class SelectKBest(Estimator, HasInputCols, HasLabelCol, _Base):
    """Keep the k numeric columns with the highest F score."""
    k = _p("k", "number of columns kept", TypeConverters.toInt)
    task = _p("task", "classification or regression", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", k=10, task="classification"):
        super().__init__()
        self._setDefault(k=10, task="classification")
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getInputCols()
        keep, _ = FE.select_k_best(df, cols, self.getLabelCol(), self.getOrDefault(self.task),
                                   self.getOrDefault(self.k))
        return ColumnSubset(inputCols=cols, keepCols=keep)


class ColumnSubset(Model, HasInputCols, _Base):
    keepCols = _p("keepCols", "columns kept", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, keepCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        keep = set(self.getOrDefault(self.keepCols))
        return df.drop(*[c for c in self.getInputCols() if c not in keep])


class CenteredPCA(Estimator, HasInputCols, _Base):
    """Centred principal components of the numeric block."""
    k = _p("k", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, k=5):
        super().__init__()
        self._setDefault(k=5)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cols = self.getInputCols()
        means, comps, var = FE.fit_pca(df, cols, self.getOrDefault(self.k))
        return CenteredPCAModel(inputCols=cols, means=means, components=[float(x) for row in comps for x in row],
                                explainedVariance=[float(v) for v in var])


class CenteredPCAModel(Model, HasInputCols, _Base):
    means = _p("means", "column means", TypeConverters.toListFloat)
    components = _p("components", "row-major k x d loadings", TypeConverters.toListFloat)
    explainedVariance = _p("explainedVariance", "variance per component", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, components=None, explainedVariance=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def outputNames(self):
        return [f"pca{i}" for i in range(len(self.getOrDefault(self.explainedVariance)))]

    def _transform(self, df):
        cols = self.getInputCols()
        d = len(cols)
        flat = self.getOrDefault(self.components)
        comps = [flat[i * d:(i + 1) * d] for i in range(len(flat) // d)]
        exprs = FE.pca_exprs(cols, self.getOrDefault(self.means), comps)
        return df.select(*[c for c in df.columns if c not in cols], *[e.alias(n) for n, e in exprs.items()])


class FillCategorical(Transformer, HasInputCols, _Base):
    """Missing category -> its own value (``__missing__``) before indexing;
    the same sentinel is used at scoring time."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(FE.MISSING))
                               for c in self.getInputCols()})


class CastToDouble(Transformer, HasInputCols, _Base):
    """Booleans and other pass-through columns become doubles."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df):
        return df.withColumns({c: F.col(c).cast("double") for c in self.getInputCols()})
