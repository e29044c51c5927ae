"""Exact k-nearest neighbours, as classifier, regressor and imputer.

The search (``cells``) deals the reference rows into cells around pivots and reads, for each query, only
the cells whose lower bound does not exceed the distance of the k-th neighbour found so far.
"""

from __future__ import annotations

import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .cells import nearest

BLOCK_ROWS = 2048


def _p(name, doc, conv):
    return Param(Params._dummy(), name, doc, typeConverter=conv)


class _RowsWriter(DefaultParamsWriter):
    """Saves the parameters and a copy of the training rows, so the saved model stands alone."""

    def saveImpl(self, path):
        super().saveImpl(path)
        rows = self.instance.getOrDefault(self.instance.rowsParam)
        self.sparkSession.read.parquet(rows).write.parquet(f"{path}/rows")


class _RowsReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        model._set(**{model.rowsParam: f"{path}/rows"})
        return model


class _RowsModel(DefaultParamsReadable, DefaultParamsWritable):
    """A model whose training rows are a table named by the parameter ``rowsParam``."""
    rowsParam = None

    def write(self):
        return _RowsWriter(self)

    @classmethod
    def read(cls):
        return _RowsReader(cls)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number ``_qid``, written to the shared folder: the numbers are data from
    then on, and no recomputation can deal them out anew."""
    spark = df.sparkSession
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    numbered = df.withColumn("_qid", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)


# ---------------------------------------------------------------- E6 / E13

def knn_candidates(queries: DataFrame, refs: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
                   n_q: int | None = None, n_r: int | None = None, counted: dict | None = None) -> DataFrame:
    """queries: (_qid, _vec array); refs: (_rid, _vec array, _y).  Returns the
    exact k nearest (_qid, _rid, _dist, _y, _rank) by (distance, _rid)."""
    n_r = n_r if n_r is not None else refs.count()
    found = nearest(queries, refs, k, n_r, block_rows, counted=counted)
    return found.select("_qid", "_rid", "_dist", F.col("_v").alias("_y"), "_rank")


def knn_predict(cands: DataFrame, task: str) -> DataFrame:
    """Majority vote (smallest class on ties) or mean of the neighbours."""
    if task == "classification":
        votes = cands.groupBy("_qid", "_y").agg(F.count(F.lit(1)).alias("_n"))
        return votes.groupBy("_qid").agg(
            F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("_pred"))
    return cands.groupBy("_qid").agg(F.avg("_y").alias("_pred"))


class KNeighbors(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable,
                 DefaultParamsWritable):
    """Exact KNN classifier or regressor (uniform weights)."""
    k = _p("k", "number of neighbours", TypeConverters.toInt)
    task = _p("task", "classification or regression", TypeConverters.toString)
    blockRows = _p("blockRows", "rows per block", TypeConverters.toInt)

    @keyword_only
    def __init__(self, k=5, task="classification", featuresCol="features", labelCol="label",
                 predictionCol="prediction", blockRows=BLOCK_ROWS):
        super().__init__()
        self._setDefault(k=5, task="classification", blockRows=BLOCK_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        spark = df.sparkSession
        path = shared_dir(spark, f"knn-train-{uuid.uuid4().hex}")
        (df.select(F.monotonically_increasing_id().alias("_rid"),
                   vector_to_array(self.getFeaturesCol()).alias("_vec"),
                   F.col(self.getLabelCol()).cast("double").alias("_y"))
         .write.mode("overwrite").parquet(path))
        n = spark.read.parquet(path).count()
        return KNeighborsModel(k=self.getOrDefault(self.k), task=self.getOrDefault(self.task),
                               featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                               predictionCol=self.getPredictionCol(), trainPath=path, nTrain=n,
                               blockRows=self.getOrDefault(self.blockRows))


class KNeighborsModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, _RowsModel):
    rowsParam = "trainPath"
    k = _p("k", "number of neighbours", TypeConverters.toInt)
    task = _p("task", "classification or regression", TypeConverters.toString)
    trainPath = _p("trainPath", "training rows written in the shared folder", TypeConverters.toString)
    nTrain = _p("nTrain", "training rows", TypeConverters.toInt)
    blockRows = _p("blockRows", "rows per block", TypeConverters.toInt)

    @keyword_only
    def __init__(self, k=5, task="classification", featuresCol="features", labelCol="label",
                 predictionCol="prediction", trainPath=None, nTrain=0, blockRows=BLOCK_ROWS):
        super().__init__()
        self._setDefault(k=5, task="classification", nTrain=0, blockRows=BLOCK_ROWS)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        keyed = _numbered(df, "knn-queries")
        q = keyed.select("_qid", vector_to_array(self.getFeaturesCol()).alias("_vec"))
        refs = spark.read.parquet(self.getOrDefault(self.trainPath))
        cands = knn_candidates(q, refs, self.getOrDefault(self.k), self.getOrDefault(self.blockRows),
                               n_r=self.getOrDefault(self.nTrain))
        pred = knn_predict(cands, self.getOrDefault(self.task))
        out = keyed.join(pred, "_qid", "left").withColumnRenamed("_pred", self.getPredictionCol()).drop("_qid")
        return out


# ---------------------------------------------------------------------- D3

class KnnImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """D3: each missing value becomes the mean of that column over the k
    nearest training rows that have it, by the missing-aware Euclidean
    distance sqrt(d / common * sum over common coordinates).  No valid donor
    -> the column's training mean.  Rows without a missing value pass
    through untouched (no join, no Python)."""
    k = _p("k", "number of neighbours", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, k=3):
        super().__init__()
        self._setDefault(k=3)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        spark = df.sparkSession
        cols = self.getInputCols()
        path = shared_dir(spark, f"knn-impute-{uuid.uuid4().hex}")
        vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
        df.select(F.monotonically_increasing_id().alias("_rid"), vec.alias("_vec")).write.mode("overwrite").parquet(path)
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        n = spark.read.parquet(path).count()
        return KnnImputerModel(inputCols=cols, k=self.getOrDefault(self.k), donorPath=path, nDonors=n,
                               means=[float(means[c]) if means[c] is not None else 0.0 for c in cols])


class KnnImputerModel(Model, HasInputCols, _RowsModel):
    rowsParam = "donorPath"
    k = _p("k", "number of neighbours", TypeConverters.toInt)
    donorPath = _p("donorPath", "training rows written in the shared folder", TypeConverters.toString)
    nDonors = _p("nDonors", "training rows", TypeConverters.toInt)
    means = _p("means", "fallback per column", TypeConverters.toListFloat)
    blockRows = _p("blockRows", "rows per block", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, k=3, donorPath=None, nDonors=0, means=None, blockRows=BLOCK_ROWS):
        super().__init__()
        self._setDefault(k=3, nDonors=0, blockRows=BLOCK_ROWS)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        cols = self.getInputCols()
        any_null = F.lit(False)
        for c in cols:
            any_null = any_null | F.col(c).isNull()
        # a condition on the row's number is not pushed down, so that no column is computed for the condition and once more for the row
        rows = df.withColumn("_at", F.monotonically_increasing_id())
        complete = rows.where(~any_null & (F.col("_at") >= 0)).drop("_at")
        recv = _numbered(rows.where(any_null & (F.col("_at") >= 0)).drop("_at"), "knn-gaps")
        if recv.isEmpty():
            return df.withColumns({c: F.col(c).cast("double") for c in cols})
        vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
        q = recv.select("_qid", vec.alias("_vec"))
        refs = spark.read.parquet(self.getOrDefault(self.donorPath))
        k = self.getOrDefault(self.k)
        best = nearest(q, refs.withColumn("_y", F.lit(0.0)), k, self.getOrDefault(self.nDonors), self.getOrDefault(self.blockRows), values=True)
        # one averaged value per missing column: each row's map has <= d entries
        per = best.groupBy("_qid", "_j").agg(F.avg("_v").alias("_v"))
        filled = per.groupBy("_qid").agg(F.map_from_entries(F.collect_list(F.struct("_j", "_v"))).alias("_m"))
        means = self.getOrDefault(self.means)
        joined = recv.join(filled, "_qid", "left")
        fixed = joined.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.element_at(F.col("_m"), F.lit(j)), F.lit(means[j]))
            for j, c in enumerate(cols)}).drop("_qid", "_m")
        return complete.withColumns({c: F.col(c).cast("double") for c in cols}).unionByName(fixed)
