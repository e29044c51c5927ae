"""Align new rows to the training contract, score them, and
save / load everything scoring needs."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..operators import features as FE
from ..operators.clean import DataError
from ..operators.target import LabelMap
from .recipe import Contract, FitResult

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass
class ScoringBundle:
    task: str
    pipeline: PipelineModel
    contract: Contract
    label_map: LabelMap | None

    @staticmethod
    def from_fit(fr: FitResult, pipeline: PipelineModel) -> "ScoringBundle":
        return ScoringBundle(fr.task, pipeline, fr.contract, fr.label_map)


def align_to_schema(df: DataFrame, contract: Contract, passthrough=()) -> DataFrame:
    """Exactly the training input columns, in order.  Numbers and
    datetimes are parsed with ``try_cast`` / ``try_to_timestamp`` (bad text
    -> missing); an absent numeric column becomes 0, any other absent column
    missing (-> the missing category); strings stay strings."""
    exprs = []
    present = set(df.columns)
    for c in contract.original_columns:
        t = contract.original_types[c]
        if c not in present:
            exprs.append((F.lit(0).cast(t) if t.startswith(NUMERIC_TYPES) else F.lit(None).cast(t)).alias(c))
            continue
        col = F.col(c)
        if t.startswith(NUMERIC_TYPES) or t.startswith("decimal"):
            exprs.append(col.cast("string").try_cast(t).alias(c) if t != "boolean" else col.cast("boolean").alias(c))
        elif t.startswith("timestamp") or t == "date":
            parsed = F.try_to_timestamp(col.cast("string"))
            exprs.append((parsed.cast(t)).alias(c))
        else:
            exprs.append(col.cast(t).alias(c))
    out = df.select(*exprs, *[F.col(c) for c in passthrough if c not in contract.original_columns])
    if len(out.columns) != len(contract.original_columns) + len(
            [c for c in passthrough if c not in contract.original_columns]):
        raise DataError("Input does not have the training columns.")
    return out


def score(bundle: ScoringBundle, df: DataFrame, keep_inputs: bool = True, passthrough=()) -> DataFrame:
    """Re-apply feature engineering, run the pipeline, decode the class.
    ``passthrough`` columns (keys) are carried to the output untouched; the
    whole plan is projections, so the rows never move."""
    passthrough = [c for c in passthrough if c not in bundle.contract.original_columns]
    aligned = align_to_schema(df, bundle.contract, passthrough)
    x = FE.datetime_features(aligned, bundle.contract.datetime_columns) if bundle.contract.datetime_columns \
        else aligned
    if bundle.contract.synthetic:
        # the mean of the numeric inputs as the training table had them
        inputs = [c for c in bundle.contract.pipeline_columns if c != FE.SYNTHETIC and c in numeric_columns(x)]
        x = FE.synthetic_signal(x, None, numeric_cols=inputs)
    x = x.withColumn("_row_id", F.lit(None).cast("string"))
    out = bundle.pipeline.transform(x)
    pred = F.col("prediction")
    if bundle.task == "classification" and bundle.label_map is not None:
        pred = bundle.label_map.decode_expr("prediction")
    keep = [F.col(c) for c in passthrough] + (
        [F.col(c) for c in bundle.contract.original_columns] if keep_inputs else [])
    extra = [F.col("probability")] if "probability" in out.columns else []
    return out.select(*keep, pred.alias("prediction"), *extra)


def save_bundle(bundle: ScoringBundle, path: str) -> None:
    """The PipelineModel with the default ML writer, plus a JSON
    description of the contract and the label map (written through Spark so
    the path may be any shared file system)."""
    bundle.pipeline.write().overwrite().save(f"{path}/pipeline")
    meta = {"task": bundle.task, "contract": asdict(bundle.contract),
            "label_map": None if bundle.label_map is None else
            {"column": bundle.label_map.column, "classes": list(bundle.label_map.classes),
             "numeric": bundle.label_map.numeric, "dtype": bundle.label_map.dtype}}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_bundle(spark: SparkSession, path: str) -> ScoringBundle:
    pipeline = PipelineModel.load(f"{path}/pipeline")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    lm = meta["label_map"]
    label_map = None if lm is None else LabelMap(lm["column"], tuple(lm["classes"]), lm["numeric"], lm.get("dtype"))
    return ScoringBundle(meta["task"], pipeline, Contract(**meta["contract"]), label_map)
