"""Target analysis, label maps, ID drop, input defaults."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_datetime, is_numeric, is_string
from ..session import shared_dir
from .clean import DataError

CLASSIFICATION = "classification"
REGRESSION = "regression"


def task_stats(df: DataFrame, target: str, approx: bool = False) -> DataFrame:
    """C1 as a table: target, n, n_distinct, is_numeric, task.

    One aggregate job.  Rules in the reference's order: non-numeric ->
    classification; n_distinct > 0.2 n -> regression; n_distinct <= 10 ->
    classification; otherwise regression."""
    dt = df.schema[target].dataType
    numeric = is_numeric(dt) or isinstance(dt, T.BooleanType)
    distinct = F.approx_count_distinct(target) if approx else F.count_distinct(target)
    stats = df.agg(F.count(F.lit(1)).alias("n"), distinct.alias("n_distinct"))
    task = (F.when(F.lit(not numeric), F.lit(CLASSIFICATION))
            .when(F.col("n_distinct") > F.col("n") * 0.2, F.lit(REGRESSION))
            .when(F.col("n_distinct") <= 10, F.lit(CLASSIFICATION))
            .otherwise(F.lit(REGRESSION)))
    return stats.select(F.lit(target).alias("target"), F.col("n").cast("bigint").alias("n"),
                        F.col("n_distinct").cast("bigint").alias("n_distinct"),
                        F.lit(numeric).alias("is_numeric"), task.alias("task"))


def _n_distinct(df: DataFrame, c: str) -> int:
    return df.select(F.col(c).alias("v")).where("v IS NOT NULL").distinct().count()


def modes(df: DataFrame, cols) -> dict:
    """The most frequent value of each column (of one type), the smallest on ties; columns without values are left out.  Values
    are counted with partial sums, so no task holds more than its share of them."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cols])).alias("x")).select("x.*")
    counts = long.where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return {r["c"]: r["v"] for r in best.collect()}  # one row a column


def input_stats(df: DataFrame, target: str, id_candidates=()) -> dict:
    """C1 + C3/C4 guard + C6: rows, distinct target values, missing targets and distinct values of every ID-like
    column.  Distinct values are counted column by column: beside other aggregates they would make Spark
    repeat every row for each of them."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).isNull().cast("long")).alias("nulls")).first().asDict()
    row["nd"] = _n_distinct(df, target)
    row |= {f"id{i}": _n_distinct(df, c) for i, c in enumerate(id_candidates)}
    dt = df.schema[target].dataType
    numeric = is_numeric(dt) or isinstance(dt, T.BooleanType)
    n, nd = int(row["n"]), int(row["nd"])
    if not numeric:
        task = CLASSIFICATION
    elif nd > 0.2 * n:
        task = REGRESSION
    elif nd <= 10:
        task = CLASSIFICATION
    else:
        task = REGRESSION
    return {"n": n, "n_distinct": nd, "target_nulls": int(row["nulls"] or 0), "task": task,
            "id_unique": [c for i, c in enumerate(id_candidates) if int(row[f"id{i}"]) == n]}


def id_candidates(columns, target=None, keep=()) -> list:
    return [c for c in columns if "id" in c.lower() and c != target and c not in keep]


def infer_task_type(df: DataFrame, target: str, approx: bool = False) -> str:
    return task_stats(df, target, approx).first()["task"]


def split_features(df: DataFrame, target: str | None = None) -> tuple[str, list[str]]:
    """The target (default: the last column) and the feature list."""
    if not df.columns:
        raise DataError("The dataset has no columns.")
    target = target or df.columns[-1]
    if target not in df.columns:
        raise DataError(f"Target '{target}' is not a column.")
    return target, [c for c in df.columns if c != target]


def impute_target(df: DataFrame, target: str, how: str, approx: bool = False) -> DataFrame:
    """C3 (``how="mode"``: most frequent, smallest on ties) and C4
    (``how="median"``: exact median, or the bounded sketch with
    ``approx=True``).  The statistic is one aggregate job whose single value
    is folded into the plan as a literal."""
    if how == "mode":
        fill = modes(df, [target]).get(target)
        expr = F.coalesce(F.col(target), F.lit(fill).cast(df.schema[target].dataType))
    elif how == "median":
        from ..functions.quantiles import column_quantiles
        x = F.col(target).cast("double")
        fill = (column_quantiles(df, [target], [0.5], approx)[target] or [None])[0]
        expr = F.coalesce(x, F.lit(fill).cast("double"))
    else:
        raise ValueError("how must be 'mode' or 'median'")
    return df.select(*[expr.alias(target) if c == target else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class LabelMap:
    """Sorted distinct target values -> 0..k-1."""
    column: str
    classes: tuple  # original values in code order
    numeric: bool
    dtype: str | None = None  # the target's own type, given back by decoding

    def encode(self, df: DataFrame, out_col: str = "label", strict: bool = True) -> DataFrame:
        keys = list(self.classes)
        m = F.create_map(*[x for i, v in enumerate(keys) for x in (F.lit(v), F.lit(float(i)))])
        src = F.col(self.column)
        if self.numeric:
            src = src.cast("double")
        code = F.element_at(m, src) if keys else F.lit(None).cast("double")
        if strict:
            code = F.when(src.isNull(), F.lit(None).cast("double")).otherwise(
                F.coalesce(code, F.raise_error(F.concat(
                    F.lit(f"Unseen class in '{self.column}': "), src.cast("string")))))
        return df.withColumn(out_col, code.cast("double"))

    def decode_expr(self, code_col: str):
        arr = F.array(*[F.lit(v) for v in self.classes])
        value = F.element_at(arr, F.col(code_col).cast("int") + 1)
        return value.cast(self.dtype) if self.dtype else value


def fit_label_map(df: DataFrame, target: str) -> LabelMap:
    """Distinct values sorted as numbers for numeric targets (booleans as
    0/1) and as text otherwise.  The driver holds the list of classes, as a model
    for them does."""
    dt = df.schema[target].dataType
    numeric = is_numeric(dt) or isinstance(dt, T.BooleanType)
    col = F.col(target).cast("double") if numeric else F.col(target).cast("string")
    distinct = df.select(col.alias("v")).where(F.col("v").isNotNull()).distinct()
    return LabelMap(target, tuple(sorted(r["v"] for r in distinct.collect())), numeric, dt.simpleString())


def sorted_places(values: DataFrame, col: str, out_col: str) -> DataFrame:
    """Distinct ``values`` with their place in order (0 on).  Ranges of values are sorted in tasks of their own
    and written; a place is that in its range after the sizes of the ranges before (one row a range)."""
    from pyspark.sql import Window
    spark = values.sparkSession
    path = shared_dir(spark, f"sorted-places-{uuid.uuid4().hex}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = values.repartitionByRange(parts, col).sortWithinPartitions(col).select(
        col, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").select(col, (F.col("_start") + F.col("_at")).alias(out_col))


def encode_label_table(df: DataFrame, target: str, out_col: str = "label") -> DataFrame:
    """C5 as a table: the class code (0..k-1, classes sorted as numbers or as
    text) next to every row.  The class table is joined, so any number of classes will do;
    a missing target has no code."""
    dt = df.schema[target].dataType
    numeric = is_numeric(dt) or isinstance(dt, T.BooleanType)
    value = F.col(target).cast("double") if numeric else F.col(target).cast("string")
    classes = df.select(value.alias("_class")).where("_class IS NOT NULL").distinct()
    codes = sorted_places(classes, "_class", out_col)
    return df.withColumn("_class", value).join(codes, "_class", "left").select(*df.columns, out_col)


def drop_id_columns(df: DataFrame, target: str | None = None, keep=()) -> tuple[DataFrame, list[str]]:
    """Drop a feature whose lowercase name contains 'id' and whose values
    are all distinct and non-null.  One aggregate over the matching columns."""
    cands = [c for c in df.columns if "id" in c.lower() and c != target and c not in keep]
    if not cands:
        return df, []
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_distinct(F.col(c)).alias(c) for c in cands]).first()
    dropped = [c for c in cands if row[c] == row["_n"]]
    return df.drop(*dropped), dropped


def id_column_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """C6 as a table: column, n_distinct, n_rows, dropped."""
    cands = [c for c in df.columns if "id" in c.lower() and c != target]
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint, n_rows bigint, dropped boolean")
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_distinct(F.col(c)).alias(f"{c}__d") for c in cands])
    parts = ", ".join(f"'{c}', `{c}__d`" for c in cands)
    long = wide.selectExpr("_n", f"stack({len(cands)}, {parts}) as (column, n_distinct)")
    return long.select("column", F.col("n_distinct").cast("bigint").alias("n_distinct"),
                       F.col("_n").cast("bigint").alias("n_rows"),
                       (F.col("n_distinct") == F.col("_n")).alias("dropped"))


def require_features(df: DataFrame, target: str) -> list[str]:
    """Stop when no columns or no features are left."""
    if not df.columns:
        raise DataError("The dataset has no columns.")
    feats = [c for c in df.columns if c != target]
    if not feats:
        raise DataError("No features left after dropping the target and ID columns.")
    return feats


def infer_input_defaults(df: DataFrame, cols=None) -> DataFrame:
    """Column, default (as text): numeric median (0.0 when all null),
    string mode (smallest on ties), earliest datetime, else ''."""
    from ..functions.quantiles import column_quantiles
    cols = cols or df.columns
    aggs, kinds = [], {}
    nums = [c for c in cols if is_numeric(df.schema[c].dataType) or isinstance(df.schema[c].dataType, T.BooleanType)]
    medians = column_quantiles(df, nums, [0.5]) if nums else {}
    texts = [c for c in cols if c not in nums and is_string(df.schema[c].dataType)]
    common = modes(df, texts) if texts else {}
    for c in cols:
        dt = df.schema[c].dataType
        if is_numeric(dt) or isinstance(dt, T.BooleanType):
            kinds[c] = "num"
            med = (medians.get(c) or [None])[0]
            aggs.append(F.lit(0.0 if med is None else float(med)).cast("string").alias(c))
        elif is_string(dt):
            kinds[c] = "str"
            aggs.append(F.lit(common.get(c, "")).alias(c))
        elif is_datetime(dt):
            kinds[c] = "dt"
            aggs.append(F.coalesce(F.min(F.col(c)).cast("string"), F.lit("")).alias(c))
        else:
            kinds[c] = "other"
            aggs.append(F.lit("").alias(c))
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', '{kinds[c]}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {parts}) as (column, kind, default)")
