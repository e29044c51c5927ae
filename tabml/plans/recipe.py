"""The recipe, the feature pipeline and ``prepare``.

``prepare`` runs the reference's sequence on a DataFrame and returns a
``FitResult`` with cached, transformed train/test tables.  Every step is a
Spark job over the whole table; the driver only sees aggregates (counts,
class lists, fitted statistics).
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column_roles, nan_to_null, sanitize_names
from ..functions.hashing import row_key
from ..operators import features as FE
from ..operators import rows as RW
from ..operators import target as TG
from ..operators.clean import DataError
from . import stages as ST

KEY = "_row_id"
LABEL = "label"
FEATURES = "features"


@dataclass(frozen=True)
class Recipe:
    """Which steps run.  ``auto()`` is the reference's auto mode."""
    impute: str | None = "knn"          # "knn" (reference), "mean", or None
    scale: bool = True
    one_hot: bool = True
    datetime: bool = True
    poly: bool = False
    outliers: bool = True
    select: bool = True
    pca: bool = False
    balance: bool = True
    synthetic: bool = False
    resample: str = "after_split"      # "before_split" reproduces the reference
    test_size: float = 0.3
    seed: int = 42
    knn_k: int = 3

    @staticmethod
    def auto() -> "Recipe":
        return Recipe()

    @staticmethod
    def manual(**flags) -> "Recipe":
        base = Recipe(impute=None, scale=False, one_hot=True, datetime=True, poly=False, outliers=False,
                      select=False, pca=False, balance=False)
        return replace(base, **flags)


@dataclass
class Contract:
    """What scoring needs to rebuild the training input."""
    target: str
    dropped_ids: list
    original_columns: list          # columns offered as inputs (not target, not IDs)
    original_types: dict            # column -> simpleString
    datetime_columns: list
    pipeline_columns: list          # columns at pipeline entry, in order
    synthetic: bool = False


@dataclass
class FitResult:
    task: str
    target: str
    recipe: Recipe
    contract: Contract
    label_map: TG.LabelMap | None
    feature_model: PipelineModel
    feature_names: list
    numeric: list
    categorical: list
    train: DataFrame
    test: DataFrame
    raw_train: DataFrame
    raw_test: DataFrame
    split_train: DataFrame      # the training part before outliers and balancing (folds are cut here)
    other: list
    n_train: int
    label_std: float
    n_classes: int
    report: dict = field(default_factory=dict)

    def context(self):
        from .models import FitContext
        return FitContext(n_rows=self.n_train, label_std=self.label_std, n_classes=self.n_classes,
                          seed=self.recipe.seed)


def build_feature_pipeline(train: DataFrame, numeric: list, categorical: list, other: list, recipe: Recipe,
                           task: str, label: str = LABEL):
    """``fit_features`` without the transformed training part."""
    return fit_features(train, numeric, categorical, other, recipe, task, label)[:3]


def fit_features(train: DataFrame, numeric: list, categorical: list, other: list, recipe: Recipe,
                 task: str, label: str = LABEL):
    """Fit the numeric steps in order impute -> poly -> scale -> select
    -> PCA, one-hot for categoricals, pass the rest through, assemble.
    Returns (PipelineModel, feature_names, numeric columns, ``train`` through all stages)."""
    fitted = []
    df = train
    num = list(numeric)
    n_original_numeric = len(numeric)

    def apply(stage):
        nonlocal df
        fitted.append(stage)
        df = stage.transform(df)

    if num and recipe.impute == "knn":
        from ..operators.neighbors import KnnImputer
        apply(KnnImputer(inputCols=num, k=recipe.knn_k).fit(df))
    elif num and recipe.impute == "mean":
        apply(ST.ColumnMeanImputer(inputCols=num).fit(df))
    if num and recipe.poly:
        poly = ST.PolynomialTerms(inputCols=num)
        apply(poly)
        num = poly.outputNames()
    if num and recipe.scale:
        apply(ST.StandardScale(inputCols=num).fit(df))
    if num and recipe.select:
        k = min(n_original_numeric, 10)
        sel = ST.SelectKBest(inputCols=num, labelCol=label, k=k, task=task).fit(df)
        apply(sel)
        kept = set(sel.getOrDefault(sel.keepCols))
        num = [c for c in num if c in kept]
    if recipe.pca and n_original_numeric > 1 and len(num) > 1:
        k = min(n_original_numeric - 1, 5, len(num))
        pca = ST.CenteredPCA(inputCols=num, k=k).fit(df)
        apply(pca)
        num = pca.outputNames()
    assembled = list(num)
    if categorical and recipe.one_hot:
        apply(ST.FillCategorical(inputCols=categorical))
        idx_cols = [f"{c}__idx" for c in categorical]
        ohe_cols = [f"{c}__ohe" for c in categorical]
        indexer = StringIndexer(inputCols=categorical, outputCols=idx_cols, stringOrderType="alphabetAsc",
                                handleInvalid="keep").fit(df)
        apply(indexer)
        # the indexer puts unseen values at index n (its "keep" bucket); the
        # encoder sees n + 1 values and dropLast removes slot n, so an unseen
        # value is all zeros and every seen category has one slot
        apply(OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True, handleInvalid="error").fit(df))
        assembled += ohe_cols
    elif categorical:
        # no one-hot: the reference passes them through; a string cannot be a
        # model input, so it is indexed (order by name) instead
        idx_cols = [f"{c}__idx" for c in categorical]
        apply(ST.FillCategorical(inputCols=categorical))
        apply(StringIndexer(inputCols=categorical, outputCols=idx_cols, stringOrderType="alphabetAsc",
                            handleInvalid="keep").fit(df))
        assembled += idx_cols
    if other:
        apply(ST.CastToDouble(inputCols=other))
        assembled += other
    if not assembled:
        raise DataError("No features left for the model.")
    apply(VectorAssembler(inputCols=assembled, outputCol=FEATURES, handleInvalid="error"))
    return PipelineModel(stages=fitted), sanitize_names(vector_names(df.schema[FEATURES])), num, df


def vector_names(field) -> list:
    """Slot names of an assembled vector from its ML attribute metadata."""
    attrs = field.metadata.get("ml_attr", {}).get("attrs", {})
    pairs = sorted((a["idx"], a.get("name", f"feature_{a['idx']}")) for group in attrs.values() for a in group)
    size = field.metadata.get("ml_attr", {}).get("num_attrs", len(pairs))
    names = {i: n for i, n in pairs}
    out = []
    for i in range(size):
        n = names.get(i, f"feature_{i}")
        out.append(n.replace("__ohe_", "_").replace("__idx", ""))
    return out


def resample_part(part: DataFrame, recipe: Recipe, numeric: list, binary: bool, report: dict | None = None) -> DataFrame:
    """D14 and D15 on a training part."""
    report = {} if report is None else report
    if recipe.outliers and numeric:
        from ..operators.outliers import remove_outliers
        with _timed(report, "outliers"):
            part, n_out = remove_outliers(part, numeric, key=KEY, contamination=0.05, seed=recipe.seed)
        report["outliers_removed"] = n_out
    if recipe.balance and binary:
        with _timed(report, "upsample"):
            part, applied = RW.upsample_minority(part, LABEL, KEY, seed=recipe.seed)
        report["upsampled"] = applied
    return part


@contextmanager
def _timed(report: dict, step: str):
    t0 = time.time()
    yield
    report.setdefault("seconds", {})[step] = round(time.time() - t0, 3)


def prepare(df: DataFrame, target: str | None = None, recipe: Recipe | None = None,
            key=None, task: str | None = None) -> FitResult:
    """C1 -> C3/4 -> C5 -> C6 -> D1 -> D2 -> C8 -> D14 -> D15 -> D16 ->
    C5 -> D10 -> D12 -> D13."""
    from ..operators.clean import require_min_rows
    recipe = recipe or Recipe.auto()
    df = nan_to_null(df)
    target, _ = TG.split_features(df, target)
    require_min_rows(df, 10)                                     # A11
    report: dict = {}
    # explicit row key; the input is cached now, so the one statistics job
    # below is the only full read of the source
    df = row_key(df, key, KEY).persist(StorageLevel.MEMORY_AND_DISK)
    source = df
    cands = TG.id_candidates([c for c in df.columns if c not in (target, KEY)], target)
    with _timed(report, "input_stats"):
        st = TG.input_stats(df, target, cands)
    task = task or st["task"]
    report["task"] = task
    # Fill a missing target
    if st["target_nulls"]:
        df = TG.impute_target(df, target, "mode" if task == TG.CLASSIFICATION else "median")
    # Drop ID-like features whose values are all distinct (non-null)
    dropped = st["id_unique"]
    feats = TG.require_features(df.drop(KEY, *dropped), target)
    originals = [c for c in feats]
    report["dropped_ids"] = dropped
    types = {c: df.schema[c].dataType.simpleString() for c in originals}
    df = df.select(KEY, *originals, target)
    # Label (first map, on all rows)
    if task == TG.CLASSIFICATION:
        with _timed(report, "label_map"):
            lm = TG.fit_label_map(df, target)
        df = lm.encode(df, LABEL)
    else:
        lm = None
        df = df.withColumn(LABEL, F.col(target).cast("double"))
    df = df.drop(target)
    # D1 datetime parts
    dt_cols = column_roles(df, exclude=(KEY, LABEL))["datetime"] if recipe.datetime else []
    if dt_cols:
        df = FE.datetime_features(df, dt_cols)
    elif column_roles(df, exclude=(KEY, LABEL))["datetime"]:
        raise DataError("Datetime columns need datetime extraction (recipe.datetime=True).")
    if recipe.synthetic:
        df = FE.synthetic_signal(df, LABEL, seed=recipe.seed)
    roles = column_roles(df, exclude=(KEY, LABEL))
    numeric, categorical = roles["numeric"], roles["categorical"]
    other = [c for c in roles["other"]
             if isinstance(df.schema[c].dataType, T.BooleanType)]
    skipped = [c for c in roles["other"] if c not in other]
    if skipped:
        df = df.drop(*skipped)
        report["skipped_columns"] = skipped
    pipeline_cols = [c for c in df.columns if c not in (KEY, LABEL)]
    contract = Contract(target=target, dropped_ids=dropped, original_columns=originals, original_types=types,
                        datetime_columns=dt_cols, pipeline_columns=pipeline_cols, synthetic=recipe.synthetic)
    n_rows = st["n"]
    parts = RW.partitions_for(n_rows, least=df.sparkSession.sparkContext.defaultParallelism)
    report["n_rows"] = n_rows
    binary = task == TG.CLASSIFICATION and len(lm.classes) == 2

    def resample(part: DataFrame) -> DataFrame:
        return resample_part(part, recipe, numeric, binary, report)

    if recipe.resample == "before_split":
        df = resample(df)
    with _timed(report, "split"):
        split = RW.train_test_split(df, KEY, recipe.test_size, recipe.seed,
                                    stratify=LABEL if binary else None, num_partitions=parts)
    split = split.persist(StorageLevel.MEMORY_AND_DISK)
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    unsampled = train
    if recipe.resample != "before_split":
        train = resample(train)
    # C5 again: classes left in train -> contiguous codes; unseen in test -> stop
    n_classes = 0
    if task == TG.CLASSIFICATION:
        present = sorted(r[0] for r in train.select(LABEL).distinct().collect())
        seen_test = sorted(r[0] for r in test.select(LABEL).distinct().collect())
        unseen = [c for c in seen_test if c not in present]
        if unseen:
            raise DataError("Test set contains classes not present in the training set.")
        if present != list(range(len(present))):
            remap = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(float(c)), F.lit(float(i)))])
            lm = TG.LabelMap(lm.column, tuple(lm.classes[int(c)] for c in present), lm.numeric, lm.dtype)
            train = train.withColumn(LABEL, F.element_at(remap, F.col(LABEL)))
            unsampled = unsampled.withColumn(LABEL, F.try_element_at(remap, F.col(LABEL))).where(F.col(LABEL).isNotNull())
            test = test.withColumn(LABEL, F.element_at(remap, F.col(LABEL)))
        n_classes = len(present)
    # cut the lineage here: the prepared parts are written to the cluster's
    # shared checkpoint folder, so a lost executor never replays the range
    # shuffles, the forest scoring or the bootstrap join; then every cache
    # taken on the way is released
    from ..functions.cache import release
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    with _timed(report, "checkpoint"):
        train_c = train.repartition(parts).checkpoint(eager=True)
        test_c = test.coalesce(parts).checkpoint(eager=True)
        unsampled_c = train_c if unsampled is train else unsampled.coalesce(parts).checkpoint(eager=True)
    release(train, test, split, df, source)
    train, test = train_c, test_c
    with _timed(report, "train_stats"):
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    with _timed(report, "feature_pipeline_fit"):
        # the training part has passed the stages in the fit: no second search of its gaps
        feature_model, names, _, train_full = fit_features(train, numeric, categorical, other, recipe, task)
    from ..functions.cache import held

    def staged(frame):
        """Apply the fitted stages one by one, collecting the caches they take."""
        taken = []
        for stage in feature_model.stages:
            frame = stage.transform(frame)
            taken += held(frame)
        return frame, taken

    test_full, test_caches = staged(test)
    train_t = train_full.select(KEY, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    test_t = test_full.select(KEY, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    # materialise both, then drop the caches the stages took on the way
    # (e.g. the imputer's rows with gaps)
    with _timed(report, "materialise"):
        train_t.count()
        test_t.count()
    release(*test_caches)
    # Nothing missing may reach the model (the assembler would fail on a
    # null feature; the label is checked here)
    with _timed(report, "transform_validate"):
        FE.validate_no_missing(train_t, [LABEL], "target")
    report["n_train"] = stats["n"]
    return FitResult(task=task, target=target, recipe=recipe, contract=contract, label_map=lm,
                     feature_model=feature_model, feature_names=names, numeric=numeric,
                     categorical=categorical, train=train_t, test=test_t, raw_train=train, raw_test=test, split_train=unsampled_c,
                     other=other, n_train=int(stats["n"]),
                     label_std=float(stats["s"] or 0.0), n_classes=n_classes, report=report)
