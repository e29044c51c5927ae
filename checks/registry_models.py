"""Registered queries for models, neighbours, explanations and scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabml.functions.hashing import md5_bucket
from tabml.operators import explain as X
from tabml.operators import metrics as M
from tabml.operators import neighbors as NB
from tabml.plans import views as V
from tabml.plans.models import FitContext, make_model
from tabml.plans.recipe import Contract
from tabml.plans.score import align_to_schema

from .common import LINEITEM_KEY, r, rounded, sql_md5_bucket, sql_seeded_hash60, with_views
from .flagship import prepared
from .registry import register

# ------------------------------------------------------------------ D3

_IMP = ["p_partkey", "p_size", "p_retailprice"]


@register("d3_knn_impute", with_views(["part_null"], """
SELECT p.p_partkey::DOUBLE AS p_partkey, p.p_name, p.p_brand, p.p_type,
       """ + r("coalesce(p.p_size, i.v_size, (SELECT avg(p_size) FROM part_null))") + """ AS p_size,
       """ + r("coalesce(p.p_retailprice, i.v_price, (SELECT avg(p_retailprice) FROM part_null))") + """ AS p_retailprice
FROM part_null p LEFT JOIN (
  SELECT rk, avg(CASE WHEN col = 'size' THEN v END) AS v_size, avg(CASE WHEN col = 'price' THEN v END) AS v_price
  FROM (SELECT *, row_number() OVER (PARTITION BY rk, col ORDER BY dist, v) AS rn FROM (
          SELECT r.p_partkey AS rk, 'size' AS col, d.p_size::DOUBLE AS v,
                 sqrt(3.0 / (1 + CASE WHEN r.p_retailprice IS NOT NULL AND d.p_retailprice IS NOT NULL THEN 1 ELSE 0 END)
                      * ((r.p_partkey - d.p_partkey)::DOUBLE ^ 2 + coalesce((r.p_retailprice - d.p_retailprice) ^ 2, 0))) AS dist
          FROM part_null r, part_null d WHERE r.p_size IS NULL AND d.p_size IS NOT NULL
          UNION ALL
          SELECT r.p_partkey, 'price', d.p_retailprice,
                 sqrt(3.0 / (1 + CASE WHEN r.p_size IS NOT NULL AND d.p_size IS NOT NULL THEN 1 ELSE 0 END)
                      * ((r.p_partkey - d.p_partkey)::DOUBLE ^ 2 + coalesce((r.p_size - d.p_size)::DOUBLE ^ 2, 0)))
          FROM part_null r, part_null d WHERE r.p_retailprice IS NULL AND d.p_retailprice IS NOT NULL))
  WHERE rn <= 3 GROUP BY rk) i ON p.p_partkey = i.rk"""))
def _d3(spark, sf):
    df = V.part_null(spark, sf)
    model = NB.KnnImputer(inputCols=_IMP, k=3).fit(df)
    return rounded(model.transform(df))


# ------------------------------------------------------------- E6, E13

def _emb(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.withColumn("is_test", md5_bucket(F.col("vec_id")) % 10 < 3)


def _knn(spark, sf, task, k=5):
    e = _emb(spark, sf)
    vec = F.col("embedding").cast("array<double>")
    q = e.where("is_test").select(F.col("vec_id").alias("_qid"), vec.alias("_vec"))
    refs = e.where(~F.col("is_test")).select(F.col("vec_id").alias("_rid"), vec.alias("_vec"),
                                              F.col("label").cast("double").alias("_y"))
    cands = NB.knn_candidates(q, refs, k, block_rows=128)
    return NB.knn_predict(cands, task).select(F.col("_qid").alias("vec_id"), F.col("_pred").alias("prediction"))


_EMB_PAIRS = f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, {sql_md5_bucket('vec_id')} % 10 < 3 AS is_test
      FROM embeddings),
pairs AS (SELECT q.vec_id AS qid, t.vec_id AS rid, t.label::DOUBLE AS y, list_distance(q.v, t.v) AS dist
          FROM e q JOIN e t ON q.is_test AND NOT t.is_test),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rn FROM pairs)
        WHERE rn <= 5)"""


@register("e6_knn_classifier", f"""WITH {_EMB_PAIRS},
votes AS (SELECT qid, y, count(*) AS n FROM top GROUP BY 1, 2)
SELECT qid AS vec_id, y AS prediction
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, y) AS rk FROM votes) WHERE rk = 1""")
def _e6(spark, sf):
    return _knn(spark, sf, "classification")


@register("e13_knn_regressor", f"""WITH {_EMB_PAIRS}
SELECT qid AS vec_id, {r('avg(y)')} AS prediction FROM top GROUP BY qid""")
def _e13(spark, sf):
    return rounded(_knn(spark, sf, "regression"))


# ------------------------------------------------------------------ E7

_NB_FEATS = ["n_chars", "n_words", "non_letter", "toxic"]


@register("e7_naive_bayes", with_views(["doc_stats"], " UNION ALL ".join(
    f"SELECT CAST(quality AS INTEGER) AS class, '{c}' AS feature, {r(f'avg({c})', 4)} AS mean, "
    f"{r(f'var_pop({c}) + 1e-9 * (SELECT max(v) FROM (' + ' UNION ALL '.join(f'SELECT var_pop({x}) AS v FROM doc_stats' for x in _NB_FEATS) + '))', 4)} AS var "
    f"FROM doc_stats GROUP BY quality" for c in _NB_FEATS)))
def _e7(spark, sf):
    df = VectorAssembler(inputCols=_NB_FEATS, outputCol="features").transform(
        V.doc_stats(spark, sf).withColumn("label", F.col("quality").cast("double")))
    model = make_model("classification", "Gaussian Naive Bayes", FitContext(n_rows=1)).fit(df)
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    rows = [(int(ci), f, float(theta[ci, j]), float(sigma[ci, j]))
            for ci in range(theta.shape[0]) for j, f in enumerate(_NB_FEATS)]
    return rounded(spark.createDataFrame(rows, "class int, feature string, mean double, var double"), 4)


# ------------------------------------------------------------ E8 - E11
# one feature (l_quantity) -> l_extendedprice; closed forms in SQL

_LIN = """s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
              sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) ^ 2) AS sxx,
              sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) *
                  (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))) AS sxy FROM lineitem)"""


def _lin_model(spark, sf, name, **params):
    li = V.table(spark, sf, "lineitem")
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        li.withColumn("label", F.col("l_extendedprice")))
    st = li.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("l_extendedprice").alias("s")).first()
    est = make_model("regression", name, FitContext(n_rows=int(st["n"]), label_std=float(st["s"])), **params)
    if hasattr(est, "setTol"):
        est.setTol(1e-12)
    m = est.fit(df)
    return spark.createDataFrame([(name, float(m.coefficients[0]), float(m.intercept))],
                                 "model string, coefficient double, intercept double")


def _lin_sql(name, slope):
    return f"""WITH {_LIN}, w AS (SELECT {slope} AS b1, mx, my FROM s)
SELECT '{name}' AS model, {r('b1', 3)} AS coefficient, {r('my - b1 * mx', 2)} AS intercept FROM w"""


def _lin_round(df):
    return df.select("model", F.round("coefficient", 3).alias("coefficient"),
                     F.round("intercept", 2).alias("intercept"))


@register("e8_linear_regression", _lin_sql("Linear Regression", "sxy / sxx"))
def _e8(spark, sf):
    return _lin_round(_lin_model(spark, sf, "Linear Regression"))


@register("e9_ridge", _lin_sql("Ridge", "sxy / (sxx + 1e6)"))
def _e9(spark, sf):
    return _lin_round(_lin_model(spark, sf, "Ridge", alpha=1e6))


@register("e10_lasso", _lin_sql("Lasso", "sign(sxy / n) * greatest(abs(sxy / n) - 1e4, 0) / (sxx / n)"))
def _e10(spark, sf):
    return _lin_round(_lin_model(spark, sf, "Lasso", alpha=1e4))


@register("e11_elastic_net",
          _lin_sql("ElasticNet", "sign(sxy / n) * greatest(abs(sxy / n) - 1e4 * 0.5, 0) / (sxx / n + 1e4 * 0.5)"))
def _e11(spark, sf):
    return _lin_round(_lin_model(spark, sf, "ElasticNet", alpha=1e4, l1_ratio=0.5))


# ------------------------------------------- F2: grids of the linear family by folds

_LINEAR_GRIDS = {"Linear Regression": [{}], "Ridge": [{"alpha": 1e5}, {"alpha": 1e7}], "Lasso": [{"alpha": 1e3}, {"alpha": 1e5}],
                 "ElasticNet": [{"alpha": 1e2, "l1_ratio": 0.1}, {"alpha": 1e4, "l1_ratio": 0.9}]}


def _slope_sql(name, alpha=0.0, l1_ratio=0.5):
    if name in ("Linear Regression", "Ridge"):
        return f"sxy / (sxx + {alpha})"
    l1, l2 = (alpha, 0.0) if name == "Lasso" else (alpha * l1_ratio, alpha * (1 - l1_ratio))
    return f"sign(sxy) * greatest(abs(sxy / n) - {l1}, 0) / (sxx / n + {l2})"


@register("f2_linear_grids_by_folds", f"""
WITH x AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice AS y, {sql_md5_bucket(LINEITEM_KEY)} % 5 AS fold FROM lineitem),
f AS (SELECT DISTINCT fold FROM x),
t AS (SELECT f.fold, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM f JOIN x ON x.fold <> f.fold GROUP BY f.fold),
w AS (""" + " UNION ALL ".join(f"SELECT '{name}' AS model, {i} AS point, fold, mx, my, {_slope_sql(name, **p)} AS b FROM t"
                               for name, grid in _LINEAR_GRIDS.items() for i, p in enumerate(grid)) + f""")
SELECT model, CAST(point AS INTEGER) AS point, CAST(fold AS INTEGER) AS fold,
  {r('1 - sum((y - my - b * (x - mx)) ^ 2) / any_value(tot)')} AS r2
FROM w JOIN x USING (fold) JOIN (SELECT fold, regr_syy(y, x) AS tot FROM x GROUP BY fold) USING (fold) GROUP BY model, point, fold""")
def _f2l(spark, sf):
    """Every grid point on every fold of the whole lineitem table, from one pass."""
    from tabml.plans.linear_stats import grid_by_folds, moments
    li = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        V.table(spark, sf, "lineitem").withColumn("fold", md5_bucket(V.lineitem_key()) % 5))
    folds = moments(li, "fold", label_col="l_extendedprice")
    rows = [(name, i, f, score) for name, grid in _LINEAR_GRIDS.items()
            for i, scores in enumerate(grid_by_folds(folds, name, grid)) for f, score in zip(sorted(folds), scores)]
    return rounded(spark.createDataFrame(rows, "model string, point int, fold int, r2 double"))


# ------------------------------------------------------------- H1, H3, H5, H6

_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("h1_explain_sample", f"""
SELECT {LINEITEM_KEY} AS row_id, {', '.join(f'coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}' for c in _LI4)},
       0.0 AS absent_feature
FROM lineitem ORDER BY {sql_seeded_hash60(42, LINEITEM_KEY)}, row_id LIMIT 1000""")
def _h1(spark, sf):
    return X.explain_sample(V.lineitem_keyed(spark, sf), _LI4 + ["absent_feature"], "row_id", 1000, 42)


def _phi_long(spark, sf):
    li = V.lineitem_keyed(spark, sf)
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        li.withColumn("label", F.col("l_extendedprice")))
    m = make_model("regression", "Linear Regression", FitContext(n_rows=1)).fit(df)
    return X.linear_model_shap(m, df, df, ["l_quantity"], key="row_id")


_PHI = f"""phi AS (SELECT {LINEITEM_KEY} AS row_id, 0 AS class, 'l_quantity' AS feature, l_quantity::DOUBLE AS value,
       (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) *
       (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) AS phi FROM lineitem)"""


@register("h3_linear_shap", f"WITH {_PHI} SELECT row_id, class, feature, {r('value')} AS value, {r('phi', 2)} AS phi FROM phi")
def _h3(spark, sf):
    p = _phi_long(spark, sf)
    return p.select("row_id", "class", "feature", F.round("value", 6).alias("value"), F.round("phi", 2).alias("phi"))


@register("h5_shap_summary", f"""WITH {_PHI}
SELECT class, feature, {r('avg(abs(phi))', 2)} AS mean_abs, {r('avg(phi)', 2)} AS mean,
       {r('min(phi)', 2)} AS min, {r('max(phi)', 2)} AS max FROM phi GROUP BY class, feature""")
def _h5(spark, sf):
    s = X.shap_summary(_phi_long(spark, sf))
    return s.select("class", "feature", *[F.round(c, 2).alias(c) for c in ["mean_abs", "mean", "min", "max"]])


@register("h6_shap_dependence", f"WITH {_PHI} SELECT row_id, {r('value')} AS value, {r('phi', 2)} AS phi FROM phi")
def _h6(spark, sf):
    d = X.shap_dependence(_phi_long(spark, sf), "l_quantity", 0)
    return d.select("row_id", F.round("value", 6).alias("value"), F.round("phi", 2).alias("phi"))


# ------------------------------------- H2, H4: Shapley values that SQL computes by subsets

_TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: A fixed tree: leaf -> (low, high] of quantity, discount and tax.
_FIXED_TREE = {"A": ((None, 10), (None, 0.05), None), "B": ((10, 24), (None, 0.05), None), "C": ((None, 24), (0.05, None), None),
               "D": ((24, None), None, (None, 0.04)), "E": ((24, None), (None, 0.02), (0.04, None)), "G": ((24, None), (0.02, None), (0.04, None))}


def _leaf_of_fixed_tree():
    q, d, t = (F.col(c) for c in _TREE_FEATURES)
    low = F.when(d > 0.05, "C").when(q <= 10, "A").otherwise("B")
    return F.when(q <= 24, low).when(t <= 0.04, "D").when(d <= 0.02, "E").otherwise("G")


_LEAF_SQL = """CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount > 0.05 THEN 'C' WHEN l_quantity <= 10 THEN 'A' ELSE 'B' END
  WHEN l_tax <= 0.04 THEN 'D' WHEN l_discount <= 0.02 THEN 'E' ELSE 'G' END"""


def _fixed_leaves(li):
    """The fixed tree's leaves, with the covers and mean prices of ``li``."""
    at = {x["leaf"]: (x["n"], x["v"]) for x in li.groupBy(_leaf_of_fixed_tree().alias("leaf")).agg(
        F.count("*").alias("n"), F.avg("l_extendedprice").alias("v")).collect()}
    n = {k: float(at.get(k, (0, 0.0))[0]) for k in _FIXED_TREE}
    low, left, high, right = n["A"] + n["B"], n["A"] + n["B"] + n["C"], n["E"] + n["G"], n["D"] + n["E"] + n["G"]
    total = left + right
    cover = {"A": (left / total * n["A"] / low, low / left, 1), "B": (left / total * n["B"] / low, low / left, 1),
             "C": (left / total, n["C"] / left, 1), "D": (right / total, 1, n["D"] / right),
             "E": (right / total, n["E"] / high, high / right), "G": (right / total, n["G"] / high, high / right)}
    rows = []
    for i, (leaf, bounds) in enumerate(_FIXED_TREE.items()):
        on = [j for j, b in enumerate(bounds) if b]
        ends = [[float("-inf") if bounds[j][0] is None else float(bounds[j][0]), float("inf") if bounds[j][1] is None else float(bounds[j][1])] for j in on]
        rows.append((0, i, on, [a for a, _ in ends], [z for _, z in ends], [None] * len(on), [[]] * len(on), [float(cover[leaf][j]) for j in on], [float(at[leaf][1])]))
    return li.sparkSession.createDataFrame(rows, X.LEAVES)


def _leaf_condition(bounds, column):
    if bounds is None:
        return "1.0"
    low, high = bounds
    parts = [f"{column} > {low}"] * (low is not None) + [f"{column} <= {high}"] * (high is not None)
    return f"CAST({' AND '.join(parts)} AS DOUBLE)"


_SUBSETS = "({a} - {za}) * ({zb} * {zc} / 3 + {b} * {zc} / 6 + {zb} * {c} / 6 + {b} * {c} / 3)"


@register("h2_leaf_paths_by_subsets", f"""
WITH li AS (SELECT *, {LINEITEM_KEY} AS row_id, {_LEAF_SQL} AS leaf FROM lineitem),
n AS (SELECT count(*)::DOUBLE AS total, """ + ", ".join(f"(count(*) FILTER (leaf = '{k}'))::DOUBLE AS n{k}, avg(l_extendedprice) FILTER (leaf = '{k}') AS v{k}" for k in _FIXED_TREE) + """ FROM li),
z AS (SELECT *, nA + nB AS low, nA + nB + nC AS lft, nE + nG AS high, nD + nE + nG AS rgt FROM n),
leaf AS (
  SELECT 'A' AS leaf, vA AS v, lft / total * nA / low AS zq, low / lft AS zd, 1.0 AS zt FROM z UNION ALL
  SELECT 'B', vB, lft / total * nB / low, low / lft, 1.0 FROM z UNION ALL SELECT 'C', vC, lft / total, nC / lft, 1.0 FROM z UNION ALL
  SELECT 'D', vD, rgt / total, 1.0, nD / rgt FROM z UNION ALL SELECT 'E', vE, rgt / total, nE / high, high / rgt FROM z UNION ALL
  SELECT 'G', vG, rgt / total, nG / high, high / rgt FROM z),
o AS (""" + " UNION ALL ".join(
    f"SELECT row_id, rid, '{k}' AS leaf, {_leaf_condition(b[0], 'l_quantity')} AS oq, {_leaf_condition(b[1], 'l_discount')} AS od, {_leaf_condition(b[2], 'l_tax')} AS ot "
    "FROM (SELECT *, row_number() OVER () AS rid FROM li)" for k, b in _FIXED_TREE.items()) + """),
phi AS (SELECT row_id, rid,
  sum(v * """ + _SUBSETS.format(a="oq", za="zq", b="od", zb="zd", c="ot", zc="zt") + """) AS l_quantity,
  sum(v * """ + _SUBSETS.format(a="od", za="zd", b="oq", zb="zq", c="ot", zc="zt") + """) AS l_discount,
  sum(v * """ + _SUBSETS.format(a="ot", za="zt", b="oq", zb="zq", c="od", zc="zd") + f""") AS l_tax
  FROM o JOIN leaf USING (leaf) GROUP BY row_id, rid)
""" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {r(c, 4)} AS phi FROM phi" for c in _TREE_FEATURES))
def _h2l(spark, sf):
    """A fixed tree over the whole of lineitem: intervals met twice on a path, features missing from paths."""
    li = V.lineitem_keyed(spark, sf)
    rows = VectorAssembler(inputCols=_TREE_FEATURES, outputCol="features").transform(li).select("row_id", "features")
    phi, _ = X.leaf_shap(_fixed_leaves(li), rows, _TREE_FEATURES, key="row_id")
    return rounded(phi.select("row_id", "feature", "phi"), 4)


class _Product:
    """quantity * discount + tax: a model that is nothing but its ``transform``."""

    @staticmethod
    def transform(df):
        x = vector_to_array("features")
        return df.withColumn("prediction", x[0] * x[1] + x[2])


def _sampled_sql(seed, n):
    return (f"SELECT {LINEITEM_KEY} AS row_id, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t FROM lineitem "
            f"ORDER BY {sql_seeded_hash60(seed, LINEITEM_KEY)}, row_id LIMIT {n}")


@register("h4_kernel_shap_by_subsets", f"""
WITH x AS ({_sampled_sql(42, 1000)}), b AS ({_sampled_sql(7, 50)}),
m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(q * d) AS mqd, avg(t) AS mt FROM b),
phi AS (SELECT row_id, ((q * md - mqd) + (q * d - mq * d)) / 2 AS l_quantity, ((mq * d - mqd) + (q * d - q * md)) / 2 AS l_discount, t - mt AS l_tax FROM x, m)
""" + " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {r(c)} AS phi FROM phi" for c in _TREE_FEATURES))
def _h4p(spark, sf):
    """A model known by its ``transform`` alone, the H1 sample of 1000 rows against a background of 50."""
    li = VectorAssembler(inputCols=_TREE_FEATURES, outputCol="features").transform(V.lineitem_keyed(spark, sf)).select("row_id", "features")
    phi, _ = X.kernel_shap(_Product, X.explain_sample_vectors(li, "row_id", 1000, 42), X.explain_sample_vectors(li, "row_id", 50, 7), _TREE_FEATURES, key="row_id")
    return rounded(phi.select("row_id", "feature", "phi"))


# ------------------------------------------------------------------ I1

_CONTRACT = Contract(
    target="o_totalprice", dropped_ids=["o_orderkey"],
    original_columns=["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_clerk_score"],
    original_types={"o_custkey": "bigint", "o_orderstatus": "string", "o_orderdate": "timestamp_ntz",
                    "o_orderpriority": "string", "o_clerk_score": "double"},
    datetime_columns=["o_orderdate"], pipeline_columns=[])


@register("i1_align_to_schema", """
SELECT TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_custkey::VARCHAR ELSE o_custkey::VARCHAR END AS BIGINT) AS o_custkey,
       o_orderstatus,
       TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS o_orderdate,
       CAST(NULL AS VARCHAR) AS o_orderpriority,
       0.0 AS o_clerk_score
FROM orders""")
def _i1(spark, sf):
    o = V.table(spark, sf, "orders")
    dirty = o.select(
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
        .otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("o_orderdate"),
        F.col("o_totalprice").alias("unused_extra"))
    return align_to_schema(dirty, _CONTRACT)


# ------------------------------------------------------- rows-only: the flow

@register("automl_rf_doc_quality")
def _automl(spark, sf):
    from .flagship import flagship
    return rounded(flagship(spark, sf))


@register("f5_compare_classifiers")
def _f5c(spark, sf):
    from tabml.plans.train import compare_models
    return compare_models(prepared(spark, sf))[0]


@register("f5_compare_regressors")
def _f5r(spark, sf):
    from tabml.plans.train import compare_models
    return compare_models(prepared(spark, sf, "n_chars"))[0]


@register("f6_best_model")
def _f6(spark, sf):
    from tabml.plans.train import best_model
    return best_model(_f5c(spark, sf))


@register("h2_tree_shap_summary")
def _h2(spark, sf):
    from .flagship import flagship_fit
    fr, model, _ = flagship_fit(spark, sf)
    phi, _ = X.tree_shap(model, fr.test, fr.feature_names)
    return rounded(X.shap_summary(phi))


@register("i2_score_documents")
def _i2(spark, sf):
    from tabml.plans.score import ScoringBundle, score
    from tabml.plans.train import full_pipeline
    from .flagship import flagship_fit
    fr, model, _ = flagship_fit(spark, sf)
    bundle = ScoringBundle.from_fit(fr, full_pipeline(fr, model))
    return score(bundle, V.doc_stats(spark, sf).drop("quality"), passthrough=["doc_id"])


# ------------------------------------------------------------------ D2

@register("d2_synthetic_scoring_signal", with_views(["orders_null"], f"""
SELECT o_orderkey,
       {r("(o_orderkey + o_custkey + coalesce(o_totalprice, 0)) / (2 + CAST(o_totalprice IS NOT NULL AS INTEGER))", 4)}
       AS synthetic_highly_correlated_feature
FROM orders_null"""))
def _d2(spark, sf):
    from tabml.operators import features as FE
    df = V.orders_null(spark, sf)
    out = FE.synthetic_signal(df, None, noise=0.0, numeric_cols=["o_orderkey", "o_custkey", "o_totalprice"])
    return out.select("o_orderkey", F.round(FE.SYNTHETIC, 4).alias(FE.SYNTHETIC))


# ------------------------------------------------------- rows-only: models

@register("g11_feature_importance")
def _g11(spark, sf):
    from tabml.plans.train import fit_model
    fr = prepared(spark, sf)
    return rounded(M.feature_importance(fit_model(fr, "Random Forest"), fr.feature_names, spark=spark))


@register("f2_grid_search_logistic")
def _f2(spark, sf):
    from tabml.plans.train import grid_search
    fr = prepared(spark, sf)
    best, table = grid_search(fr, "Logistic Regression")
    return spark.createDataFrame([(str(p), float(s), p == best) for p, s in table],
                                 "params string, mean_accuracy double, best boolean")


@register("f3_cross_validate_forest")
def _f3(spark, sf):
    from tabml.plans.train import cross_validate
    fr = prepared(spark, sf, "n_chars")
    folds, mean, std = cross_validate(fr, "Random Forest")
    return spark.createDataFrame([(f, float(s), float(mean), float(std)) for f, s in folds],
                                 "fold int, r2 double, mean_r2 double, std_r2 double")


@register("d8_pca_components")
def _d8p(spark, sf):
    from tabml.operators import features as FE
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    means, comps, var = FE.fit_pca(V.table(spark, sf, "lineitem"), cols, 3)
    rows = [(k, c, float(comps[k][j]), float(var[k])) for k in range(len(comps)) for j, c in enumerate(cols)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, variance double")


@register("h4_kernel_shap_logistic")
def _h4(spark, sf):
    from tabml.plans.train import fit_model
    fr = prepared(spark, sf)
    model = fit_model(fr, "Logistic Regression")
    rows = X.explain_sample_vectors(fr.test, "_row_id", 1000, 42)
    background = X.explain_sample_vectors(fr.train, "_row_id", 100, 7)
    phi, base = X.kernel_shap(model, rows, background, fr.feature_names, output="probability")
    return rounded(X.shap_summary(phi))


@register("a13_save_load_score")
def _a13(spark, sf):
    from tabml.plans.score import ScoringBundle, load_bundle, save_bundle, score
    from tabml.plans.train import fit_model, full_pipeline
    from tabml.session import shared_dir
    import uuid
    fr = prepared(spark, sf)
    bundle = ScoringBundle.from_fit(fr, full_pipeline(fr, fit_model(fr, "Gaussian Naive Bayes")))
    path = shared_dir(spark, f"bundle-{uuid.uuid4().hex}")
    save_bundle(bundle, path)
    return score(load_bundle(spark, path), V.doc_stats(spark, sf).drop("quality"), passthrough=["doc_id"])
