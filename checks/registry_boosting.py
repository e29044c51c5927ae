"""Boosted trees and forests of one tree against SQL that finds every split itself."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabml.plans import views as V
from tabml.plans.models import FitContext, make_model

from .common import LINEITEM_KEY, r
from .registry import register

_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _candidates(rows: str, names, by: str, l2: float, least_h: float, least_n: int) -> str:
    """Every split of the groups ``by`` of a table with columns f0.., g, h: j, x and the gain."""
    long = " UNION ALL ".join(f"SELECT {by}, {j} AS j, f{j} AS x, g, h FROM {rows}" for j in range(len(names)))
    return f"""
SELECT *, gl * gl / (hl + {l2}) + (ga - gl) * (ga - gl) / (ha - hl + {l2}) - ga * ga / (ha + {l2}) AS gain FROM (
  SELECT {by}, j, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
         sum(g) OVER (PARTITION BY {by}, j) AS ga, sum(h) OVER (PARTITION BY {by}, j) AS ha, sum(n) OVER (PARTITION BY {by}, j) AS na
  FROM (SELECT {by}, j, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({long}) GROUP BY {by}, j, x)
  WINDOW w AS (PARTITION BY {by}, j ORDER BY x))
WHERE nl >= {least_n} AND na - nl >= {least_n} AND hl >= {least_h} AND ha - hl >= {least_h}"""


def _side(names) -> str:
    return "CASE WHEN CASE b.j " + " ".join(f"WHEN {j} THEN f{j}" for j in range(len(names))) + " END <= b.x THEN 'L' ELSE 'R' END"


def _tree_sql(steps: int, one_leaf: bool, rate: float, l2: float, least_h: float, least_n: int) -> str:
    """``steps`` levels, or ``steps`` splits of one leaf each."""
    names = _FEATURES
    ctes = ["a0 AS MATERIALIZED (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS f{j}" for j, c in enumerate(names))
            + ", avg(CAST(l_extendedprice AS DOUBLE)) OVER () - CAST(l_extendedprice AS DOUBLE) AS g, 1.0::DOUBLE AS h, '' AS path FROM lineitem)"]
    for s in range(steps):
        rows = f"a{s}" if one_leaf else f"(SELECT * FROM a{s} WHERE length(path) = {s})"
        order = "ORDER BY gain DESC, path, j, x" if one_leaf else "PARTITION BY path ORDER BY gain DESC, j, x"
        ctes.append(f"b{s} AS MATERIALIZED (SELECT {s} AS step, * FROM ({_candidates(rows, names, 'path', l2, least_h, least_n)}) "
                    f"WHERE gain > 1e-6 QUALIFY row_number() OVER ({order}) = 1)")
        ctes.append(f"a{s + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (path), a.path || CASE WHEN b.path IS NULL THEN '' ELSE {_side(names)} END AS path "
                    f"FROM a{s} a LEFT JOIN b{s} b ON a.path = b.path)")
    feature = "CASE j " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(names)) + " END"
    found = " UNION ALL ".join(f"SELECT * FROM b{s}" for s in range(steps))
    step = "CAST(step AS INTEGER)" if one_leaf else "CAST(-1 AS INTEGER)"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT {step} AS step, path, {feature} AS feature, {r('x')} AS threshold, {r('log10(gain)')} AS log_gain, CAST(na AS BIGINT) AS n_rows,
       CAST(NULL AS DOUBLE) AS value FROM ({found})
UNION ALL
SELECT CAST(-1 AS INTEGER), path, 'leaf', 0.0, 0.0, count(*), {r(f'-{rate} * sum(g) / (sum(h) + {l2})', 3)} FROM a{steps} GROUP BY path"""


def _tree(spark, sf, name: str, ordered: bool, **params):
    li = V.table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("label"), *[F.col(c).cast("double") for c in _FEATURES])
    df = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(li)
    model = make_model("regression", name, FitContext(n_rows=1), n_estimators=1, **params).fit(df)
    left = model.trees()[0]["left"]
    nodes = [(int(left[n] - 1) // 2 if ordered and f >= 0 else -1, path, _FEATURES[f] if f >= 0 else "leaf", at, gain, int(cover),
              None if f >= 0 else value) for _, n, path, f, at, gain, value, cover in model.nodes()]
    out = spark.createDataFrame(nodes, "step int, path string, feature string, threshold double, gain double, n_rows long, value double")
    return out.select("step", "path", "feature", (F.round("threshold", 6) + 0.0).alias("threshold"),
                      F.when(F.col("feature") == "leaf", 0.0).otherwise(F.round(F.log10("gain"), 6) + 0.0).alias("log_gain"), "n_rows",
                      (F.round("value", 3) + 0.0).alias("value"))


@register("e15_first_tree_by_levels", _tree_sql(3, False, 0.3, 1.0, 1.0, 1))
def _e15(spark, sf):
    """The first tree of three levels of boosting by levels: splits, gains, rows and leaf values."""
    return _tree(spark, sf, "XGBoost", False, max_depth=3)


@register("e16_first_tree_by_leaves", _tree_sql(30, True, 0.1, 0.0, 1e-3, 20))
def _e16(spark, sf):
    """The first tree of 31 leaves of boosting by leaves, split by split, without a limit of depth."""
    return _tree(spark, sf, "LightGBM", True)


_MONTH = "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS DOUBLE)"
_CLASS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_SOFTMAX_SQL = f"""WITH base AS (SELECT {LINEITEM_KEY} AS row_id, CAST(l_quantity AS DOUBLE) AS f0, {_MONTH} AS f1, {_CLASS} AS y FROM lineitem),
shares AS (SELECT y AS c, count(*) / (SELECT count(*) FROM base)::DOUBLE AS p FROM base GROUP BY y),
a AS MATERIALIZED (SELECT c, f0, f1, p - CASE WHEN y = c THEN 1 ELSE 0 END AS g, 2 * p * (1 - p) AS h FROM base, shares),
b AS MATERIALIZED (SELECT * FROM ({_candidates('a', ['f0', 'f1'], 'c', 1.0, 1.0, 1)}) QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, j, x) = 1),
m AS (SELECT row_id, b.c, exp(ln(p) - 0.3 * CASE WHEN {_side(['f0', 'f1'])} = 'L' THEN gl / (hl + 1) ELSE (ga - gl) / (ha - hl + 1) END) AS e
      FROM base, b JOIN shares ON shares.c = b.c)
SELECT row_id, {', '.join(r(f'sum(CASE WHEN c = {c} THEN e END) / sum(e)') + f' AS p{c}' for c in range(3))} FROM m GROUP BY row_id"""


@register("e2_softmax_first_round", _SOFTMAX_SQL)
def _e2s(spark, sf):
    """Probabilities of three classes after a round of one-level trees, in one softmax model."""
    li = V.lineitem_keyed(spark, sf).select(
        "row_id", F.col("l_quantity").cast("double").alias("f0"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("double").alias("f1"),
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"))
    df = VectorAssembler(inputCols=["f0", "f1"], outputCol="features").transform(li)
    model = make_model("classification", "XGBoost", FitContext(n_rows=1, n_classes=3), n_estimators=1, max_depth=1).fit(df)
    p = vector_to_array("probability")
    return model.transform(df).select("row_id", *[(F.round(p[c], 6) + 0.0).alias(f"p{c}") for c in range(3)])


_STUMP = ["CAST(l_discount AS DOUBLE)", "CAST(l_tax AS DOUBLE)", "CAST(floor(l_quantity / 5) AS DOUBLE)", "CAST(year(l_shipdate) AS DOUBLE)"]


def _stump_sql(label: str, digits: int, classes: bool = False) -> str:
    """The split of least impurity (Gini for 0/1 labels is twice the variance) and the mean label on both sides; of
    ``classes``, sides that predict the same one are one leaf."""
    one = "(gl / hl > 0.5) = ((ga - gl) / (ha - hl) > 0.5)" if classes else "false"
    names = [f"f{j}" for j in range(len(_STUMP))]
    columns = ", ".join(f"{e} AS {n}" for e, n in zip(_STUMP, names))
    return f"""WITH a AS MATERIALIZED (SELECT {LINEITEM_KEY} AS row_id, {columns}, CAST({label} AS DOUBLE) AS g, 1.0::DOUBLE AS h, 0 AS c FROM lineitem),
b AS MATERIALIZED (SELECT * FROM ({_candidates('a', names, 'c', 0.0, 1.0, 1)}) ORDER BY gain DESC, j, x LIMIT 1)
SELECT row_id, {r("CASE WHEN " + one + " THEN ga / ha WHEN " + _side(names) + " = 'L' THEN gl / hl ELSE (ga - gl) / (ha - hl) END", digits)} AS mean FROM a, b"""


def _stump(spark, sf, task, label):
    li = V.lineitem_keyed(spark, sf).select(
        "row_id", label.cast("double").alias("label"), F.col("l_discount").cast("double").alias("f0"), F.col("l_tax").cast("double").alias("f1"),
        F.floor(F.col("l_quantity") / 5).cast("double").alias("f2"), F.year("l_shipdate").cast("double").alias("f3"))
    df = VectorAssembler(inputCols=[f"f{j}" for j in range(4)], outputCol="features").transform(li)
    model = make_model(task, "Random Forest", FitContext(n_rows=1), n_estimators=1, max_depth=1, max_features="all", bootstrap=False).fit(df)
    return model.transform(df)


@register("e1_stump_of_least_gini", _stump_sql("CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END", 9, True))
def _e1s(spark, sf):
    """A forest of one stump over all rows: every row's class share.  Spark merges two leaves that predict the same class."""
    out = _stump(spark, sf, "classification", F.col("l_returnflag") == "N")
    return out.select("row_id", (F.round(vector_to_array("probability")[1], 9) + 0.0).alias("mean"))


@register("e14_stump_of_least_variance", _stump_sql("l_extendedprice", 4))
def _e14s(spark, sf):
    """A forest of one stump over all rows: every row's mean price."""
    return _stump(spark, sf, "regression", F.col("l_extendedprice")).select("row_id", (F.round("prediction", 4) + 0.0).alias("mean"))
