"""Registered queries whose SQL states an invariant: what must hold of a trained model, a saved
bundle, a stream or a numerical edge case, row by row or figure by figure."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabml.functions.hashing import md5_bucket, seeded_bucket
from tabml.operators import explain as X
from tabml.operators import explore, features, metrics, outliers
from tabml.plans import views as V
from tabml.plans.models import CLASSIFIERS, REGRESSORS, FitContext, make_model
from tabml.plans.recipe import prepare
from tabml.plans.score import ScoringBundle, load_bundle, save_bundle, score
from tabml.plans.train import assigned_folds, best_model, compare_models, fit_model, fold_count, full_pipeline
from tabml.session import shared_dir
from tabml.sources import tables

from .common import LINEITEM_KEY, r, rounded, sql_md5_bucket, sql_seeded_bucket, with_views
from .flagship import prepared
from .registry import _fclassif_sql, _freg_sql, register


def _scratch(spark, name):
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------ A1, A3

def _as_table(df, like):
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


@register("a1_read_csv", "SELECT * FROM customer")
def _a1(spark, sf):
    customer = V.table(spark, sf, "customer")
    path = _scratch(spark, "customer-csv")
    customer.write.option("header", True).csv(path)
    return _as_table(tables.read_table(spark, path, "csv"), customer)


@register("a3_read_json", "SELECT * FROM customer")
def _a3(spark, sf):
    customer = V.table(spark, sf, "customer")
    path = _scratch(spark, "customer-json")
    n = 16  # documents, each an array of records
    docs = (customer.withColumn("_d", F.pmod(F.xxhash64("c_custkey"), F.lit(n)).cast("int")).groupBy("_d")
            .agg(F.to_json(F.collect_list(F.struct(*customer.columns))).alias("value")))
    docs.repartitionById(n, F.col("_d")).select("value").write.text(path)
    return _as_table(tables.read_table(spark, path, "json"), customer)


# ------------------------------------------------- B5, D6, D7, G3, G6, G10: hard numbers

_SHIFTED = "lineitem_shifted AS (SELECT *, l_quantity + 1e9 AS q_big, 7.0 AS flat FROM lineitem)"


def _shifted(spark, sf):
    return V.table(spark, sf, "lineitem").withColumns({"q_big": F.col("l_quantity") + F.lit(1e9), "flat": F.lit(7.0)})


@register("b5_correlation_edge", f"""WITH {_SHIFTED}
SELECT col_a, col_b, {r('v')} AS r FROM (
""" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         + ("CAST(NULL AS DOUBLE)" if "flat" in (a, b) else
                            f"(SELECT corr({a.replace('q_big', 'l_quantity')}, {b.replace('q_big', 'l_quantity')}) FROM lineitem_shifted)") + " AS v"
                         for a in ("q_big", "l_extendedprice", "flat") for b in ("q_big", "l_extendedprice", "flat")) + ")")
def _b5e(spark, sf):
    return rounded(explore.correlation_matrix(_shifted(spark, sf), ["q_big", "l_extendedprice", "flat"]))


_FLAT_LAST = " UNION ALL SELECT 'flat', NULL, CAST({} AS INTEGER)"


@register("d6_f_classif_edge", "SELECT CASE feature WHEN 'l_quantity' THEN 'q_big' ELSE feature END AS feature, round(score, 2) AS score, rank FROM ("
          + _fclassif_sql("lineitem", ["l_quantity", "l_extendedprice"], "l_returnflag") + ")" + _FLAT_LAST.format(3))
def _d6e(spark, sf):
    out = features.f_classif_scores(_shifted(spark, sf), ["q_big", "l_extendedprice", "flat"], "l_returnflag")
    return out.withColumn("score", F.round(F.round("score", 4), 2))


@register("d7_f_regression_edge", "SELECT CASE feature WHEN 'l_quantity' THEN 'q_big' ELSE feature END AS feature, round(score, 0) AS score, rank FROM ("
          + _freg_sql("lineitem", ["l_quantity", "l_discount"], "l_extendedprice") + ")" + _FLAT_LAST.format(3))
def _d7e(spark, sf):
    out = features.f_regression_scores(_shifted(spark, sf), ["q_big", "l_discount", "flat"], "l_extendedprice")
    return out.withColumn("score", F.round(F.round("score", 4), 0))


@register("g6_r2_shifted", f"""
SELECT {r('1 - sum((l_quantity - p) ^ 2) / sum((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) ^ 2)', 5)} AS r2
FROM (SELECT l_quantity, l_extendedprice / 1500.0 AS p FROM lineitem)""")
def _g6s(spark, sf):
    df = V.table(spark, sf, "lineitem").select((F.col("l_quantity") + 1e9).alias("label"), (F.col("l_extendedprice") / 1500.0 + 1e9).alias("prediction"))
    return metrics.r2(df).select(F.round("r2", 5).alias("r2"))


_MANY = (f"many AS (SELECT CAST({sql_md5_bucket(LINEITEM_KEY)} AS DOUBLE) AS score, "
         "CAST(l_returnflag = 'N' AS INTEGER) AS label FROM lineitem)")


def _many(spark, sf):
    return V.table(spark, sf, "lineitem").select(md5_bucket(V.lineitem_key()).cast("double").alias("score"),
                                                 (F.col("l_returnflag") == "N").cast("int").alias("label"))


@register("g3_auc_many_scores", f"""WITH {_MANY}
SELECT {r('(sum(CASE WHEN label = 1 THEN rnk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))')} AS auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk FROM many)""")
def _g3m(spark, sf):
    return rounded(metrics.auc_roc(_many(spark, sf)))


@register("g10_roc_many_scores", f"""WITH {_MANY}
SELECT s AS threshold, {r('sum(neg) OVER (ORDER BY s DESC) / (SELECT count(*) FROM many WHERE label <> 1)')} AS fpr,
       {r('sum(pos) OVER (ORDER BY s DESC) / (SELECT count(*) FROM many WHERE label = 1)')} AS tpr
FROM (SELECT score AS s, sum(label) AS pos, sum(1 - label) AS neg FROM many GROUP BY 1)""")
def _g10m(spark, sf):
    return rounded(metrics.roc_curve(_many(spark, sf)))


# ------------------------------------------------------------------ D8, D14

_LI4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("d8_pca_diagonal", " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, true AS ok FROM (SELECT count(*) FROM lineitem)" for i in range(3) for j in range(3)))
def _d8d(spark, sf):
    """W' C W is diagonal with the explained variances, C from the whole table."""
    li = V.table(spark, sf, "lineitem")
    _, comps, var = features.fit_pca(li, _LI4, 3)
    projected = li.select(*[e.alias(n) for n, e in features.pca_exprs(_LI4, [0.0] * 4, comps).items()])
    cov = {(int(x["col_a"][3:]), int(x["col_b"][3:])): x["cov"] for x in features.covariance_matrix(projected, ["pca0", "pca1", "pca2"]).collect()}
    n = li.count()
    rows = [(i, j, abs(cov[i, j] * n / (n - 1) - (var[i] if i == j else 0.0)) <= 1e-8 * var[0]) for i in range(3) for j in range(3)]
    return spark.createDataFrame(rows, "i int, j int, ok boolean")


@register("d14_outlier_rows", """
SELECT count(*) AS rows_in, true AS cut_is_5_percent, true AS untouched FROM lineitem""")
def _d14(spark, sf):
    """Rows in; 5 % cut; kept rows equal their originals, bigints beyond 2^53 with gaps included."""
    li = V.lineitem_keyed(spark, sf).withColumn("big", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey") + F.lit((1 << 60) + 1)))
    kept, removed = outliers.remove_outliers(li, ["l_quantity", "l_extendedprice", "big"], key="row_id")
    n = li.count()
    digest = F.sum(F.xxhash64(*li.columns).cast("decimal(38,0)"))
    same = kept.agg(digest).first()[0] == li.join(kept.select("row_id"), "row_id", "left_semi").agg(digest).first()[0]
    return spark.createDataFrame([(n, abs(removed - 0.05 * n) <= 0.005 * n + 2, bool(same))], "rows_in bigint, cut_is_5_percent boolean, untouched boolean")


# ------------------------------------------------------------ models on doc_stats

_fit = prepared


@register("e4_logistic_score_equations", " UNION ALL ".join(
    f"SELECT '{t}' AS term, true AS zero FROM (SELECT count(*) FROM labels)" for t in ("non_letter", "toxic", "intercept")))
def _e4(spark, sf):
    """At the optimum sum((p - y) x_j) + w_j / C = 0, and sum(p - y) = 0."""
    cols, C = ["non_letter", "toxic"], 0.5
    df = VectorAssembler(inputCols=cols, outputCol="features").transform(V.doc_stats(spark, sf).withColumn("label", F.col("quality").cast("double"))).cache()
    n = df.count()
    model = make_model("classification", "Logistic Regression", FitContext(n_rows=n), C=C).setTol(1e-10).fit(df)
    out = model.transform(df).withColumn("e", vector_to_array("probability")[1] - F.col("label"))
    g = out.agg(*[F.sum(F.col("e") * F.col(c)).alias(c) for c in cols], F.sum("e").alias("intercept")).first()
    df.unpersist()
    w = {c: float(model.coefficients[j]) / C for j, c in enumerate(cols)}
    return spark.createDataFrame([(t, abs(g[t] + w.get(t, 0.0)) < 1e-3 * n) for t in (*cols, "intercept")], "term string, zero boolean")


@register("e_classifiers_beat_the_majority", " UNION ALL ".join(
    f"SELECT '{m}' AS model, true AS fits FROM (SELECT count(*) FROM labels)" for m in CLASSIFIERS))
def _e_cls(spark, sf):
    """Every classifier's accuracy on the (balanced) training part is that of its majority at least."""
    fr = _fit(spark, sf)
    majority = fr.train.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    rows = []
    for name in CLASSIFIERS:
        model = fit_model(fr, name)
        pred = model.transform(fr.train).select("label", F.col("prediction").cast("double").alias("prediction"))
        rows.append((name, metrics.accuracy(pred).first()[0] >= majority - 1e-9))
    return spark.createDataFrame(rows, "model string, fits boolean")


@register("e_regressors_beat_the_mean", " UNION ALL ".join(
    f"SELECT '{m}' AS model, true AS fits FROM (SELECT count(*) FROM labels)" for m in REGRESSORS))
def _e_reg(spark, sf):
    """Every regressor's squared error on the training part is below that of a constant (SVR: its own loss,
    the squared distance beyond the tube)."""
    fr = _fit(spark, sf, "n_chars")
    rows = []
    for name in REGRESSORS:
        pred = fit_model(fr, name).transform(fr.train)
        e = F.col("label") - F.col("prediction")
        mid = fr.train.agg(F.avg("label")).first()[0]
        c = F.col("label") - F.lit(mid)
        loss = (lambda x: F.greatest(F.abs(x) - 0.1, F.lit(0.0)) ** 2) if name == "SVR" else (lambda x: x ** 2)
        got, flat = pred.agg(F.sum(loss(e)), F.sum(loss(c))).first()
        rows.append((name, got <= flat * (1 + 1e-9)))
    return spark.createDataFrame(rows, "model string, fits boolean")


@register("e2_multiclass_probability", f"SELECT {LINEITEM_KEY} AS row_id, true AS sums_to_one, true AS top_is_predicted FROM lineitem")
def _e2m(spark, sf):
    """Three classes: probabilities sum to 1 and the largest one is the prediction."""
    li = V.lineitem_keyed(spark, sf)
    df = VectorAssembler(inputCols=_LI4, outputCol="features").transform(
        li.withColumn("label", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)))
    model = make_model("classification", "LightGBM", FitContext(n_rows=1, n_classes=3), n_estimators=3).fit(df)
    p = vector_to_array("probability")
    return model.transform(df).select("row_id", (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
                                      (p[F.col("prediction").cast("int")] >= F.array_max(p) - 1e-12).alias("top_is_predicted"))


_NOISY_ORDERS = f"""SELECT o_orderkey, o_totalprice / 100000.0 AS price, (o_orderkey % 7) / 7.0 AS other,
  CASE WHEN {sql_md5_bucket("o_orderkey")} % 10 < 2 THEN {sql_md5_bucket("o_orderkey")} % 3
       WHEN o_totalprice < 90000 THEN 0 WHEN o_totalprice < 180000 THEN 1 ELSE 2 END AS label,
  {sql_seeded_bucket(3, "o_orderkey")} % 10 < 3 AS held FROM orders"""


@register("e5_three_classes_less_loss", f"""
SELECT label, count(*) AS n, true AS sums_to_one, true AS less_loss_than_shares
FROM ({_NOISY_ORDERS}) WHERE held GROUP BY label""")
def _e5c(spark, sf):
    """Three price classes, a fifth of them drawn anew, on orders set aside: probabilities sum to 1, and the log loss
    is under three quarters of that of the class shares.  (Calibration: ``tests/test_pairwise.py``.)"""
    each = noisy_orders_scored(spark, sf)
    classes = each.groupBy("label").agg(F.count("*").alias("n"), F.sum("loss").alias("loss"), F.max(F.abs(F.col("total") - 1)).alias("gap"))
    whole = classes.agg(F.sum("n").alias("all"), F.sum("loss").alias("whole_loss"), F.collect_list("n").alias("sizes"))
    shares = F.aggregate("sizes", F.lit(0.0), lambda a, x: a - x * F.log(x / F.col("all")))
    return (classes.crossJoin(F.broadcast(whole))
            .select("label", "n", (F.col("gap") < 1e-9).alias("sums_to_one"), (F.col("whole_loss") < 0.75 * shares).alias("less_loss_than_shares")))


def noisy_orders_scored(spark, sf):
    """The orders set aside, with the probabilities ``p`` of an SVC of the others, their sum and the log loss."""
    orders = tables.read_table(spark, f"{sf}/orders.parquet")
    bucket, price = md5_bucket(F.col("o_orderkey")), F.col("o_totalprice")
    df = VectorAssembler(inputCols=["price", "other"], outputCol="features").transform(orders.select(
        (price / 100000.0).alias("price"), (F.col("o_orderkey") % 7 / 7.0).alias("other"),
        F.when(bucket % 10 < 2, bucket % 3).when(price < 90000, 0).when(price < 180000, 1).otherwise(2).cast("double").alias("label"),
        (seeded_bucket(3, F.col("o_orderkey")) % 10 < 3).alias("held")))
    model = make_model("classification", "SVC", FitContext(n_rows=1, n_classes=3)).fit(df.where("NOT held"))
    return model.transform(df.where("held")).select(F.col("label").cast("long").alias("label"), vector_to_array("probability").alias("p")).select(
        "label", "p", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), (-F.log(F.col("p")[F.col("label").cast("int")])).alias("loss"))


@register("f2_f3_folds_share_no_key", "SELECT 0::BIGINT AS keys_in_two_folds, true AS all_folds FROM (SELECT count(*) FROM labels)")
def _folds(spark, sf):
    fr = _fit(spark, sf)
    k = fold_count(fr)
    folded = assigned_folds(fr, k)
    per_key = folded.groupBy("_row_id").agg(F.count_distinct("fold").alias("n"))
    return per_key.agg(F.sum((F.col("n") > 1).cast("long")).alias("keys_in_two_folds")).withColumn(
        "all_folds", F.lit(folded.select("fold").distinct().count() == k))


@register("f5_every_model_without_error", " UNION ALL ".join(
    f"SELECT '{m}' AS model, '' AS error FROM (SELECT count(*) FROM labels)" for m in CLASSIFIERS))
def _f5e(spark, sf):
    board, errors = compare_models(_fit(spark, sf))
    done = {x["model"] for x in board.collect()}
    return spark.createDataFrame([(m, errors.get(m, "" if m in done else "missing")) for m in CLASSIFIERS], "model string, error string")


@register("f6_best_of_a_leaderboard", f"""
SELECT position, model, accuracy FROM (
  SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS position, p_brand AS model, {r('avg(p_size) / 50')} AS accuracy
  FROM part GROUP BY p_brand) ORDER BY accuracy DESC, position LIMIT 1""")
def _f6b(spark, sf):
    from pyspark.sql import Window
    board = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("model")).agg((F.avg("p_size") / 50).alias("accuracy"))
    board = rounded(board).withColumn("position", F.row_number().over(Window.orderBy("model")))
    return best_model(board).select("position", "model", "accuracy")


@register("g11_importances_sum_to_one", "SELECT true AS sums_to_one, true AS none_negative FROM (SELECT count(*) FROM labels)")
def _g11s(spark, sf):
    fr = _fit(spark, sf)
    imp = metrics.feature_importance(fit_model(fr, "Random Forest"), fr.feature_names, top=10**6, spark=spark)
    return imp.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), (F.min("importance") >= 0).alias("none_negative"))


@register("h2_tree_shap_adds_up", "SELECT true AS adds_up, true AS every_test_row FROM (SELECT count(*) FROM labels)")
def _h2a(spark, sf):
    """Base + sum of phi = the forest's probability, for every class and every test row."""
    fr = _fit(spark, sf)
    model = fit_model(fr, "Random Forest")
    phi, base = X.tree_shap(model, fr.test, fr.feature_names)
    b = F.array(*[F.lit(float(x)) for x in base])
    total = phi.groupBy("row_id", "class").agg(F.sum("phi").alias("s"))
    p = model.transform(fr.test).select(F.col("_row_id").cast("string").alias("row_id"), vector_to_array("probability").alias("p"))
    off = total.join(p, "row_id").withColumn("off", F.abs(F.col("s") + b[F.col("class")] - F.col("p")[F.col("class")]))
    n = fr.test.count() * len(base)
    return off.agg((F.max("off") < 1e-6).alias("adds_up"), (F.count("*") == n).alias("every_test_row"))


@register("h4_kernel_shap_adds_up", "SELECT true AS adds_up, true AS every_row FROM (SELECT count(*) FROM labels)")
def _h4a(spark, sf):
    fr = _fit(spark, sf)
    model = fit_model(fr, "Logistic Regression")
    rows = X.explain_sample_vectors(fr.test, "_row_id", 1000, 42)
    background = X.explain_sample_vectors(fr.train, "_row_id", 100, 7)
    phi, base = X.kernel_shap(model, rows, background, fr.feature_names, output="probability")
    p = model.transform(rows).select(F.col("_row_id").cast("string").alias("row_id"), vector_to_array("probability")[1].alias("p"))
    off = phi.groupBy("row_id").agg(F.sum("phi").alias("s")).join(p, "row_id").withColumn("off", F.abs(F.col("s") + F.lit(base) - F.col("p")))
    return off.agg((F.max("off") < 1e-6).alias("adds_up"), (F.count("*") == rows.count()).alias("every_row"))


# ---------------------------------------------------- A13, I2, I3: scoring with gaps

def _gaps(spark, sf):
    return V.doc_stats(spark, sf).withColumn("n_words", F.when(F.col("doc_id") % 7 != 0, F.col("n_words")))


def _bundle(spark, sf, model="Gaussian Naive Bayes"):
    fr = prepare(_gaps(spark, sf), target="quality", key="doc_id")
    return ScoringBundle.from_fit(fr, full_pipeline(fr, fit_model(fr, model)))


def _scored(bundle, rows):
    return score(bundle, rows, passthrough=["doc_id"]).select("doc_id", "prediction")


def _same(a, b):
    return a.join(b.withColumnRenamed("prediction", "other"), "doc_id", "full").select(
        "doc_id", (F.col("prediction") == F.col("other")).alias("same"))


_ALL_SAME = with_views(["doc_stats"], "SELECT doc_id, true AS same FROM doc_stats")


@register("a13_loaded_bundle_scores_the_same", _ALL_SAME)
def _a13l(spark, sf):
    """A saved bundle stands alone: the table its imputer was fitted on is out of reach when it is loaded."""
    bundle, rows = _bundle(spark, sf), _gaps(spark, sf).drop("quality")
    path, direct = _scratch(spark, "bundle"), _scratch(spark, "direct")
    _scored(bundle, rows).write.parquet(direct)
    save_bundle(bundle, path)
    for stage in bundle.pipeline.stages:
        if hasattr(stage, "donorPath"):
            stage._set(donorPath=_scratch(spark, "gone"))
    return _same(spark.read.parquet(direct), _scored(load_bundle(spark, path), rows))


@register("i2_scored_as_the_target_was", with_views(["doc_stats"], "SELECT doc_id, true AS is_class FROM doc_stats"))
def _i2c(spark, sf):
    """The prediction has the target's own type and is one of its classes."""
    out = _scored(_bundle(spark, sf), _gaps(spark, sf).drop("quality"))
    typed = out.schema["prediction"].dataType == V.table(spark, sf, "labels").schema["quality"].dataType
    return out.select("doc_id", (F.col("prediction").isin(0, 1) & F.lit(typed)).alias("is_class"))


@register("i3_stream_equals_batch", _ALL_SAME)
def _i3(spark, sf):
    from tabml.streaming.score_stream import file_stream, score_stream_batches
    bundle, rows = _bundle(spark, sf), _gaps(spark, sf).drop("quality")
    source, out = _scratch(spark, "stream-in"), _scratch(spark, "stream-out")
    rows.repartition(4, "doc_id").write.parquet(source)
    score_stream_batches(bundle, file_stream(spark, source, rows.schema), out, _scratch(spark, "stream-state"), passthrough=["doc_id"]).awaitTermination()
    return _same(spark.read.parquet(out).select("doc_id", "prediction"), _scored(bundle, rows))
