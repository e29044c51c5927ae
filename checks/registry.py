"""Registered queries (one per SURVEY section 2 operator) and their DuckDB oracle.

Every query reads the driver's whole tables (or views Spark derives from
them) and calls the library operator; the SQL next to it states the same
result independently.  Floating columns are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabml.operators import clean, explore, features, metrics, rows, target
from tabml.plans import views as V
from tabml.sources import tables

from .common import (LINEITEM_KEY, r, rounded, sql_seeded_bucket, sql_seeded_hash60,
                     with_views)

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- A: sources

@register("a2_read_parquet", "SELECT * FROM customer")
def _a2(spark, sf):
    return tables.read_table(spark, f"{sf}/customer.parquet")


@register("a8_read_sql", """
SELECT c.c_custkey, c.c_name, n.n_name, r.r_name, c.c_acctbal,
       count(o.o_orderkey) AS n_orders
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
WHERE c.c_acctbal > 0
GROUP BY c.c_custkey, c.c_name, n.n_name, r.r_name, c.c_acctbal""")
def _a8(spark, sf):
    names = ["customer", "nation", "region", "orders"]
    return tables.read_sql(spark, {n: V.table(spark, sf, n) for n in names}, """
        SELECT c.c_custkey, c.c_name, n.n_name, r.r_name, c.c_acctbal,
               count(o.o_orderkey) AS n_orders
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey
        WHERE c.c_acctbal > 0
        GROUP BY c.c_custkey, c.c_name, n.n_name, r.r_name, c.c_acctbal""")


@register("a10_drop_duplicates", with_views(["orders_dup"], "SELECT DISTINCT * FROM orders_dup"))
def _a10(spark, sf):
    return clean.drop_duplicate_rows(V.orders_dup(spark, sf), count_removed=False)[0]


@register("a10_duplicate_report", with_views(["orders_dup"], """
SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS BIGINT) AS distinct_rows,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS BIGINT) AS removed
FROM orders_dup"""))
def _a10r(spark, sf):
    return clean.duplicate_report(V.orders_dup(spark, sf))


@register("a12_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def _a12(spark, sf):
    return clean.preview(V.table(spark, sf, "customer"), "c_custkey", 5)


# ------------------------------------------------------------- B: exploring

_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORD_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]


@register("b1_column_summary", with_views(["orders_null"], " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null "
    f"FROM orders_null" for i, (c, t) in enumerate(zip(_ORD_COLS, _ORD_TYPES)))))
def _b1(spark, sf):
    return explore.column_summary(V.orders_null(spark, sf))


@register("b2_missing_values", with_views(["orders_null"], " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS missing FROM orders_null"
    for c in _ORD_COLS)))
def _b2(spark, sf):
    return explore.missing_values(V.orders_null(spark, sf))


def _hist_sql(cols, bins=30):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column, bin, {r(f"lo + bin * (hi - lo) / {bins}")} AS lo,
       {r(f"lo + (bin + 1) * (hi - lo) / {bins}")} AS hi, CAST(count(*) AS BIGINT) AS n
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0
             ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin, lo, hi
      FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem WHERE {c} IS NOT NULL),
           (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM lineitem))
GROUP BY bin, lo, hi""")
    return " UNION ALL ".join(parts)


@register("b3_histograms", _hist_sql(LI_NUM))
def _b3(spark, sf):
    return rounded(explore.histograms(V.table(spark, sf, "lineitem"), LI_NUM, bins=30))


def _box_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column, {r('mn')} AS min, {r('q1')} AS q1, {r('med')} AS median, {r('q3')} AS q3,
       {r('mx')} AS max,
       {r(f"(SELECT min({c}) FROM lineitem WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))")} AS whisker_lo,
       {r(f"(SELECT max({c}) FROM lineitem WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))")} AS whisker_hi,
       (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT min({c}) AS mn, max({c}) AS mx, quantile_cont({c}, 0.25) AS q1,
             quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""")
    return " UNION ALL ".join(parts)


@register("b4_box_stats", _box_sql(LI_NUM))
def _b4(spark, sf):
    return rounded(explore.box_stats(V.table(spark, sf, "lineitem"), LI_NUM, approx=False))


def _corr_sql(cols, src="lineitem"):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"{r(f'CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END')} AS r "
                         f"FROM {src}")
    return " UNION ALL ".join(parts)


@register("b5_correlation_matrix", _corr_sql(LI_NUM + ["l_linenumber"]))
def _b5(spark, sf):
    return rounded(explore.correlation_matrix(V.table(spark, sf, "lineitem"), LI_NUM + ["l_linenumber"]))


@register("b6a_profile_overview", with_views(["orders_dup"], """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dup)) AS BIGINT) AS duplicate_rows,
       CAST(3 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical,
       CAST(1 AS BIGINT) AS n_datetime, CAST(0 AS BIGINT) AS n_other
FROM orders_dup"""))
def _b6a(spark, sf):
    return explore.profile_overview(V.orders_dup(spark, sf))


@register("b6a_profile_overview_nulls", with_views(["orders_null"], """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns,
       CAST(sum((o_totalprice IS NULL)::INT) + sum((o_orderpriority IS NULL)::INT) AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_null)) AS BIGINT) AS duplicate_rows,
       CAST(3 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_categorical,
       CAST(1 AS BIGINT) AS n_datetime, CAST(0 AS BIGINT) AS n_other
FROM orders_null"""))
def _b6an(spark, sf):
    return explore.profile_overview(V.orders_null(spark, sf))


def _profile_num_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS column, CAST(count(DISTINCT {x}) AS BIGINT) AS distinct,
       CAST(count(*) - count({x}) AS BIGINT) AS missing,
       {r(f'avg({x})', 7)} AS mean, {r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS min,
       {r(f'quantile_cont({x}, 0.05)')} AS p05, {r(f'quantile_cont({x}, 0.25)')} AS q1,
       {r(f'quantile_cont({x}, 0.5)')} AS median, {r(f'quantile_cont({x}, 0.75)')} AS q3,
       {r(f'quantile_cont({x}, 0.95)')} AS p95, {r(f'max({x})')} AS max,
       CAST(sum(({x} = 0)::INT) AS BIGINT) AS zeros, CAST(sum(({x} < 0)::INT) AS BIGINT) AS negatives,
       {r(f'(SELECT avg(power({x} - m.mu, 3)) / power(avg(power({x} - m.mu, 2)), 1.5) FROM lineitem, (SELECT avg({x}) AS mu FROM lineitem) m)')} AS skewness,
       {r(f'(SELECT avg(power({x} - m.mu, 4)) / power(avg(power({x} - m.mu, 2)), 2) - 3 FROM lineitem, (SELECT avg({x}) AS mu FROM lineitem) m)')} AS kurtosis
FROM lineitem""")
    return " UNION ALL ".join(parts)


@register("b6b_profile_numeric", _profile_num_sql(LI_NUM + ["l_linenumber"]))
def _b6b(spark, sf):
    # the mean to 7 digits: at 6 the mean of l_discount is a tie that sums in another order break
    out = explore.profile_numeric(V.table(spark, sf, "lineitem"), LI_NUM + ["l_linenumber"])
    mean = F.round("mean", 7) + F.lit(0.0)
    return rounded(out.withColumn("m7", mean.cast("string"))).withColumn("mean", F.col("m7").cast("double")).drop("m7")


def _profile_cat_sql():
    parts = []
    for c, is_text in (("o_orderstatus", True), ("o_orderpriority", True), ("o_orderdate", False)):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""
SELECT '{c}' AS column,
       (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM orders_null) AS distinct,
       (SELECT CAST(count(*) - count({c}) AS BIGINT) FROM orders_null) AS missing,
       (SELECT v FROM (SELECT {v} AS v, count(*) AS n FROM orders_null WHERE {c} IS NOT NULL GROUP BY 1)
        ORDER BY n DESC, v LIMIT 1) AS top,
       (SELECT CAST(max(n) AS BIGINT) FROM (SELECT count(*) AS n FROM orders_null WHERE {c} IS NOT NULL GROUP BY {c})) AS top_freq,
       {f"(SELECT CAST(min(length({c})) AS BIGINT) FROM orders_null)" if is_text else "CAST(NULL AS BIGINT)"} AS min_len,
       {f"(SELECT CAST(max(length({c})) AS BIGINT) FROM orders_null)" if is_text else "CAST(NULL AS BIGINT)"} AS max_len,
       {"CAST(NULL AS VARCHAR)" if is_text else f"(SELECT min({v}) FROM orders_null)"} AS min_value,
       {"CAST(NULL AS VARCHAR)" if is_text else f"(SELECT max({v}) FROM orders_null)"} AS max_value""")
    return with_views(["orders_null"], " UNION ALL ".join(parts))


@register("b6c_profile_categorical", _profile_cat_sql())
def _b6c(spark, sf):
    return explore.profile_categorical(V.orders_null(spark, sf))


# ------------------------------------------------------------- C: the target

def _task_sql(tbl, col, numeric):
    rule = ("'classification'" if not numeric else
            "CASE WHEN count(DISTINCT {c}) > count(*) * 0.2 THEN 'regression' "
            "WHEN count(DISTINCT {c}) <= 10 THEN 'classification' ELSE 'regression' END".format(c=col))
    return (f"SELECT '{col}' AS target, CAST(count(*) AS BIGINT) AS n, "
            f"CAST(count(DISTINCT {col}) AS BIGINT) AS n_distinct, {str(numeric).upper()} AS is_numeric, "
            f"{rule} AS task FROM {tbl}")


_TASKS = [("orders", "o_totalprice", True), ("lineitem", "l_linenumber", True),
          ("lineitem", "l_quantity", True), ("customer", "c_mktsegment", False),
          ("labels", "toxic", True)]


@register("c1_task_type", " UNION ALL ".join(_task_sql(*t) for t in _TASKS))
def _c1(spark, sf):
    out = None
    for tbl, col, _ in _TASKS:
        t = target.task_stats(V.table(spark, sf, tbl), col)
        out = t if out is None else out.unionByName(t)
    return out


@register("c3_impute_mode", with_views(["orders_null"], """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       coalesce(o_orderpriority, (SELECT o_orderpriority FROM orders_null WHERE o_orderpriority IS NOT NULL
                                  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority
FROM orders_null"""))
def _c3(spark, sf):
    return target.impute_target(V.orders_null(spark, sf), "o_orderpriority", "mode")


@register("c4_impute_median", with_views(["orders_null"], f"""
SELECT o_orderkey, o_custkey, o_orderstatus,
       {r("coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_null))")} AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders_null"""))
def _c4(spark, sf):
    return rounded(target.impute_target(V.orders_null(spark, sf), "o_totalprice", "median"))


@register("c5_encode_label", f"""
SELECT {LINEITEM_KEY} AS row_id, l_returnflag,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS label
FROM lineitem""")
def _c5(spark, sf):
    li = V.lineitem_keyed(spark, sf).select("row_id", "l_returnflag")
    return target.encode_label_table(li, "l_returnflag", "label")


@register("c5_encode_numeric_label", """
SELECT doc_id, quality, CAST(dense_rank() OVER (ORDER BY quality) - 1 AS BIGINT) AS label FROM labels""")
def _c5n(spark, sf):
    return target.encode_label_table(V.table(spark, sf, "labels").select("doc_id", "quality"), "quality", "label")


def _id_sql(tbl, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
        f"CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT {c}) = count(*) AS dropped FROM {tbl}"
        for c in cols)


@register("c6_id_columns", _id_sql("documents", ["doc_id"]) + " UNION ALL " +
          _id_sql("events", ["event_id", "user_id"]))
def _c6(spark, sf):
    return target.id_column_report(V.table(spark, sf, "documents")).unionByName(
        target.id_column_report(V.table(spark, sf, "events")))


@register("c6_drop_id_columns", "SELECT ts, user_id, event_type, value, props FROM events")
def _c6d(spark, sf):
    return target.drop_id_columns(V.table(spark, sf, "events"))[0]


@register("c9_input_defaults", with_views(["orders_null"], """
SELECT 'o_orderkey' AS column, 'num' AS kind, CAST(coalesce(quantile_cont(CAST(o_orderkey AS DOUBLE), 0.5), 0.0) AS VARCHAR) AS "default" FROM orders_null
UNION ALL SELECT 'o_totalprice', 'num', CAST(round(coalesce(quantile_cont(o_totalprice, 0.5), 0.0), 4) AS VARCHAR) FROM orders_null
UNION ALL SELECT 'o_orderstatus', 'str', (SELECT o_orderstatus FROM orders_null WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'o_orderpriority', 'str', (SELECT o_orderpriority FROM orders_null WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'o_orderdate', 'dt', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders_null"""))
def _c9(spark, sf):
    df = V.orders_null(spark, sf).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                                         "o_orderdate")
    out = target.infer_input_defaults(df)
    # text of a double differs between engines: compare the price at 4 decimals
    return out.withColumn("default", F.when(
        F.col("column") == "o_totalprice", F.round(F.col("default").cast("double"), 4).cast("string"))
        .otherwise(F.col("default")))


# ------------------------------------------------------- D: features, rows

def _dt_sql(col):
    return (f"CAST(year({col}) AS INTEGER) AS {col}_year, CAST(month({col}) AS INTEGER) AS {col}_month, "
            f"CAST(day({col}) AS INTEGER) AS {col}_day, CAST(isodow({col}) - 1 AS INTEGER) AS {col}_dayofweek, "
            f"CAST(dayofyear({col}) AS INTEGER) AS {col}_dayofyear, CAST(week({col}) AS INTEGER) AS {col}_weekofyear, "
            f"CAST(quarter({col}) AS INTEGER) AS {col}_quarter, "
            f"CAST(day({col}) = 1 AS INTEGER) AS {col}_is_month_start, "
            f"CAST(CAST({col} AS DATE) = last_day({col}) AS INTEGER) AS {col}_is_month_end, "
            f"CAST(hour({col}) AS INTEGER) AS {col}_hour, CAST(minute({col}) AS INTEGER) AS {col}_minute")


@register("d1_datetime_features_events", f"SELECT event_id, user_id, event_type, value, props, {_dt_sql('ts')} FROM events")
def _d1(spark, sf):
    return features.datetime_features(V.table(spark, sf, "events"))


@register("d1_datetime_features_orders", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_dt_sql('o_orderdate')}, o_orderpriority FROM orders""")
def _d1o(spark, sf):
    return features.datetime_features(V.table(spark, sf, "orders"))


_POLY = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql():
    terms = [f"{r(c)} AS {c}" for c in _POLY]
    for i, a in enumerate(_POLY):
        for b in _POLY[i:]:
            name = f"{a}_pow2" if a == b else f"{a}_x_{b}"
            terms.append(f"{r(f'{a} * {b}')} AS {name}")
    return f"SELECT {LINEITEM_KEY} AS row_id, {', '.join(terms)} FROM lineitem"


@register("d4_polynomial_features", _poly_sql())
def _d4(spark, sf):
    li = V.lineitem_keyed(spark, sf).select("row_id", *_POLY)
    return rounded(features.polynomial_features(li, _POLY))


@register("d5_standard_scale", f"""
SELECT {LINEITEM_KEY} AS row_id, {', '.join(
    f"{r(f'({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM lineitem)')} AS {c}"
    for c in LI_NUM)} FROM lineitem""")
def _d5(spark, sf):
    li = V.lineitem_keyed(spark, sf).select("row_id", *LI_NUM)
    return rounded(features.standard_scale(li, LI_NUM))


_DS_NUM = ["toxic", "n_chars", "n_words", "non_letter"]


def _fclassif_sql(src, cols, label):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS feature, (ssb / (k - 1)) / (ssw / (n - k)) AS score
FROM (SELECT sum(g.ni * (g.mi - gm.m) ^ 2) AS ssb, sum(g.ssi) AS ssw, count(*) AS k, sum(g.ni) AS n
      FROM (SELECT t.{label}, count(t.{c}) AS ni, avg(t.{c}) AS mi, sum((t.{c} - cm.m) ^ 2) AS ssi
            FROM {src} t JOIN (SELECT {label}, avg({c}) AS m FROM {src} WHERE {c} IS NOT NULL GROUP BY {label}) cm
              ON t.{label} = cm.{label}
            WHERE t.{c} IS NOT NULL GROUP BY t.{label}) g,
           (SELECT avg({c}) AS m FROM {src} WHERE {c} IS NOT NULL) gm)""")
    body = " UNION ALL ".join(parts)
    return (f"SELECT feature, {r('score', 4)} AS score, "
            f"CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS INTEGER) AS rank "
            f"FROM ({body})")


@register("d6_f_classif", with_views(["doc_stats"], _fclassif_sql("doc_stats", _DS_NUM, "quality")))
def _d6(spark, sf):
    return rounded(features.f_classif_scores(V.doc_stats(spark, sf), _DS_NUM, "quality"), 4)


@register("d6_f_classif_lineitem", _fclassif_sql("lineitem", LI_NUM, "l_returnflag"))
def _d6l(spark, sf):
    return rounded(features.f_classif_scores(V.table(spark, sf, "lineitem"), LI_NUM, "l_returnflag"), 4)


def _freg_sql(src, cols, label):
    body = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, {label}) ^ 2 / (1 - corr({c}, {label}) ^ 2) * "
        f"(count({c}) - 2) AS score FROM {src} WHERE {label} IS NOT NULL" for c in cols)
    return (f"SELECT feature, {r('score', 4)} AS score, "
            f"CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS INTEGER) AS rank FROM ({body})")


_DS_REG = ["quality", "toxic", "n_words", "non_letter"]


@register("d7_f_regression", with_views(["doc_stats"], _freg_sql("doc_stats", _DS_REG, "n_chars")))
def _d7(spark, sf):
    return rounded(features.f_regression_scores(V.doc_stats(spark, sf), _DS_REG, "n_chars"), 4)


@register("d8_covariance_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'covar_pop({a}, {b})', 4)} AS cov FROM lineitem"
    for a in LI_NUM for b in LI_NUM))
def _d8(spark, sf):
    return rounded(features.covariance_matrix(V.table(spark, sf, "lineitem"), LI_NUM), 4)


def _ohe_sql():
    cats = {"o_orderstatus": ["F", "O", "P"],
            "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "__missing__"]}
    cols = []
    for c, vals in cats.items():
        for v in vals:
            cols.append(f"CAST(coalesce({c}, '__missing__') = '{v}' AS INTEGER) AS \"{c}_{v}\"")
    return with_views(["orders_null"],
                      f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, {', '.join(cols)} FROM orders_null")


@register("d9_one_hot", _ohe_sql())
def _d9(spark, sf):
    return features.one_hot_columns(V.orders_null(spark, sf), ["o_orderstatus", "o_orderpriority"])


@register("d13_rows_with_missing", with_views(["orders_null"], """
SELECT * FROM orders_null WHERE o_totalprice IS NULL OR o_orderpriority IS NULL"""))
def _d13(spark, sf):
    return features.rows_with_missing(V.orders_null(spark, sf))


@register("d15_upsample_minority", with_views([], f"""
SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0
UNION ALL
SELECT m.doc_id, m.quality, m.toxic
FROM (SELECT unnest(range((SELECT count(*) FROM labels WHERE toxic = 0))) AS i) d
JOIN (SELECT doc_id, quality, toxic,
             row_number() OVER (ORDER BY {sql_seeded_hash60(42, 'doc_id')}) - 1 AS pos
      FROM labels WHERE toxic = 1) m
  ON m.pos = {sql_seeded_bucket(42, 'd.i')} % (SELECT count(*) FROM labels WHERE toxic = 1)"""))
def _d15(spark, sf):
    return rows.upsample_minority(V.table(spark, sf, "labels"), "toxic", "doc_id", seed=42)[0]


@register("d16_split_stratified", f"""
SELECT doc_id, quality, toxic, rk < ceil(n * 0.3) AS is_test
FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {sql_seeded_hash60(42, 'doc_id')}) - 1 AS rk,
             count(*) OVER (PARTITION BY toxic) AS n FROM labels)""")
def _d16(spark, sf):
    return rows.train_test_split(V.table(spark, sf, "labels"), "doc_id", 0.3, 42, stratify="toxic")


@register("d16_split_plain", f"""
SELECT row_id, l_returnflag, rk < ceil(n * 0.3) AS is_test
FROM (SELECT {LINEITEM_KEY} AS row_id, l_returnflag,
             row_number() OVER (ORDER BY {sql_seeded_hash60(42, LINEITEM_KEY)}) - 1 AS rk,
             count(*) OVER () AS n FROM lineitem)""")
def _d16p(spark, sf):
    li = V.lineitem_keyed(spark, sf).select("row_id", "l_returnflag")
    return rows.train_test_split(li, "row_id", 0.3, 42)


@register("f4_folds_stratified", f"""
SELECT doc_id, quality, toxic,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {sql_seeded_hash60(7, 'doc_id')}) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def _f4s(spark, sf):
    return rows.assign_folds(V.table(spark, sf, "labels"), "doc_id", 5, seed=7, stratify="quality")


@register("f4_folds_hash", f"""
SELECT {LINEITEM_KEY} AS row_id, l_extendedprice, CAST({sql_seeded_bucket(7, LINEITEM_KEY)} % 5 AS INTEGER) AS fold
FROM lineitem""")
def _f4h(spark, sf):
    li = V.lineitem_keyed(spark, sf).select("row_id", "l_extendedprice")
    return rows.assign_folds(li, "row_id", 5, seed=7)


# ------------------------------------------------------------ G: evaluation

@register("g1_accuracy", with_views(["pred_class"],
                                    f"SELECT {r('avg(CAST(label = prediction AS DOUBLE))')} AS accuracy FROM pred_class"))
def _g1(spark, sf):
    return rounded(metrics.accuracy(V.pred_class(spark, sf)))


_PER_CLASS = """
cells AS (SELECT label AS y, prediction AS p, count(*) AS n FROM pred_class GROUP BY 1, 2),
classes AS (SELECT y AS c FROM cells UNION SELECT p FROM cells),
pc AS (SELECT c AS class,
              coalesce((SELECT sum(n) FROM cells WHERE y = c AND p = c), 0) AS tp,
              coalesce((SELECT sum(n) FROM cells WHERE p = c), 0) - coalesce((SELECT sum(n) FROM cells WHERE y = c AND p = c), 0) AS fp,
              coalesce((SELECT sum(n) FROM cells WHERE y = c), 0) - coalesce((SELECT sum(n) FROM cells WHERE y = c AND p = c), 0) AS fn,
              coalesce((SELECT sum(n) FROM cells WHERE y = c), 0) AS support
       FROM classes),
sc AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
                 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM sc)"""


def _pc(body):
    return "WITH pred_class AS (" + __import__("checks.common", fromlist=["VIEW_SQL"]).VIEW_SQL["pred_class"] + \
        ")," + _PER_CLASS + "\n" + body


@register("g2_f1_weighted", _pc(f"SELECT {r('sum(f1 * support) / sum(support)')} AS f1_weighted FROM f"))
def _g2(spark, sf):
    return rounded(metrics.f1_weighted(V.pred_class(spark, sf)))


@register("g4_classification_report", _pc(f"""
SELECT class, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1,
       CAST(support AS BIGINT) AS support, 0 AS _order FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {r('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT), 1 FROM f
UNION ALL SELECT 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, CAST(sum(support) AS BIGINT), 2 FROM f
UNION ALL SELECT 'weighted avg', {r('sum(precision * support) / sum(support)')}, {r('sum(recall * support) / sum(support)')},
                 {r('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT), 3 FROM f"""))
def _g4(spark, sf):
    return rounded(metrics.classification_report(V.pred_class(spark, sf)))


@register("g5_confusion_matrix", _pc("""
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(cells.n, 0) AS BIGINT) AS n
FROM classes a CROSS JOIN classes b LEFT JOIN cells ON cells.y = a.c AND cells.p = b.c"""))
def _g5(spark, sf):
    return metrics.confusion_matrix(V.pred_class(spark, sf))


@register("g3_auc_roc", with_views(["pred_binary"], f"""
SELECT {r('(sum(CASE WHEN label = 1 THEN rnk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))')} AS auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rnk FROM pred_binary)"""))
def _g3(spark, sf):
    return rounded(metrics.auc_roc(V.pred_binary(spark, sf)))


@register("g10_roc_curve", with_views(["pred_binary"], f"""
SELECT {r('s')} AS threshold,
       {r('sum(neg) OVER (ORDER BY s DESC) / (SELECT count(*) FROM pred_binary WHERE label <> 1)')} AS fpr,
       {r('sum(pos) OVER (ORDER BY s DESC) / (SELECT count(*) FROM pred_binary WHERE label = 1)')} AS tpr
FROM (SELECT CAST(score AS DOUBLE) AS s, sum(CAST(label = 1 AS INT)) AS pos, sum(CAST(label <> 1 AS INT)) AS neg
      FROM pred_binary GROUP BY 1)"""))
def _g10(spark, sf):
    return rounded(metrics.roc_curve(V.pred_binary(spark, sf)))


@register("g6_g8_regression_metrics", with_views(["pred_value"], f"""
SELECT {r('1 - sum((label - prediction) ^ 2) / sum((label - (SELECT avg(label) FROM pred_value)) ^ 2)')} AS r2,
       {r('avg((label - prediction) ^ 2)', 2)} AS mse, {r('avg(abs(label - prediction))', 4)} AS mae
FROM pred_value"""))
def _g6(spark, sf):
    out = metrics.regression_metrics(V.pred_value(spark, sf))
    return out.select(F.round("r2", 6).alias("r2"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


@register("g9_actual_vs_predicted", with_views(["pred_value"], f"""
SELECT row_id, {r('label')} AS actual, {r('prediction')} AS predicted,
       {r('(SELECT regr_slope(prediction, label) FROM pred_value)')} AS slope,
       {r('(SELECT regr_intercept(prediction, label) FROM pred_value)', 4)} AS intercept,
       {r('(SELECT regr_slope(prediction, label) FROM pred_value) * label + (SELECT regr_intercept(prediction, label) FROM pred_value)', 3)} AS fitted
FROM pred_value"""))
def _g9(spark, sf):
    out = metrics.actual_vs_predicted(V.pred_value(spark, sf), keep=["row_id"])
    return out.select("row_id", F.round("actual", 6).alias("actual"), F.round("predicted", 6).alias("predicted"),
                      F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("fitted", 3).alias("fitted"))
