"""Shared helpers for the query registry and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (engines sum in different orders, so the
    last bits differ); normalise -0.0 to 0.0."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append((F.round(F.col(f"`{f.name}`").cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL side of ``rounded`` for one expression."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# DuckDB forms of the hash draws in tabml.functions.hashing
def sql_md5_bucket(expr: str) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def sql_seeded_bucket(seed: int, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def sql_seeded_hash60(seed: int, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 15))::BIGINT"


LINEITEM_KEY = ("CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || "
                "CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)")

# Derived views (FIXTURES.md section 2) as DuckDB CTE bodies.
VIEW_SQL = {
    "orders_dup": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0",
    "orders_null": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, "
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
        "o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority "
        "FROM orders"),
    "part_null": (
        "SELECT p_partkey, p_name, p_brand, p_type, "
        "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p_size, "
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice "
        "FROM part"),
    "pred_class": (
        f"SELECT {LINEITEM_KEY} AS row_id, l_returnflag AS label, "
        f"CASE WHEN {sql_md5_bucket(LINEITEM_KEY)} % 10 < 2 THEN 'N' ELSE l_returnflag END AS prediction "
        "FROM lineitem"),
    "pred_binary": (
        f"SELECT doc_id, toxic AS label, ({sql_md5_bucket('doc_id')} % 100) / 100.0 + 0.2 * toxic AS score "
        "FROM labels"),
    "pred_value": (
        f"SELECT {LINEITEM_KEY} AS row_id, l_extendedprice AS label, 1500.0 * l_quantity AS prediction "
        "FROM lineitem"),
    "doc_stats": (
        "SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, "
        "CAST(len(string_split(d.text, ' ')) AS BIGINT) AS n_words, "
        "length(regexp_replace(d.text, '[A-Za-z ]', '', 'g')) / (1 + length(d.text)) AS non_letter "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "doc_label": (
        "SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id"),
    "lineitem_keyed": f"SELECT *, {LINEITEM_KEY} AS row_id FROM lineitem",
}


def with_views(names, body: str, ctes=()) -> str:
    """``names``: derived views to define; ``ctes``: extra (name, sql) pairs."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
