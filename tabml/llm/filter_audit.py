"""Filter interaction audit: what every filter removes at every place of every order.

Each document gets a mask with one bit per failing filter; documents are counted by part and mask (at most
2^filters cells a part).  A recursive CTE starts from the empty prefix of each part and extends
prefixes by the letters they lack: a level joins the part's mask cells, carries the bits applied so far and
emits the step's metrics into the row's log.  Prefixes of all letters are the orders; their logs are the result.

The five filters (a set condition means that the document fails):

* A: under 50 words; B: distinct words under 65 % of the words; C: ``[A-Z]`` over 5 % of the code points;
* D: holds any of ``#$%&*|``; E: the same text as a document with a smaller id, anywhere in the table.

Words are maximal runs without ASCII white space, case-sensitive, compared whole (no hashes).

Scale: one pass over the texts writes a narrow row for each document (text digest, id, part, four bits); the
smallest id of each repeated text comes from partial minima and is joined back, as are the labels, so that
neither a hot source nor a hot group of copies meets in one task beyond what Spark splits.  Then there
are cells only: the recursion works on 326 prefixes a part.

Defined cases: a null text is empty, and empty texts are equal texts; a null source is the part '' (with the empty
ones); a null id fails E never and makes no other document fail it; repeated rows count each, and rows of one id and
text don't fail E by each other; labels repeated or contradicting count as good / toxic if any row says so; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored

LETTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _bits(conditions: dict):
    """The failing filters as bits, letter ``i`` of the order being bit ``i``."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"),
                       # one plain separator: Java splits at it without a regular expression
                       F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "").alias("words"))
    own = _bits({
        "A": F.size("words") < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.size("words"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > UPPER_PERCENT * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    })
    rows = stored(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), own.alias("own")), "audit-rows")
    # tables of their own, so that the joins with them can split a hot text or id
    first = stored(rows.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"), "audit-first")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    known = stored(known, "audit-labels")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(first, "same", "left").join(known, "id", "left").select(
        "part", (F.col("own") + F.when(again, F.lit(1 << 4)).otherwise(0)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def cells(masks: DataFrame) -> DataFrame:
    """One row a part: its mask cells (mask, n, good, toxic), at most 2^filters of them."""
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).groupBy(
        "part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def _total(value: str, condition: str) -> str:
    return f"aggregate(cells, 0L, (sum, c) -> sum + IF({condition}, c.{value}, 0L))"


def audit(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """All orders of ``letters`` over ``cells``: part, filter_order, step, filter and the step's metrics.
    ``shapley`` is the filter's ``removed`` summed over the orders."""
    spark = parts.sparkSession
    of = stored(parts.select("part", "cells"), "audit-cells")
    here = "(c.mask & applied) = 0 AND (c.mask & bit) <> 0"
    step = f"""struct(letter AS filter,
        {_total('n', '(c.mask & (applied | bit)) = 0')} AS kept,
        {_total('n', here)} AS removed,
        {_total('n', '(c.mask & applied) <> 0 AND (c.mask & bit) <> 0')} AS redundant,
        {_total('n', 'c.mask = bit')} AS unique_fails,
        {_total('good', here)} AS good_lost,
        {_total('toxic', here)} AS toxic_lost)"""
    each = ", ".join(f"'{x}'" for x in letters)
    bit = " ".join(f"WHEN '{x}' THEN {1 << i}" for i, x in enumerate(letters))
    metrics = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    log = f"array<struct<filter: string, {', '.join(f'{m}: bigint' for m in metrics)}>>"
    walked = spark.sql(f"""
        WITH RECURSIVE walk(part, prefix, applied, log) AS (
          SELECT part, '' AS prefix, 0 AS applied, CAST(array() AS {log}) AS log FROM {{of}}
          UNION ALL
          SELECT part, concat(prefix, letter), applied | bit, concat(log, array({step}))
          FROM (SELECT w.*, m.cells, l.letter, CASE l.letter {bit} END AS bit
                FROM walk w JOIN {{of}} m ON w.part = m.part
                LATERAL VIEW explode(filter(array({each}), x -> NOT contains(w.prefix, x))) l AS letter)
          WHERE length(prefix) < {len(letters)})
        SELECT part, prefix AS filter_order, CAST(place + 1 AS INT) AS step, s.*
        FROM walk LATERAL VIEW posexplode(log) e AS place, s WHERE length(prefix) = {len(letters)}""", of=of)
    limit = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # its rows follow the parts: 326 for each, with five letters
    try:
        walked = stored(walked, "audit-orders")
    finally:
        spark.conf.set(_ROW_LIMIT, limit)
    share = walked.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return walked.join(share, ["part", "filter"]).select("part", "filter_order", "step", "filter", *metrics, "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    return audit(cells(document_masks(docs, labels)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract columns."""
    return audit_documents(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                                "good_lost", "toxic_lost", "shapley")
