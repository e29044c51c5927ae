"""Secret scans over a ledger of blobs: every content is scanned once for every version of every rule.

A version of a file (here: a document) is addressed by the digest of its content.  The ledger, a table in a
shared folder, says which (blob, rule version) pairs have been scanned and which spans they gave.  A scan takes the distinct
blobs with pairs that the ledger lacks, searches each of them for those rules only, appends the facts, and joins
the ledger's findings back to all paths.  New versions of old content and repeated runs therefore scan nothing, a new rule
version scans old blobs for itself alone.

Rules are regular expressions; matches are leftmost and don't overlap within a rule; a match that is too short is
dropped (and its characters stay used up).  Spans are code points, the end exclusive.  Places come from the
lengths of what lies between the matches: running sums over the matches of a blob and rule.

Only DataFrame functions are used.  Scale: texts are moved once, each map task sending a content at most once; copies
meet as digests only, in a join that Spark can split.  Facts are complete rows of one blob, so a scan that fails half-way
leaves nothing wrong behind.

Defined cases: a null text is the empty blob; repeated rows and ids are paths of their own (null ids too), one
row each; texts without findings have an empty list; an empty table gives an empty result; further columns of the table
are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import shared_dir
from .frames import stored


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.  ``needs``: lower-case words one of
    which every match holds in either case; texts without them are not searched."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The rules of the contract.  A run of one class of characters is as long as it can be, so the least size of the last two
#: can stand in the pattern; that of ``assign`` can't, as a short match uses up what a later one might begin with.
BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2,
         ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further well-known formats: private key headers, signed web tokens, passwords in addresses.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("address", r"[a-z]{2,12}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.!~-]{6,}@[A-Za-z0-9]", needs=("://",)),
)
RULES = BASE + ADDED

#: Unseen blobs up to this number (32 bytes each) are sent to all tasks, so that only their texts are moved.
FEW_BLOBS = 200_000

_MATCH = "struct<place: int, number: int, gap: int, size: int, kept: int>"
_FOUND = "array<struct<rule: string, start: long, stop: long>>"
LEDGER = f"blob binary, rules array<string>, found {_FOUND}"


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger of its own in the shared folder."""
    return f"{shared_dir(spark, 'llm')}/blob-ledger-{uuid.uuid4().hex}"


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's facts: blob, rules scanned, spans found.  None if there are none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _blob(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))


def _matches(text, rule: Rule, place: int):
    """The matches of a rule in order: what lies before each, its size and the size of the group that counts.  The piece
    after the last match comes as a row without a size."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = sizes if not rule.group else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.arrays_zip(pieces.alias("gap"), sizes.alias("size"), counted.alias("kept"))
    return F.transform(zipped, lambda m, i: F.struct(
        F.lit(place).alias("place"), i.alias("number"), m["gap"].alias("gap"), m["size"].alias("size"), m["kept"].alias("kept")))


def _due(rule: Rule):
    """Whether a text has to be searched: the rule is due for it, and matches somewhere."""
    due = F.array_contains("todo", rule.name)
    if rule.needs:
        due = due & reduce(or_, [F.contains("low", F.lit(x)) for x in rule.needs])
    return due & F.col("text").rlike(rule.pattern)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Facts (see ``LEDGER``) of ``blobs``: blob, text, todo (names of the rules to scan for).  Rows have different blobs."""
    text, none = F.col("text"), F.array().cast(f"array<{_MATCH}>")
    found = F.concat(*[F.coalesce(F.when(_due(r), _matches(text, r, k)), none) for k, r in enumerate(rules)])
    each = blobs.withColumn("low", F.lower("text")).select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*")
    before = Window.partitionBy("blob", "place").orderBy("number")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("place") + 1)
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("place") + 1)
    placed = each.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("size")).over(before)).where("size IS NOT NULL OR place IS NULL")
    return placed.groupBy("blob").agg(
        F.first("todo").alias("rules"),
        F.collect_list(F.when(F.col("kept") >= least, F.struct(name.alias("rule"), (F.col("stop") - F.col("size")).alias("start"), "stop")))
        .cast(_FOUND).alias("found"))


def update_ledger(versions: DataFrame, ledger: str, rules=RULES, text_col: str = "text") -> None:
    """Scan what ``versions`` has and the ledger lacks, and append the facts."""
    spark = versions.sparkSession
    every = F.array(*[F.lit(r.name) for r in rules])
    texts = versions.select(_blob(text_col).alias("blob"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    known = ledger_rows(spark, ledger)
    if known is None:
        work = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    else:
        done = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("done"))
        unseen = stored(texts.select("blob").distinct().join(done, "blob", "left").select(
            "blob", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0), "ledger-unseen")
        n = unseen.count()
        if not n:
            return
        if n <= FEW_BLOBS:
            texts = texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi")
        work = texts.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    scan_blobs(work, rules).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, paths: list[str], rules=RULES, text_col: str = "text") -> DataFrame:
    """One row per row of ``versions``: its ``paths`` columns, ``blob`` (hex) and ``found``, the spans of ``rules`` by start
    and, among equal starts, in the order of the rules."""
    spark = versions.sparkSession
    known = ledger_rows(spark, ledger)
    at = versions.select(*[F.col(f"`{p}`") for p in paths], _blob(text_col).alias("__blob"))
    if known is None:
        known = spark.createDataFrame([], LEDGER)
    place = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("f.rule"))
    # a blob has one fact per run that found it lacking a rule; facts repeated by a failed run are equal
    facts = known.where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).withColumn("place", place).where("place > 0").groupBy(
        F.col("blob").alias("__blob")).agg(F.array_sort(F.collect_set(F.struct("f.start", "place", "f.stop"))).alias("found"))
    named = F.transform("found", lambda s: F.struct(
        F.element_at(F.array(*[F.lit(r.kind) for r in rules]), s["place"].cast("int")).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    # a table of its own, so that the join with it can split a hot blob
    facts = stored(facts.select("__blob", named.alias("found")), "ledger-findings")
    return at.join(facts, "__blob", "left").select(
        *[F.col(f"`{p}`") for p in paths], F.lower(F.hex("__blob")).alias("blob"),
        F.coalesce("found", F.array().cast("array<struct<kind: string, start: long, stop: long>>")).alias("found"))


def scan(versions: DataFrame, ledger: str, paths: list[str], rules=RULES, text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date and return the ``findings`` of all paths."""
    update_ledger(versions, ledger, rules, text_col)
    return findings(versions, ledger, paths, rules, text_col)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The per-document contract columns, from a ledger that starts empty."""
    found = scan(docs.select("doc_id", "text"), new_ledger(docs.sparkSession), ["doc_id"])
    def of(kinds):
        return F.filter("found", lambda s: s["kind"].isin(kinds))

    base = of([r.kind for r in BASE])
    count = [F.size(of([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
                        F.col("blob").alias("blob_sha256"))
