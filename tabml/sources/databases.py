"""A SQL query on a database becomes the input table.

* SQLite (A5): a Spark Python Data Source over the standard ``sqlite3``
  module.  With ``partitionColumn`` the query is split into key ranges, one
  per Spark partition, each pushed into SQLite as a WHERE clause; rows without a key
  come with the last range.  Column types follow from the kinds of value SQLite finds in all rows.  The file
  must sit on storage every executor can read.
* PostgreSQL / MySQL (A6, A7): Spark's JDBC reader.  A plain query uses the
  ``query`` option; a partitioned read wraps the query as a sub-select in
  ``dbtable`` (Spark refuses ``query`` together with ``partitionColumn``).
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package
from .tables import SourceError, validate_source

SQLITE_FORMAT = "tabml_sqlite"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type_of(kinds: set) -> str:
    """Spark type that holds every kind of value SQLite reports for a column."""
    if kinds == {"integer"}:
        return "bigint"
    if kinds and kinds <= {"integer", "real"}:
        return "double"
    return "binary" if kinds == {"blob"} else "string"


_MAKERS = {"bigint": int, "double": float, "binary": bytes,
           "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}


class _Range(InputPartition):
    def __init__(self, lo, hi, last):
        super().__init__((lo, hi, last))
        self.lo, self.hi, self.last = lo, hi, last


class SqliteSource(DataSource):
    """Options: path, query, [partitionColumn, numPartitions]."""

    @classmethod
    def name(cls):
        return SQLITE_FORMAT

    def schema(self):
        con = sqlite3.connect(self.options["path"])
        try:
            query = self.options["query"]
            names = [d[0] for d in con.execute(f"SELECT * FROM ({query}) LIMIT 0").description]
            kinds = ", ".join(f"group_concat(DISTINCT typeof({_quoted(n)}))" for n in names)
            found = con.execute(f"SELECT {kinds} FROM ({query})").fetchone()
        finally:
            con.close()
        return ", ".join(f"`{n}` {_type_of(set((k or '').split(',')) - {'null', ''})}" for n, k in zip(names, found))

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        # option keys may arrive lower-cased: look them up case-insensitively
        self.options = {str(k).lower(): v for k, v in dict(options).items()}
        self.schema = schema

    def partitions(self):
        col = self.options.get("partitioncolumn")
        n = int(self.options.get("numpartitions", "1"))
        if not col or n <= 1:
            return [_Range(None, None, True)]
        con = sqlite3.connect(self.options["path"])
        try:
            lo, hi = con.execute(f"SELECT min({col}), max({col}) FROM ({self.options['query']})").fetchone()
        finally:
            con.close()
        if lo is None:
            return [_Range(None, None, True)]
        step = (hi - lo) / n
        bounds = [lo + step * i for i in range(n)] + [hi]
        return [_Range(bounds[i], bounds[i + 1], i == n - 1) for i in range(n)]

    def read(self, partition):
        q = self.options["query"]
        col = self.options.get("partitioncolumn")
        con = sqlite3.connect(self.options["path"])
        try:
            if partition.lo is None:
                cur = con.execute(q)
            else:
                upper = f"({col} <= ? OR {col} IS NULL)" if partition.last else f"{col} < ?"
                lower = f"({col} >= ? OR {col} IS NULL)" if partition.last else f"{col} >= ?"
                cur = con.execute(f"SELECT * FROM ({q}) WHERE {lower} AND {upper}", (partition.lo, partition.hi))
            makers = [_MAKERS[f.dataType.simpleString()] for f in self.schema.fields]
            for row in cur:
                yield tuple(None if v is None else make(v) for v, make in zip(row, makers))
        finally:
            con.close()


def register_sqlite(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


JDBC_DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}


def jdbc_options(config: dict, partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None, fetch_size: int = 10_000) -> dict:
    """The options for ``spark.read.format("jdbc")``."""
    cfg = validate_source({**config, "kind": "database"})
    db = cfg["db_type"]
    if db not in JDBC_DRIVERS:
        raise SourceError(f"'{db}' is not read through JDBC.")
    opts = {"url": f"jdbc:{db}://{cfg['host']}:{cfg['port']}/{cfg['database']}",
            "user": cfg["user"], "password": cfg["password"], "driver": JDBC_DRIVERS[db],
            "fetchsize": str(fetch_size)}
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise SourceError("A partitioned read needs lower_bound, upper_bound and num_partitions.")
        opts.update({"dbtable": f"({cfg['query']}) AS tabml_src", "partitionColumn": partition_column,
                     "lowerBound": str(lower_bound), "upperBound": str(upper_bound),
                     "numPartitions": str(num_partitions)})
    else:
        opts["query"] = cfg["query"]
    return opts


def read_database(spark: SparkSession, config: dict, partition_column: str | None = None,
                  num_partitions: int | None = None, lower_bound=None, upper_bound=None) -> DataFrame:
    """A5-A7 entry point: ``config`` holds db_type and its settings."""
    from ..functions.columns import nan_to_null
    cfg = validate_source({**config, "kind": "database"})
    if cfg["db_type"] == "sqlite":
        ship_package(spark)
        register_sqlite(spark)
        reader = spark.read.format(SQLITE_FORMAT).option("path", cfg["path"]).option("query", cfg["query"])
        if partition_column:
            reader = reader.option("partitionColumn", partition_column).option(
                "numPartitions", str(num_partitions or 4))
        return nan_to_null(reader.load())
    opts = jdbc_options(cfg, partition_column, lower_bound, upper_bound, num_partitions)
    return nan_to_null(spark.read.format("jdbc").options(**opts).load())
