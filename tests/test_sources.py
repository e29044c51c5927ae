import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from tabml.sources import databases as DB
from tabml.sources import tables as TB
from tabml.sources import workbook as WB
from tabml.plans import views as V


def test_csv_and_json_round_trip(spark, tmp_path):
    cust = V.table(spark, SF_SMALL, "customer")
    cust.write.option("header", True).csv(str(tmp_path / "c.csv"))
    back = TB.read_table(spark, str(tmp_path / "c.csv"))
    assert back.count() == cust.count()
    assert dict(back.dtypes)["c_acctbal"] == "double"
    pdf = cust.limit(20).toPandas()
    (tmp_path / "c.json").write_text(pdf.to_json(orient="records"))
    j = TB.read_table(spark, str(tmp_path / "c.json"))
    assert j.count() == 20 and set(j.columns) == set(cust.columns)


def test_validate_source_errors():
    with pytest.raises(TB.SourceError):
        TB.validate_source({"kind": "file", "path": "x.txt"})
    with pytest.raises(TB.SourceError):
        TB.validate_source({"kind": "database", "db_type": "oracle"})
    with pytest.raises(TB.SourceError, match="password"):
        TB.validate_source({"kind": "database", "db_type": "mysql", "host": "h", "port": 1, "database": "d",
                            "user": "u", "query": "select 1"})
    assert TB.validate_source({"kind": "file", "path": "a/b.parquet"})["format"] == "parquet"


def test_read_sql_exposes_tables(spark):
    n = V.table(spark, SF_SMALL, "nation")
    r = V.table(spark, SF_SMALL, "region")
    out = TB.read_sql(spark, {"n": n, "r": r},
                      "SELECT r_name, count(*) AS k FROM n JOIN r ON n_regionkey = r_regionkey GROUP BY r_name")
    assert out.agg(F.sum("k")).first()[0] == 25


def test_sqlite_partitioned_read(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")
    rows = V.table(spark, SF_SMALL, "customer").select("c_custkey", "c_name", "c_acctbal").collect()
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
    con.executemany("INSERT INTO customer VALUES (?, ?, ?)", [tuple(r) for r in rows])
    con.commit()
    con.close()
    df = DB.read_database(spark, {"db_type": "sqlite", "path": path,
                                  "query": "SELECT * FROM customer WHERE c_acctbal > 0"},
                          partition_column="c_custkey", num_partitions=4)
    assert df.rdd.getNumPartitions() == 4
    want = sum(1 for r in rows if r["c_acctbal"] > 0)
    assert df.count() == want and df.select("c_custkey").distinct().count() == want


def test_sqlite_types_and_rows_without_key(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (k INTEGER, v)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(None if i % 10 == 0 else i, i if i < 1500 else i + 0.5) for i in range(2000)])
    con.commit()
    con.close()
    df = DB.read_database(spark, {"db_type": "sqlite", "path": path, "query": "SELECT * FROM t"}, partition_column="k", num_partitions=4)
    assert dict(df.dtypes) == {"k": "bigint", "v": "double"}
    assert df.count() == 2000 and df.agg(F.max("v")).first()[0] == 1999.5


def test_jdbc_options():
    cfg = {"db_type": "postgresql", "host": "h", "port": 5432, "database": "d", "user": "u",
           "password": "p", "query": "select * from t"}
    plain = DB.jdbc_options(cfg)
    assert plain["url"] == "jdbc:postgresql://h:5432/d" and plain["query"] == "select * from t"
    part = DB.jdbc_options(cfg, "id", 0, 100, 8)
    assert "query" not in part and part["dbtable"].startswith("(select * from t)")
    assert part["numPartitions"] == "8"
    with pytest.raises(TB.SourceError):
        DB.jdbc_options(cfg, "id")


def _xlsx(rows):
    buf = io.BytesIO()
    strings = []

    def cell(ref, v):
        if isinstance(v, str):
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'
    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)) + "</row>"
        for i, r in enumerate(rows))
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rns = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rns}"><sheets>'
                                      f'<sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' +
                   "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
    return buf.getvalue()


def test_workbooks_folder(spark, tmp_path):
    nation = V.table(spark, SF_SMALL, "nation").orderBy("n_nationkey").collect()
    half = len(nation) // 2
    for i, part in enumerate([nation[:half], nation[half:]]):
        rows = [["n_nationkey", "n_name"]] + [[r["n_nationkey"], r["n_name"]] for r in part]
        (tmp_path / f"w{i}.xlsx").write_bytes(_xlsx(rows))
    df = WB.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert df.count() == 25
    assert dict(df.dtypes)["n_nationkey"] == "double"
    assert sorted(r["n_name"] for r in df.collect()) == sorted(r["n_name"] for r in nation)
