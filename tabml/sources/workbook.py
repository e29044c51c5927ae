"""A4: a folder (or glob) of XLSX workbooks as one DataFrame.

Each workbook is one ``binaryFile`` row; ``mapInPandas`` parses the first
sheet of every file in its own task with the standard library (an XLSX file
is a zip of XML parts), so many workbooks are read in parallel.  A first,
narrow pass reads only the header rows to fix the schema (bounded by files x
columns); cells come back as text and a column becomes double when every
non-empty cell parses as a number.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    first = wb.find("m:sheets/m:sheet", _NS)
    rid = first.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.iter(f"{_REL_NS}Relationship"):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def parse_first_sheet(data: bytes, max_rows: int | None = None) -> list[list]:
    """Rows of the first sheet as lists of text (None for empty cells)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        for si in sst.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    sheet = ET.fromstring(z.read(_first_sheet_path(z)))
    rows = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", _NS):
            kind = c.get("t")
            v = c.find("m:v", _NS)
            if kind == "s" and v is not None:
                val = shared[int(v.text)]
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b" and v is not None:
                val = "true" if v.text == "1" else "false"
            else:
                val = v.text if v is not None else None
            cells[_col_index(c.get("r"))] = val
        width = max(cells) + 1 if cells else 0
        rows.append([cells.get(i) for i in range(width)])
        if max_rows is not None and len(rows) >= max_rows:
            break
    return rows


def read_workbooks(spark: SparkSession, path: str, infer_numbers: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def headers(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"],
                                "header": [[str(h) if h is not None else "" for h in
                                            (parse_first_sheet(b, 1) or [[]])[0]] for b in pdf["content"]]})

    heads = files.mapInPandas(headers, "path string, header array<string>").collect()  # one row per file
    columns: list[str] = []
    for r in heads:
        for h in r["header"]:
            if h and h not in columns:
                columns.append(h)
    if not columns:
        raise ValueError("No header row found in the workbooks.")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def body(batches):
        for pdf in batches:
            out = []
            for b in pdf["content"]:
                rows = parse_first_sheet(b)
                if not rows:
                    continue
                head = [str(h) if h is not None else "" for h in rows[0]]
                for row in rows[1:]:
                    rec = dict.fromkeys(columns)
                    for h, v in zip(head, row):
                        if h:
                            rec[h] = v
                    out.append(rec)
            yield pd.DataFrame(out, columns=columns)

    df = files.mapInPandas(body, schema)
    if not infer_numbers:
        return df
    parsed = {c: F.col(f"`{c}`").try_cast("double") for c in columns}
    st = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
                *[F.count(parsed[c]).alias(f"p{i}") for i, c in enumerate(columns)]).first()
    return df.select(*[(parsed[c] if st[f"n{i}"] and st[f"n{i}"] == st[f"p{i}"] else F.col(f"`{c}`")).alias(c)
                       for i, c in enumerate(columns)])
