"""One sheet of an .xlsx workbook as a DataFrame of strings."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(content: bytes, sheet: str) -> list[dict[int, str]]:
    """Cells of a sheet by column number, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(LINK) for s in book.iter(f"{MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet!r}; found {sorted(ids)}")
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == ids[sheet]).lstrip("/")
        body = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in body.iter(f"{MAIN}row"):
        cells = {}
        for c in row.iter(f"{MAIN}c"):
            letters = re.match(r"[A-Z]+", c.get("r")).group()
            col = 0
            for ch in letters:
                col = col * 26 + ord(ch) - 64
            value = c.find(f"{MAIN}v")
            if c.get("t") == "inlineStr":
                cells[col] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif value is not None:
                cells[col] = shared[int(value.text)] if c.get("t") == "s" else value.text
        rows.append(cells)
    return rows


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The sheet with its first row as header. A workbook is a hand-kept lookup of a few hundred rows."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    head, *body = sheet_rows(content, sheet)
    cols = sorted(head)
    schema = ", ".join(f"`{head[c]}` STRING" for c in cols)
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in body if r], schema)
