"""Excel workbooks, read and written by the standard library: a workbook is a zip of XML parts.

A workbook is one file of bounded size, so reading and writing it is driver
work; the sheets become DataFrames, and DataFrames are streamed into sheets.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterable
from io import BytesIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.formula import letter_to_number, number_to_letter
from millrace.sources import text

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet that the format allows.
MAX_ROWS = 1_048_576


def _parts(data: bytes) -> tuple[zipfile.ZipFile, list[str], dict[str, str]]:
    z = zipfile.ZipFile(BytesIO(data))
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): "xl/" + links[s.get(_REL)].lstrip("/").removeprefix("xl/") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    return z, shared, sheets


def sheet_names(data: bytes) -> list[str]:
    return list(_parts(data)[2])


def sheet_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """Cells of a sheet as text."""
    z, shared, sheets = _parts(data)
    if sheet not in sheets:
        raise ValueError(f"no sheet {sheet!r}")
    rows: list[list[str | None]] = []
    for row in ET.fromstring(z.read(sheets[sheet])).iter(f"{_NS}row"):
        at = int(row.get("r") or len(rows) + 1)
        while len(rows) < at:
            rows.append([])
        for cell in row.iter(f"{_NS}c"):
            letters = re.match(r"[A-Z]+", cell.get("r") or number_to_letter(len(rows[-1])))
            i = letter_to_number(letters[0])
            v, inline = cell.find(f"{_NS}v"), cell.find(f"{_NS}is")
            value = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else None if v is None else shared[int(v.text)] if cell.get("t") == "s" else v.text
            rows[-1] += [None] * (i + 1 - len(rows[-1]))
            rows[-1][i] = value
    return rows


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def read_sheet(spark: SparkSession, path: str, sheet: str, header: bool = True, row_names: bool = False) -> DataFrame:
    """A sheet as a table of text cells."""
    rows = sheet_rows(_bytes(spark, path), sheet)
    width = max((len(r) for r in rows), default=0)
    rows = [r + [None] * (width - len(r)) for r in rows]
    names = [n or f"_c{i}" for i, n in enumerate(rows[0])] if header and rows else [f"_c{i}" for i in range(width)]
    df = spark.createDataFrame([tuple(r) for r in rows[header:]], ", ".join(f"`{n}` string" for n in names) or "a string")
    return df.withColumnRenamed(names[0], "__rowname") if row_names else df


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def workbook(sheets: dict[str, Iterable[Iterable]]) -> bytes:
    """A workbook with the given rows in each sheet."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for r, row in enumerate(rows, 1):
                    if r > MAX_ROWS:
                        raise ValueError(f"a sheet holds {MAX_ROWS} rows")
                    f.write(f'<row r="{r}">{"".join(_cell(f"{number_to_letter(c)}{r}", v) for c, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def frame_rows(df: DataFrame) -> Iterable[Iterable]:
    """Header and rows of a table, partition by partition."""
    yield df.columns
    for r in df.toLocalIterator():
        yield list(r)


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
    finally:
        out.close()


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """Tables as sheets of a workbook."""
    data = workbook({name: frame_rows(df) for name, df in frames.items()})
    _put(next(iter(frames.values())).sparkSession, path, data)


def csv_to_workbook(spark: SparkSession, files: list[str], path: str, sheets: list[str] | None = None, encoding: str | None = None, append: bool = False) -> None:
    """CSV files as the sheets of a workbook, new or added to one."""
    names = sheets or [os.path.splitext(os.path.basename(f))[0] for f in files]
    if len(names) != len(files):
        raise ValueError("as many sheet names as files are needed")
    held: dict[str, Iterable[Iterable]] = {}
    if append:
        data = _bytes(spark, path)
        held = {s: sheet_rows(data, s) for s in sheet_names(data)}
    held |= {n: frame_rows(text.read_csv(spark, f, encoding=encoding)) for n, f in zip(names, files)}
    _put(spark, path, workbook(held))


def folder_to_workbook(spark: SparkSession, folder: str, path: str, encoding: str | None = None) -> None:
    csv_to_workbook(spark, sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.lower().endswith(".csv")), path, encoding=encoding)


def workbook_to_csv(spark: SparkSession, path: str, folder: str, names: list[str] | None = None, only: list[str] | None = None) -> list[str]:
    """Each sheet as a CSV folder named after it."""
    found = [s for s in sheet_names(_bytes(spark, path)) if only is None or s in only]
    out = [os.path.join(folder, n if n.endswith(".csv") else f"{n}.csv") for n in (names or found)]
    for s, to in zip(found, out):
        text.write_csv(read_sheet(spark, path, s), to, single=True)
    return out


def folder_of_workbooks_to_csv(spark: SparkSession, folder: str, to: str) -> list[str]:
    return [p for f in sorted(os.listdir(folder)) if f.lower().endswith(".xlsx") for p in workbook_to_csv(spark, os.path.join(folder, f), os.path.join(to, os.path.splitext(f)[0]))]


def read_text(spark: SparkSession, path: str, encoding: str | None = None) -> str:
    """A whole text file as one string, decoded."""
    data = _bytes(spark, path)
    name = encoding or text.guess_encoding(data[: text.HEAD])
    return data.decode(name).lstrip("﻿")


