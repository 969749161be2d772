"""CSV and JSON: reading with encoding detection and per-column types, writing with headers and row names."""

from __future__ import annotations

import codecs
import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks and the encodings they stand for.
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
#: Encodings tried, in this order, for bytes that are no UTF-8.
GUESSES = ("big5", "gb18030", "shift_jis", "euc-kr", "windows-1252")
HEAD = 8192


def guess_encoding(data: bytes) -> str:
    """By the mark, else UTF-8 where it is valid, else the first encoding that reads the bytes most plausibly."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=False)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, score = "windows-1252", -1.0
    for name in GUESSES:
        try:
            text = codecs.getincrementaldecoder(name)().decode(data, final=False)
        except UnicodeDecodeError:
            continue
        wide = sum(ord(c) > 255 for c in text)
        rare = sum(0xE000 <= ord(c) <= 0xF8FF or ord(c) < 9 for c in text)
        now = (wide - 5 * rare) / max(len(text), 1) if name != "windows-1252" else 0.05
        if now > score:
            best, score = name, now
    return best


def detect_encoding(spark: SparkSession, path: str) -> str:
    """Encoding of a file, from its first bytes, in any store that Spark reads."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEAD).alias("head")).first()
    return guess_encoding(bytes(row.head)) if row else "utf-8"


def typed(df: DataFrame, skip: str | None = None) -> DataFrame:
    """Text columns whose every non-empty cell is a number become doubles; empty cells become null. One pass decides."""
    cols = [c for c, t in df.dtypes if t == "string" and c != skip]
    if not cols:
        return df
    full = lambda c: F.trim(F.col(f"`{c}`")) != ""
    row = df.agg(*[F.count_if(full(c) & F.trim(F.col(f"`{c}`")).try_cast("double").isNull()).alias(f"bad{i}") for i, c in enumerate(cols)], *[F.count_if(full(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    numeric = {c for i, c in enumerate(cols) if row[f"bad{i}"] == 0 and row[f"n{i}"] > 0}
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).try_cast("double") if c in numeric else F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in cols})


def read_csv(spark: SparkSession, path: str, header: bool = True, row_names: bool = False, encoding: str | None = None, **options) -> DataFrame:
    """A table from CSV; with ``row_names`` the first column becomes ``__rowname``."""
    encoding = encoding or detect_encoding(spark, path)
    df = spark.read.options(header=header, encoding=encoding, multiLine=True, escape='"', **options).csv(path)
    if not header:
        df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    named = df.columns[0] if row_names else None
    out = typed(df, skip=named)
    return out.withColumnRenamed(named, "__rowname") if named else out


def read_csv_string(spark: SparkSession, text: str, header: bool = True, row_names: bool = False) -> DataFrame:
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return spark.createDataFrame([], "a string")
    width = max(map(len, rows))
    names = [*rows[0], *[f"_c{i}" for i in range(len(rows[0]), width)]] if header else [f"_c{i}" for i in range(width)]
    body = [[*r, *[None] * (width - len(r))] for r in rows[header:]]
    df = spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
    return typed(df, skip=names[0]).withColumnRenamed(names[0], "__rowname") if row_names else typed(df)


def write_csv(df: DataFrame, path: str, header: bool = True, row_names: bool = False, bom: bool = False, single: bool = False) -> None:
    """CSV files in a folder; null as an empty field. ``single`` gathers one file, ``bom`` marks it."""
    out = df if row_names else df.drop("__rowname")
    out = out.drop("__rid")
    if bom:
        first = out.columns[0]
        out = out.withColumnRenamed(first, "﻿" + first)
    (out.coalesce(1) if single or bom else out).write.mode("overwrite").options(header=header, emptyValue="", nullValue="").csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or objects by line; columns are the union of the keys."""
    return spark.read.option("multiLine", True).json(path)


def read_json_data(spark: SparkSession, data: str | bytes | dict | Iterable) -> DataFrame:
    """A table from JSON text, or from one object or several."""
    if isinstance(data, (str, bytes)):
        data = json.loads(data)
    rows = [data] if isinstance(data, dict) else list(data)
    if not rows:
        return spark.createDataFrame([], "a string")
    names = list(dict.fromkeys(k for r in rows for k in r))

    def kind(name):
        seen = {type(r[name]) for r in rows if r.get(name) is not None}
        return "boolean" if seen == {bool} else "double" if seen and seen <= {int, float} else "string"

    kinds = {n: kind(n) for n in names}
    cell = lambda v, k: None if v is None else float(v) if k == "double" else v if k == "boolean" or isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame([tuple(cell(r.get(n), kinds[n]) for n in names) for r in rows], ", ".join(f"`{n}` {kinds[n]}" for n in names))


def to_json_column(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls kept."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if not c.startswith("__")]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, names: bool = True) -> None:
    """JSON objects by line; keys are names, or letters."""
    from millrace.functions.formula import number_to_letter

    body = [c for c in df.columns if not c.startswith("__")]
    out = df.select(*body) if names else df.select(*body).toDF(*[number_to_letter(i) for i in range(len(body))])
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_json_string(df: DataFrame, limit: int = 1_000_000) -> str:
    """A JSON array of all rows in one string; for tables of ``limit`` rows at most."""
    rows = to_json_column(df).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one string")
    return "[" + ",".join(r.json for r in rows) + "]"
