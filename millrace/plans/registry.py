"""Where queries register, and the helpers by which they do.

``QUERIES`` maps a name to a function of (spark, sf_dir), ``SQL`` to the
statement for a SQL engine over the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import formula
from millrace.operators import ordering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simple(name: str, table: str, build: Callable[[DataFrame], DataFrame], sql: str | None, rounded: str = "", digits: int = 6) -> None:
    """Register a query of one table. Columns named in ``rounded`` are rounded on both sides: sums of floats depend on their order."""
    names = rounded.split()
    if names and sql:
        sql = "SELECT * REPLACE (" + ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in names) + f") FROM ({sql})"
    query(name, sql)(lambda spark, d: build(read(spark, d, table)).withColumns({c: F.round(c, digits) for c in names}))


def formula_query(name: str, table: str, columns: list[str], script: str, sql: str, order_by=None) -> None:
    simple(name, table, lambda t: formula.execute(t.select(*columns), script, order_by), sql)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)).select(*[F.round(k, 8).alias(k) for k in values])


def stat_query(name: str, table: str, build: Callable[[DataFrame], dict], sql: str | None) -> None:
    wrapped = f"SELECT round(COLUMNS(*)::DOUBLE, 8) FROM ({sql})" if sql else None
    query(name, wrapped)(lambda spark, d: one_row(spark, **build(read(spark, d, table))))


def folder(spark: SparkSession) -> str:
    """A fresh folder beside the session's checkpoints, which all executors share."""
    ordering.checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
