"""Tables in databases and in the catalog: read whole, by query or in chunks; written with the usual modes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    """What to read: a table with conditions, or a statement of its own. ``url`` is a JDBC address; None reads the catalog."""

    table: str | None = None
    statement: str | None = None
    url: str | None = None
    where: str | None = None
    columns: Sequence[str] | None = None
    order_by: str | None = None
    limit: int | None = None
    offset: int | None = None
    row_name: str | None = None
    types: dict[str, str] | None = None
    dates: Sequence[str] = ()

    def text(self) -> str:
        if self.statement:
            return self.statement
        if not self.table:
            raise ValueError("a table or a statement is needed")
        parts = [f"SELECT {', '.join(self.columns) if self.columns else '*'} FROM {self.table}"]
        for word, value in (("WHERE", self.where), ("ORDER BY", self.order_by), ("LIMIT", self.limit), ("OFFSET", self.offset)):
            if value is not None:
                parts.append(f"{word} {value}")
        return " ".join(parts)


def read(spark: SparkSession, q: Query, args: dict | None = None, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """The rows of a query. With ``partition`` (column, low, high, parts) a database is read by parts in parallel."""
    if q.url is None:
        df = spark.sql(q.text(), args=args) if args else spark.sql(q.text())
    else:
        reader = spark.read.format("jdbc").options(url=q.url, fetchsize=1000, **options)
        if partition:
            column, low, high, parts = partition
            reader = reader.options(dbtable=f"({q.text()}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        else:
            reader = reader.option("query", q.text())
        df = reader.load()
    df = df.withColumns({c: F.col(c).cast(t) for c, t in (q.types or {}).items()}).withColumns({c: F.col(c).cast("timestamp") for c in q.dates})
    return df.withColumnRenamed(q.row_name, "__rowname") if q.row_name else df


def stream(spark: SparkSession, q: Query, chunk: int = 1000) -> Iterator[list]:
    """Rows of a query in chunks, one partition at a time at the driver."""
    rows = []
    for r in read(spark, q).toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == chunk:
            yield rows
            rows = []
    if rows:
        yield rows


MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def write(df: DataFrame, table: str, if_exists: str = "fail", url: str | None = None, batch: int = 500, row_names: bool = False, add_columns: bool = True, **options) -> None:
    """Write to a database by JDBC, or to a catalog table; appending adds columns that the table lacks."""
    mode = MODES[if_exists]
    out = df.drop("__rid")
    out = out.withColumnRenamed("__rowname", "row_name") if row_names else out.drop("__rowname")
    if url is not None:
        out.write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode(mode).save()
        return
    spark = df.sparkSession
    if mode == "append" and spark.catalog.tableExists(table):
        there = spark.table(table)
        new = [f for f in out.schema if f.name not in there.columns]
        if new and not add_columns:
            raise ValueError(f"the table lacks {[f.name for f in new]}")
        if new:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        names = [*there.columns, *[f.name for f in new]]
        kinds = {f.name: f.dataType for f in [*there.schema, *new]}
        out = out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    out.write.mode(mode).saveAsTable(table)
