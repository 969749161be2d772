"""Parquet: column and row-group scans, footers, formula filters, rewriting in place."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import formula


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, row_groups: Sequence[int] | None = None) -> DataFrame:
    """A scan of some columns; of one file, also of some row groups, by the rows that the footer counts for them."""
    df = spark.read.parquet(path)
    if row_groups is not None:
        sizes = [g["rows"] for g in inspect(spark, path)["row_groups"]]
        at, keep = F.col("_metadata.row_index"), F.lit(False)
        for g in row_groups:
            start = sum(sizes[:g])
            keep = keep | ((at >= start) & (at < start + sizes[g]))
        df = df.filter(keep)
    return df.select(*columns) if columns else df


def read_column(spark: SparkSession, path: str, column: str, max_values: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).select(column)
    if max_values is not None and df.limit(max_values + 1).count() > max_values:
        raise ValueError(f"more than {max_values} values")
    return df


def stream(spark: SparkSession, path: str, batch_size: int = 1000, columns: Sequence[str] | None = None) -> Iterator[list]:
    """Rows in batches, one partition at a time at the driver."""
    batch = []
    for row in read(spark, path, columns).toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == batch_size:
            yield batch
            batch = []
    if batch:
        yield batch


def inspect(spark: SparkSession, path: str) -> dict:
    """Footer of a file: rows, version, key values, columns, and statistics by row group. Only the file's tail is fetched."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        hadoop = next(s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().endswith(".parquet"))
    size = fs.getFileStatus(hadoop).getLen()
    stream_ = fs.open(hadoop)
    try:
        tail = spark._jvm.org.apache.commons.io.IOUtils
        stream_.seek(max(0, size - 8))
        foot = int.from_bytes(bytes(tail.toByteArray(stream_))[:4], "little") + 8
        stream_.seek(max(0, size - foot))
        data = bytes(tail.toByteArray(stream_))
    finally:
        stream_.close()
    m = pq.read_metadata(pa.BufferReader(b"PAR1" + data))
    groups = []
    for g in range(m.num_row_groups):
        rg = m.row_group(g)
        cols = [rg.column(c) for c in range(rg.num_columns)]
        groups.append({"rows": rg.num_rows, "bytes": rg.total_byte_size, "columns": [{"name": c.path_in_schema, "nulls": c.statistics.null_count if c.statistics else None, "min": c.statistics.min if c.statistics and c.statistics.has_min_max else None, "max": c.statistics.max if c.statistics and c.statistics.has_min_max else None} for c in cols]})
    return {"rows": m.num_rows, "version": m.format_version, "created_by": m.created_by, "metadata": {k.decode(): v.decode(errors="replace") for k, v in (m.metadata or {}).items()}, "columns": m.schema.names, "row_groups": groups}


def write(df: DataFrame, path: str) -> None:
    df.drop("__rid").write.mode("overwrite").parquet(path)


def filter_formula(spark: SparkSession, path: str, expression: str, order_by=None) -> DataFrame:
    """Rows for which a formula holds; plain comparisons are pushed down to the scan."""
    return formula.filter_rows(spark.read.parquet(path), expression, order_by)


def apply_formula(spark: SparkSession, path: str, script: str, order_by=None) -> None:
    """Run a script over a Parquet folder and put the result in its place: written beside it, then renamed."""
    out = formula.execute(spark.read.parquet(path), script, order_by)
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    out.write.parquet(fresh)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{fresh}.old"
    if not fs.rename(jpath(path), jpath(old)) or not fs.rename(jpath(fresh), jpath(path)):
        raise OSError(f"{path} could not be replaced")
    fs.delete(jpath(old), True)


