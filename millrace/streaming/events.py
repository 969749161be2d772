"""Event streams: windows in event time with watermarks, sessions, running state, and batch sinks.

The batch operators work on a micro-batch as they are; what a stream adds is
here. Every function takes a streaming or a static DataFrame and gives the same
rows for both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def read_folder(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _watched(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    """A watermark needs a timestamp with a time zone; one without is taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else df


def tumbling(df: DataFrame, ts: str, length: str, by: Sequence[str], aggs: dict[str, tuple[str, str]], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates of each window (tumbling, or sliding by ``slide``) and key: name -> (column, operation)."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = _watched(df, ts, late).groupBy(w.alias("w"), *by).agg(*[AGGREGATES[op](c).alias(n) for n, (c, op) in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str], aggs: dict[str, tuple[str, str]], late: str | None = None) -> DataFrame:
    """Aggregates of each session: events of a key closer than the gap."""
    out = _watched(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*[AGGREGATES[op](c).alias(n) for n, (c, op) in aggs.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def time_bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def deduplicated(df: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """The first of the events with the same keys within the watermark."""
    return _watched(df, ts, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def smoothed(df: DataFrame, key: str, value: str, order_by: str, alpha: float) -> DataFrame:
    """Exponential smoothing of each key's values, the level kept as state between micro-batches."""
    import pandas as pd

    schema = f"{key} {dict(df.dtypes)[key]}, {order_by} {dict(df.dtypes)[order_by]}, smoothed double"

    def step(k, frames, state):
        level = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order_by, kind="stable")
        out = []
        for at, v in zip(rows[order_by], rows[value]):
            level = v if level is None else alpha * v + (1 - alpha) * level
            out.append((k[0], at, level))
        state.update((float(level),))
        yield pd.DataFrame(out, columns=[key, order_by, "smoothed"])

    if df.isStreaming:
        return df.select(key, order_by, value).groupBy(key).applyInPandasWithState(step, schema, "level double", "append", "NoTimeout")
    from millrace.operators.window import smoothing

    return smoothing(df.select(key, order_by, value), value, alpha, order_by, [key]).select(key, order_by, "smoothed")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there to a memory table of the name, then stop; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_batches(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to a function of (batch, id); with an id-keyed write this is exactly once."""
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upsert_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
