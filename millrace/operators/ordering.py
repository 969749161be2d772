"""Row order on a cluster: row numbers and windows over a whole ordered table.

``Window.orderBy`` without a partition sends all rows to one task. Here rows are
range partitioned by the order key instead: the number of a row is its place in
its partition plus the rows of the partitions before it, and windows over the
whole table are computed in chunks of consecutive rows.

* A frame of bounded rows needs only a halo of neighbours: the last and first
  rows of a chunk are copied to the chunks beside it.
* A frame from the beginning of the table is a running value within the chunk
  combined with the total of the chunks before it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RID = "__rid"
#: Rows of a chunk.
CHUNK = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; only a local session without one takes a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def order_columns(order_by: str | Column | Sequence) -> list[Column]:
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def number_rows(df: DataFrame, order_by, name: str = RID) -> DataFrame:
    """``df`` with the zero-based place of each row in ``order_by`` (None: as read); ties stand in any order.

    The rows are sorted by range partitions and checkpointed once, so that every
    later use sees the same numbers; only one count per partition meets in one
    place.
    """
    place = F.monotonically_increasing_id()  # partition number, then place in the partition
    if order_by is not None:
        keys = order_columns(order_by)
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = checkpointed(df.withColumn("__row_place", place))
    part, within = F.shiftright("__row_place", 33), F.col("__row_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__before", "__row_place")


def bounded_frame(df: DataFrame, columns: dict, before: int, after: int, rid: str = RID, chunk: int = CHUNK) -> DataFrame:
    """``df`` with columns computed over frames of bounded rows in the order of ``rid``.

    ``columns`` gives for each new name a function from a WindowSpec (ordered,
    without a frame) to a Column; its frames may reach ``before`` rows back and
    ``after`` ahead. Every row goes to its own chunk and, within reach of an
    edge, to the chunks beside it too.
    """
    chunk = max(chunk, before, after, 1)
    own = F.floor(F.col(rid) / chunk)
    at = F.pmod(F.col(rid), F.lit(chunk))
    to = [F.struct(own.alias("c"), F.lit(True).alias("own"))]
    if before:
        to.append(F.when(at >= chunk - before, F.struct((own + 1).alias("c"), F.lit(False).alias("own"))))
    if after:
        to.append(F.when(at < after, F.struct((own - 1).alias("c"), F.lit(False).alias("own"))))
    spread = df.withColumn("__to", F.explode(F.array_compact(F.array(*to)))).withColumn("__chunk", F.col("__to.c"))
    w = W.partitionBy("__chunk").orderBy(rid)
    return spread.withColumns({k: f(w) for k, f in columns.items()}).filter("__to.own").drop("__to", "__chunk")


def running(df: DataFrame, columns: dict[str, tuple[Column, str]], rid: str = RID, chunk: int = CHUNK) -> DataFrame:
    """``df`` with running values from the first row on: ``columns`` maps a name to (column, sum|product|max|min|count|last).

    Nulls are skipped, as the aggregates do; ``last`` is the last non-null value so far.
    """
    agg = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    join = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "product": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b),
        "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "last": lambda a, b: F.coalesce(b, a),
    }
    df = df.withColumn("__chunk", F.floor(F.col(rid) / chunk))
    inside = W.partitionBy("__chunk").orderBy(rid).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({f"__in_{k}": agg[how](c).over(inside) for k, (c, how) in columns.items()})
    total = lambda k, c, how: F.max_by(f"__in_{k}", F.when(F.col(f"__in_{k}").isNotNull(), F.col(rid)))
    totals = df.groupBy("__chunk").agg(*[total(k, c, how).alias(f"__of_{k}") for k, (c, how) in columns.items()])
    earlier = W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)  # one row per chunk
    totals = totals.select("__chunk", *[(F.sum if how == "count" else agg[how])(f"__of_{k}").over(earlier).alias(f"__to_{k}") for k, (_, how) in columns.items()])
    df = df.join(totals, "__chunk")
    own = [c for c in df.columns if not c.startswith(("__chunk", "__in_", "__to_"))]
    return df.select(*own, *[join[how](F.col(f"__to_{k}"), F.col(f"__in_{k}")).alias(k) for k, (_, how) in columns.items()])
