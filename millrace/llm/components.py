"""Connected components of a large graph: alternating large-star and small-star rounds (Kiveris et al., 2014).

Edges stay distributed; each round ends in a checkpoint. A node's minimum is a
partial aggregate, so a node with very many neighbours costs one row per task.
Up to ``BROADCAST_EDGES`` edges the minima go to all executors, so the edges of
such a node stay where they are; beyond, they are joined by sort merge joins,
whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

#: Edges up to which the minima of their nodes are broadcast: two a edge at most, 16 bytes each.
BROADCAST_EDGES = 400_000


def _large_star(edges: DataFrame, sent) -> DataFrame:
    """Each neighbour above a node goes to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(sent(least), F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, sent) -> DataFrame:
    """A node and its neighbours below it go to the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(sent(least.withColumnRenamed("a", "at")), F.col("a") == F.col("at")).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge but the roots; ``edges`` has the orderable columns a and b.

    Loops and repeated edges are allowed. Null ends are not nodes and are left out.
    """
    now = checkpointed(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, now.count()
    for _ in range(max_rounds):
        # A round never makes more edges than it is given.
        sent = F.broadcast if n <= BROADCAST_EDGES else (lambda d: d)
        now = checkpointed(_small_star(_large_star(now, sent), sent).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = state, state[0]
    raise RuntimeError(f"no fixed point of the components after {max_rounds} rounds")
