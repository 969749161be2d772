"""Nearest neighbours by Euclidean distance without sending every row to every query.

A bounded sample of the training rows is split at medians into cells; every row
goes to the cell of its vector, and each cell keeps the tight box of its rows. A
query's k-th distance to the sample bounds what it looks for, so it goes only to
cells whose box lies within that distance. In a shard, rows stand before queries
and are compared with batches of them by matrix products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ordering import checkpointed

#: Rows of a shard, of the sample, and of the sample for each cell at least; queries compared at once.
SHARD, SAMPLE, PER_CELL, BATCH = 20_000, 4096, 16, 256
#: Share by which a bound by products may be off.
SLACK = 1e-9


def cells_of(sample: np.ndarray, cells: int) -> list[tuple]:
    """Median splits of the largest part along its widest dimension: nodes (dimension, cut, left, right), or (cell,)."""
    nodes: list[tuple] = [(0,)]
    parts, n = {0: np.arange(len(sample))}, 1
    while n < cells and parts:
        at = max(parts, key=lambda k: len(parts[k]))
        rows = parts.pop(at)
        if len(rows) < 2 * PER_CELL:
            break
        spread = sample[rows].max(axis=0) - sample[rows].min(axis=0)
        d = int(spread.argmax())
        cut = np.median(sample[rows, d])
        below = sample[rows, d] < cut
        if not below.any():
            continue
        left, right = len(nodes), len(nodes) + 1
        nodes += [nodes[at], (n,)]
        nodes[at] = (d, cut, left, right)
        parts[left], parts[right], n = rows[below], rows[~below], n + 1
    return nodes


def place(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        node = nodes[at]
        if len(node) == 1:
            out[rows] = node[0]
            continue
        below = x[rows, node[0]] < node[1]
        todo += [(node[2], rows[below]), (node[3], rows[~below])]
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by products; off by what floats round."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SLACK * ((a * a).sum(axis=1) + (b * b).sum(axis=1).max(initial=0))


def vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(train: DataFrame, test: DataFrame, vector: str, k: int, train_id: str, test_id: str, shard: int = SHARD) -> DataFrame:
    """(test_id, rank, neighbor_id, distance) of the k nearest training rows, ties to the smaller id. Vectors are of one length; rows without one take no part."""
    import pyarrow as pa

    double = F.transform(vector, lambda x: x.cast("double"))
    own = checkpointed(train.select(F.col(train_id).cast("long").alias("id"), double.alias("v")).filter("id is not null and v is not null"))
    asked = test.select(F.col(test_id).cast("long").alias("id"), double.alias("v")).filter("id is not null and v is not null")
    picked = own.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE).collect()
    spark, kinds = own.sparkSession, "cell long, part int, side int, id long, v array<double>"
    names = ["cell", "part", "side", "id", "v"]
    if not picked:
        return spark.createDataFrame([], f"`{test_id}` long, rank int, neighbor_id long, distance double")
    sample = np.array([r.v for r in picked], float)
    nodes = cells_of(sample, -(-own.count() // shard))

    def boxes(batches):
        seen = {}
        for b in batches:
            x = vectors(b.column(0))
            cell = place(nodes, x)
            for c in np.unique(cell).tolist():
                own_rows = x[cell == c]
                low, high, n = own_rows.min(axis=0), own_rows.max(axis=0), len(own_rows)
                if c in seen:
                    low, high, n = np.minimum(low, seen[c][0]), np.maximum(high, seen[c][1]), n + seen[c][2]
                seen[c] = low, high, n
        yield pa.RecordBatch.from_pylist([{"cell": c, "n": n, "low": low.tolist(), "high": high.tolist()} for c, (low, high, n) in seen.items()], schema=pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    # One row for each cell and task; cells are few.
    space: dict[int, list] = {}
    for r in own.select("v").mapInArrow(boxes, "cell long, n long, low array<double>, high array<double>").toLocalIterator():
        low, high, n = space.get(r.cell, (np.full(len(r.low), np.inf), np.full(len(r.low), -np.inf), 0))
        space[r.cell] = [np.minimum(low, r.low), np.maximum(high, r.high), n + r.n]
    cells = np.array(sorted(space))
    lows, highs, parts = np.array([space[c][0] for c in cells]), np.array([space[c][1] for c in cells]), {int(c): -(-space[c][2] // shard) for c in cells}

    def put(batches):
        for b in batches:
            cell = place(nodes, vectors(b.column(1)))
            ids = b.column(0).to_numpy()
            part = np.array([i % parts[c] for i, c in zip(ids.tolist(), cell.tolist())], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), pa.array(np.zeros(len(cell), np.int32)), b.column(0), b.column(1)], names=names)

    def ask(batches):
        for b in batches:
            x = vectors(b.column(1))
            for a in range(0, len(x), BATCH):
                q = x[a : a + BATCH]
                d = squares(q, sample)
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] + slack(q, sample) if len(sample) >= k else np.full(len(q), np.inf)
                off = np.maximum(np.maximum(lows[None] - q[:, None], q[:, None] - highs[None]), 0)
                who, where = np.nonzero((off * off).sum(axis=2) <= reach[:, None])
                each = [(w, int(cells[c]), p) for w, c in zip((who + a).tolist(), where.tolist()) for p in range(parts[int(cells[c])])]
                take = b.take(pa.array([w for w, _, _ in each], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c, _ in each], pa.int64()), pa.array([p for _, _, p in each], pa.int32()), pa.array(np.ones(len(each), np.int32)), take.column(0), take.column(1)], names=names)

    units = own.mapInArrow(put, kinds).unionByName(asked.mapInArrow(ask, kinds)).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def search(batches):
        key, held, rows = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names[:3]], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if b.num_rows else []
            for a, z in zip(cuts[:-1], cuts[1:]):
                some, now = b.slice(a, z - a), tuple(keys[a, :2].tolist())
                ids, x = some.column("id").to_numpy(), vectors(some.column("v"))
                if now != key:
                    key, held, rows = now, [], None
                if keys[a, 2] == 0:
                    held.append((ids, x))
                    continue
                if not held:
                    continue
                if rows is None:
                    own_ids, rows = (np.concatenate(h) for h in zip(*held))
                out = []
                for at in range(0, len(ids), BATCH):
                    q = x[at : at + BATCH]
                    d, off = squares(q, rows), slack(q, rows)
                    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(q), np.inf)
                    for j in range(len(q)):
                        near = np.flatnonzero(d[j] <= kth[j] + 2 * off[j])
                        true = np.sqrt(((rows[near] - q[j]) ** 2).sum(axis=1))
                        top = np.lexsort((own_ids[near], true))[:k]
                        out.append((np.full(len(top), ids[at + j]), own_ids[near[top]], true[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "i", "d"])

    found = units.mapInArrow(search, "q long, i long, d double")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "i"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(test_id), "rank", F.col("i").alias("neighbor_id"), F.col("d").alias("distance"))
