"""Exact top-k inner products with KD-trees per shard.

A bounded sample of the rows, the same for all, is split at medians along the
widest dimension into cells; every row goes to the cell of its vector, and the
tight box of each cell is taken over all its rows. Cells above a shard's size are
dealt to several shards. Each shard builds a tree by median splits in the same
way and keeps the tight box of every node.

No vector of a box can have a larger inner product with a query than the box's
upper bound (per dimension the better of its two faces). The sample gives each
query a k-th score that the whole table can only raise; it is propagated to all
shards. A query goes to the shards alone whose cell's bound reaches it, and there
nodes are visited best bound first until the bound falls below the query's k-th
score. The shards' best k are merged at the end.

A shard's rows come before its queries, so its tree is built once and queries
stream by in batches.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import checkpointed, table

K = 10
#: Rows of a leaf, of a shard, of the sample that makes the cells and the first k-th scores, and of the sample for each cell at least.
LEAF, SHARD, SAMPLE, PER_CELL = 128, 8192, 8192, 8
#: Scores from here on need more than a float's, or a long's, digits.
FLOAT, LONG = 2.0**53, 2**63 - 1
#: Share of the sum of its terms' sizes by which a float product may be off, at most.
SLACK = 1e-9


def split(own: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(widest dimension, low, high) of some rows."""
    low, high = own.min(axis=0), own.max(axis=0)
    with np.errstate(over="ignore"):
        return int((high - low).argmax()), low, high


def upper(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each query with each box, made larger by what floats may be off where they round."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        size = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        return np.where(np.isnan(bound), np.inf, bound + np.where(size < FLOAT, 0, size * SLACK))


class Cells:
    """A tree over a sample, which tells the cell of any vector."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, cells: int):
        self.ids, self.sample = ids, sample
        self.dim, self.cut, self.left, self.right, self.cell = [0], [np.inf], [0], [0], [0]
        rest, made = [(-len(sample), 0, np.arange(len(sample)))], 1
        while rest and made < cells:
            n, node, rows = heapq.heappop(rest)
            d, low, high = split(sample[rows]) if len(rows) >= 2 * PER_CELL else (0, np.zeros(1), np.zeros(1))
            cut = np.median(sample[rows, d]) if high[d] > low[d] else None
            if cut is None:
                continue
            cut = cut if (sample[rows, d] < cut).any() else np.nextafter(cut, np.inf)
            below = sample[rows, d] < cut
            self.dim[node], self.cut[node] = d, float(cut)
            for side, own in ((self.left, rows[below]), (self.right, rows[~below])):
                side[node] = len(self.dim)
                for x, v in ((self.dim, 0), (self.cut, np.inf), (self.left, len(self.left)), (self.right, len(self.right)), (self.cell, self.cell[node] if side is self.left else made)):
                    x.append(v)
                heapq.heappush(rest, (-len(own), side[node], own))
            made += 1
        self.n = made
        self.tree = [np.array(x) for x in (self.dim, self.cut, self.left, self.right, self.cell)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        dim, cut, left, right, cell = self.tree
        node, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        while True:
            after = np.where(vectors[rows, dim[node]] < cut[node], left[node], right[node])
            after = np.where(np.isinf(cut[node]), node, after)
            if (after == node).all():
                return cell[node]
            node = after

    def start(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> np.ndarray:
        """The k-th score that the sample gives each query, without rows of its own id; not above the true one where floats round."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = queries @ self.sample.T
            size = np.abs(queries) @ np.abs(self.sample).T
            s = np.where(size < FLOAT, s, s - size * SLACK)
        s = np.where(np.isnan(s) | (query_ids[:, None] == self.ids[None, :]), -np.inf, s)
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(queries), -np.inf)


class KDTree:
    """Nodes in one array: boxes, children, and the rows [start, end) of leaves."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.low, self.high, self.children, self.rows = [], [], [], []
        todo = [(0, len(vectors), None)]
        while todo:
            start, end, parent = todo.pop()
            own = vectors[self.order[start:end]]
            at = len(self.low)
            d, low, high = split(own)
            self.low.append(low)
            self.high.append(high)
            self.rows.append((start, end))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(at)
            if end - start > leaf and high[d] > low[d]:
                half = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, d], half)]
                todo += [(start, start + half, at), (start + half, end, at)]
        self.low, self.high = np.array(self.low, float), np.array(self.high, float)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with each node."""
        return upper(queries, self.low, self.high)


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of a vector of whole numbers with some rows: by floats where they are exact, else by Python's integers."""
    with np.errstate(over="ignore"):
        size = float((np.abs(query) @ np.abs(rows).T).max(initial=0)) if rows.size else 0.0
    if size < FLOAT:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    out = np.empty(len(rows), object)
    out[:] = [sum(a * int(b) for a, b in zip(q, row)) for row in rows]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search(tree: KDTree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, bounds: np.ndarray, kth: float, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, leaves seen) of the best k rows but those of ``query_id``, among those that reach ``kth``."""
    heap, got, got_s, leaves = [(-bounds[0], 0)], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while heap and -heap[0][0] >= kth:
        _, node = heapq.heappop(heap)
        if tree.children[node]:
            for c in tree.children[node]:
                if bounds[c] >= kth:
                    heapq.heappush(heap, (-bounds[c], c))
            continue
        leaves += 1
        rows = tree.order[slice(*tree.rows[node])]
        rows = rows[ids[rows] != query_id]
        s = exact(query, vectors[rows])
        near = np.flatnonzero(s >= kth)
        if not len(near):
            continue
        got, got_s = np.r_[got, rows[near]], np.r_[got_s, s[near]]
        if len(got) > k:
            top = best(got_s, ids[got], k)
            got, got_s = got[top], got_s[top]
        if len(got) == k:
            # A float below the k-th score: ties with it must still be found.
            least = got_s.min()
            kth = max(kth, float(least) if abs(int(least)) < FLOAT else float(np.nextafter(float(least), -np.inf)))
    return got, got_s, leaves


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * x) of every component as a double, or null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.lit(1024.0) * x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    # From 2^53 on a double has no fraction.
    down = lambda x: F.when(F.abs(x) >= F.lit(FLOAT), x).otherwise(F.floor(x).cast("double"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(scaled, bad), F.transform(scaled, down))


def matrix(column, names=None) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def by_space(batch):
    """(dimensions, places in the batch, rows) for each length of vectors."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, matrix(batch.column("v").take(at) if len(at) < len(dims) else batch.column("v"))


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k best.

    Vectors that are null, empty, or hold a null or a component that is not
    finite (or isn't after scaling) take no part, and neither do rows without an
    id. Vectors of different lengths are not compared. Rows of the query's own id
    are the query's own and no candidates; every other row is one, also where it
    repeats another. Query rows that repeat id and vector have one result; an id
    with different vectors has a result for each of them. Ties go to the smaller
    id. Scores are exact at any size up to 38 digits; one beyond a long is given
    as the nearest long. Other columns are not read. An empty table gives no rows.
    """
    import pyarrow as pa

    own = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    own = own.groupBy("id", "v").agg(F.max("q").alias("q"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))
    own = checkpointed(own.withColumn("row", F.monotonically_increasing_id()))
    spark, largest = own.sparkSession, F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    sizes = {r.dim: (r.n, r.m) for r in own.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), largest.alias("m")).collect()}
    wide = any(m * m * d >= LONG for d, (_, m) in sizes.items())
    small = all(m < 2**31 for _, m in sizes.values())
    picked = own.withColumn("at", F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("id", F.lit(3)), "id", "v"))).filter(F.col("at") <= sample) if len(sizes) > 1 else own.orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(sample)
    rows = picked.select("dim", "id", "v").collect()
    cells = {d: Cells(*(np.array([r[c] for r in rows if r.dim == d], t) for c, t in (("id", np.int64), ("v", float))), -(-n // shard)) for d, (n, _) in sizes.items()}
    told = spark.sparkContext.broadcast(cells)

    def boxes(batches):
        """The box and the rows of each cell in this task."""
        seen = {}
        for b in batches:
            for d, _, v in by_space(b):
                cell = told.value[d].of(v)
                for c in np.unique(cell).tolist():
                    x = v[cell == c]
                    low, high, n = x.min(axis=0), x.max(axis=0), len(x)
                    if (d, c) in seen:
                        l, h, m = seen[d, c]
                        low, high, n = np.minimum(low, l), np.maximum(high, h), n + m
                    seen[d, c] = low, high, n
        yield pa.RecordBatch.from_pylist([{"dim": d, "cell": c, "n": n, "low": low.tolist(), "high": high.tolist()} for (d, c), (low, high, n) in seen.items()], schema=box_schema)

    def join_boxes(key, data):
        low, high = np.min(data.column("low").to_pylist(), axis=0), np.max(data.column("high").to_pylist(), axis=0)
        return pa.Table.from_pylist([{"dim": key[0].as_py(), "cell": key[1].as_py(), "n": sum(data.column("n").to_pylist()), "low": low.tolist(), "high": high.tolist()}], schema=box_schema)

    box_schema = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
    kind = "dim int, cell long, n long, low array<double>, high array<double>"
    # At most sample / PER_CELL cells of a length, so these rows are few.
    found = own.select("dim", "v").mapInArrow(boxes, kind).groupBy("dim", "cell").applyInArrow(join_boxes, kind).collect()
    space = {}
    for d in sizes:
        mine = sorted((r for r in found if r.dim == d), key=lambda r: r.cell)
        space[d] = np.array([r.cell for r in mine]), np.array([r.low for r in mine]), np.array([r.high for r in mine]), {r.cell: -(-r.n // shard) for r in mine}
    told_boxes = spark.sparkContext.broadcast(space)

    def parts_of(d, cell):
        return np.array([told_boxes.value[d][3][c] for c in cell.tolist()], np.int32)

    number = pa.int32() if small else pa.float64()
    routed = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("parts", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("v", pa.list_(number)), ("kth", pa.float64())])

    def send(batch, d, at, cell, kth):
        take = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d), pa.int32()), pa.array(cell, pa.int64()), pa.array(parts_of(d, cell)), take.column("id"), take.column("row"), take.column("n"), take.column("v").cast(pa.list_(number)), pa.array(kth, pa.float64())], schema=routed)

    def place(batches):
        for b in batches:
            for d, at, v in by_space(b):
                yield send(b, d, at, told.value[d].of(v), np.zeros(len(at)))

    def ask(batches):
        for b in batches:
            for d, at, v in by_space(b):
                cell, low, high, _ = told_boxes.value[d]
                for a in range(0, len(at), 512):
                    q, some = v[a : a + 512], at[a : a + 512]
                    kth = told.value[d].start(q, b.column("id").to_numpy()[some], k)
                    which, box = np.nonzero(upper(q, low, high) >= kth[:, None])
                    yield send(b, d, some[which], cell[box], kth[which])

    routed_kind = f"dim int, cell long, parts int, id long, row long, n long, v array<{'int' if small else 'double'}>, kth double"
    given = own.select("dim", "id", "row", "n", "v")
    placed = given.mapInArrow(place, routed_kind).withColumns({"part": F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), "side": F.lit(0)})
    asked = own.filter("q").select(given.columns).mapInArrow(ask, routed_kind).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "side": F.lit(1)})
    unit = ("dim", "cell", "part")
    units = placed.unionByName(asked).select(*unit, "side", "id", "row", "n", "v", "kth").repartition(*unit).sortWithinPartitions(*unit, "side")
    score_type = pa.decimal128(38, 0) if wide else pa.int64()

    def run(batches):
        """Rows sorted by shard, a shard's rows before its queries."""
        key, held, tree = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (*unit, "side")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if b.num_rows else []
            for a, z in zip(cuts[:-1], cuts[1:]):
                some, now = b.slice(a, z - a), tuple(keys[a, :3].tolist())
                ids, v = some.column("id").to_numpy(), matrix(some.column("v"))
                if now != key:
                    key, held, tree = now, [], None
                if keys[a, 3] == 0:
                    held.append((ids, some.column("n").to_numpy(), v))
                    continue
                if not held:
                    continue
                if tree is None:
                    shard_ids, copies, rows = (np.concatenate(x) for x in zip(*held))
                    tree = KDTree(rows)
                first, asked_row, out = some.column("kth").to_numpy(), some.column("row").to_numpy(), []
                for at in range(0, len(ids), 256):
                    bounds = tree.bounds(v[at : at + 256])
                    for j in range(at, min(at + 256, len(ids))):
                        i, s, _ = search(tree, rows, shard_ids, v[j], ids[j], bounds[j - at], first[j], k)
                        out.append((np.full(len(i), j), i, s))
                j, i, s = (np.concatenate(x) for x in zip(*out))
                s = pa.array([max(min(int(x), 10**38 - 1), 1 - 10**38) for x in s], score_type) if wide else pa.array(s.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(asked_row[j]), pa.array(shard_ids[i]), s, pa.array(np.minimum(copies[i], k))], names=["query_id", "row", "vec_id", "score", "n"])

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DecimalType(38, 0) if wide else T.LongType()), T.StructField("n", T.LongType())])
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)
    merged = ranked(units.mapInArrow(run, schema))
    merged = ranked(merged.select("query_id", "row", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    score = F.greatest(F.least("score", F.lit(LONG).cast("decimal(38,0)")), F.lit(-LONG - 1).cast("decimal(38,0)")).cast("long") if wide else F.col("score")
    return merged.select("query_id", "rank", "vec_id", score.alias("score"))


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
