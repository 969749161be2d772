import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import kd_search


def brute(rows, k=10):
    """Every row but the query's own is a candidate; an id and vector asked twice has one result."""
    v = [(i, tuple(int(np.floor(1024.0 * x)) for x in e)) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q in set(v):
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in v if j != i and len(w) == len(q))[:k]
            out += [(i, r + 1, j, max(min(-t, 2**63 - 1), -(2**63))) for r, (t, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard,sample", [(37, 400), (5000, 8192), (20, 16), (300, 3)])
def test_against_brute_force(spark, shard, sample):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, -0.5, 0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(1200)]
    rows += [(10_000 + i, list(rows[100][1])) for i in range(150)] + [(100, rows[100][1]), (7, rows[7][1]), (7, rows[7][1])]  # ties and repeated rows
    rows += [(20_000, None), (20_001, []), (20_100, [1.0, None, 0, 0, 0, 0]), (20_200, [float("nan")] * 6), (20_300, [float("inf")] * 6), (None, [1.0] * 6), (20_400, [1.0, 2.0]), (20_500, [3.0, -1.0])]
    df = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, 2.0) for i, e in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = kd_search.top_k(df, F.col("vec_id") % 100 == 0, shard=shard, sample=sample)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("size", [7e4, 3e9, 4e12])
def test_values_of_any_size_are_exact(spark, size):
    """Products beyond a float's digits, beyond a long, and single rows of such a size among small ones."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * (size if i % 3 else 1) for _ in range(8)]) for i in range(250)]
    rows += [(1000 + i, [size + (j + i) / 1024 for j in range(8)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 100 == 0, shard=50).collect()) == brute(rows)


def test_queries_go_where_their_bound_reaches(spark):
    """Clusters far apart: a query is sent to few cells, and rows that are all alike are dealt to several shards."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 2, (30, 8))
    sample = np.floor(1024 * (centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.02, (3000, 8))))
    cells = kd_search.Cells(np.arange(3000), sample, 60)
    assert cells.n == 60 and len(np.unique(cells.of(sample))) == 60
    of = cells.of(sample)
    low, high = (np.array([f(sample[of == c], axis=0) for c in range(60)]) for f in (np.min, np.max))
    sent = kd_search.upper(sample[:200], low, high) >= cells.start(sample[:200], np.arange(200), 10)[:, None]
    assert sent.mean() < 0.2
    rows = [(i, [0.5, 0.25]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 100 == 0, shard=50).collect()) == brute(rows)


def test_large_values_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-60000, 60000) for _ in range(64)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in kd_search.top_k(df, F.col("vec_id") % 100 == 0, shard=50).collect()) == brute(rows)


def test_the_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3000, (40, 8))
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 50, (4000, 8)))
    tree = kd_search.KDTree(v)
    b = tree.bounds(v[:50])
    seen = [kd_search.search(tree, v, np.arange(4000), v[j], j, b[j], -np.inf)[2] for j in range(50)]
    assert np.mean(seen) < 0.5 * sum(not c for c in tree.children)


def test_empty_table(spark):
    assert kd_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
