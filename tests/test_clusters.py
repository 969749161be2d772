"""Clusters of more rows than a matrix of distances would hold, against SQL or the small matrix."""

import duckdb
import numpy as np
import pytest

from millrace.functions import multivariate as M
from millrace.plans import queries

#: Beyond M.MAX_ROWS, with balances that repeat.
N = 20_500


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Suppliers in a shuffled order, their balances in clumps with gaps of several sizes."""
    f = tmp_path_factory.mktemp("suppliers")
    duckdb.sql(f"""copy (select i::bigint as s_suppkey, (i % 7)::int as s_nationkey,
        round(((i * 7919) % 2003) * 0.37 + 90.5 * floor(((i * 7919) % 2003) / 100) + 40 * floor(((i * 7919) % 2003) / 500) ** 2 + floor(((i * 7919) % 2003) / 1900) * 7, 2)::double as s_acctbal
        from range({N}) r(i) order by hash(i)) to '{f}/supplier.parquet' (format parquet)""")
    return str(f)


def against_sql(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toArrow()
    want = duckdb.connect().execute(f"create view supplier as select * from '{folder}/supplier.parquet'").sql(queries.SQL[name]).fetchall()
    rows = list(zip(*(got.column(c).to_pylist() for c in got.column_names)))
    assert sorted(rows) == sorted(want)
    return {r[1] for r in rows}


def test_clusters_of_many_suppliers(spark, folder):
    got = queries.QUERIES["clusters_of_suppliers"](spark, folder).toArrow()
    assert got.num_rows == N and set(got.column("tree").to_pylist()) == {1, 2, 3} and set(got.column("dbscan").to_pylist()) == {1}


@pytest.mark.parametrize("dense", [1, 7])
def test_average_linkage_by_chains(monkeypatch, dense):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 2))
    x = np.concatenate([x, x[:20], x[:5]])
    d = M.distances(x)
    whole = M._tree(len(x), M._agglomerate(d, np.ones(len(x)), "average"))
    monkeypatch.setattr(M, "DENSE", dense)
    monkeypatch.setattr(M, "BLOCK", 50)
    chained = M.hierarchical(x, "average")
    assert chained.heights == pytest.approx(whole.heights)
    assert all(M.cut_tree(chained, k=k) == M.cut_tree(whole, k=k) for k in (1, 2, 3, 10, 60))


def test_density_clusters_of_space(monkeypatch):
    x = np.random.default_rng(4).normal(0, 1, (120, 2))
    monkeypatch.setattr(M, "BLOCK", 50)
    got, near = M.dbscan(x, 0.3, 4), M.distances(x) <= 0.3
    core = near.sum(axis=1) >= 4
    for i in range(len(x)):
        if core[i]:
            assert all(got[j] == got[i] for j in np.flatnonzero(near[i] & core))
        else:
            assert got[i] == min((got[j] for j in np.flatnonzero(near[i] & core)), default=0)
    assert list(dict.fromkeys(g for g, c in zip(got, core) if c)) == list(range(1, max(got) + 1))


def test_linkages_over_a_matrix_refuse_more(monkeypatch):
    monkeypatch.setattr(M, "MAX_ROWS", 5)
    with pytest.raises(ValueError, match="5 rows"):
        M.hierarchical(np.zeros((6, 1)), "complete")


def test_cut_by_height_of_many_suppliers(spark, folder):
    assert len(against_sql(spark, folder, "hclust_cut_height")) == 4


def test_single_linkage_of_a_line_is_that_of_space():
    x = np.random.default_rng(5).normal(0, 1, (40, 1))
    line, space = M.hierarchical(x, "single"), M.hierarchical(np.hstack([x, np.zeros((40, 1))]), "single")
    assert line.heights == space.heights and all(M.cut_tree(line, height=h) == M.cut_tree(space, height=h) for h in (0.01, 0.1, 0.3))


def test_cut_by_number_of_many_suppliers(spark, folder):
    assert len(against_sql(spark, folder, "hclust_cut_k")) == 4


def test_cut_of_fewer_rows_than_clusters():
    assert M.cut_tree(M.hierarchical(np.array([[1.0], [5.0]]), "single"), k=4) == [1, 2]


def test_cut_of_a_long_chain():
    x = np.cumsum(np.arange(1, 20_001, dtype=float))[:, None]
    assert M.cut_tree(M.hierarchical(x, "single"), k=2) == [1] * 19_999 + [2]


def test_dbscan_of_many_suppliers(spark, folder):
    assert len(against_sql(spark, folder, "dbscan_line")) == 4


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_dbscan_of_a_line_is_that_of_space(least):
    x = np.random.default_rng(6).integers(0, 60, (50, 1)) * 0.1
    for eps in (0.0, 0.1, 0.2, 0.30000000000000004):
        assert M.dbscan(x, eps, least) == M.dbscan(np.hstack([x, np.zeros((50, 1))]), eps, least)
    assert M.dbscan(np.array([[1.0], [np.nan], [1.1]]), 0.2, 1) == [1, 0, 1]


def test_silhouettes_of_many_suppliers(spark, folder):
    got = queries.QUERIES["silhouette_line"](spark, folder).toArrow()
    ids, widths = (got.column(c).to_numpy() for c in ("s_suppkey", "width"))
    assert sorted(ids) == list(range(N))
    keys, x = M.keyed_rows(spark.read.parquet(f"{folder}/supplier.parquet"), ["s_acctbal"], "s_suppkey")
    of = dict(zip(ids.tolist(), widths.tolist()))
    odd = np.array(keys) % 2 == 1
    for i in range(0, N, 2_003):
        d = np.abs(x[:, 0] - x[i, 0])
        a, b = d[odd == odd[i]].sum() / ((odd == odd[i]).sum() - 1), d[odd != odd[i]].mean()
        assert of[keys[i]] == pytest.approx((b - a) / max(a, b), abs=2e-8)


def test_silhouettes_of_a_line_are_those_of_space(monkeypatch):
    rng = np.random.default_rng(7)
    x, labels = rng.normal(0, 1, (40, 1)), [*rng.integers(0, 3, 39).tolist(), 9]
    monkeypatch.setattr(M, "BLOCK", 100)
    line, space = M.silhouette(x, labels), M.silhouette(np.hstack([x, np.zeros((40, 1))]), labels)
    assert line[0] == pytest.approx(space[0], abs=1e-12) and line[0][-1] == 0 and line[1] == pytest.approx(space[1])
