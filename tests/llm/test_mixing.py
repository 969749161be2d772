import pytest

from millrace.llm import mixing


def fill(sizes, weights, budget, epochs):
    """Clamp and reshare until nothing is above its cap."""
    capped, target = set(), {}
    while True:
        left = budget - sum(epochs * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over
        if len(capped) == len(sizes):
            return {s: epochs * sizes[s] for s in sizes}


@pytest.mark.parametrize("sizes,share", [({"a": 10, "b": 1000, "c": 500, None: 7}, 1.5), ({"a": 0, "b": 3}, 1.5), ({"a": 5}, 9.0), ({c: (i * 37) % 101 for i, c in enumerate("abcdefghijk")}, 1.9)])
def test_water_filling(spark, sizes, share):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    want = fill(sizes, weights, share * sum(sizes.values()), 2.0)
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in mixing.targets(df, share=share).collect()}
    assert got == pytest.approx(want)


def test_taken_is_near_the_target(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 5}" if i % 3 else None, "x", "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size string")
    out = mixing.mix(df).toPandas()
    assert len(out) == 3000 and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(zip(out.doc_id, out.taken)) == sorted(zip(again.doc_id, again.taken))


def test_edge_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "", "a"), (2, "a b c", "a"), (2, "a b c", "a"), (3, "x" * 100_000, "a")]
    out = mixing.mix(spark.createDataFrame(rows, schema)).toPandas()
    assert len(out) == 6
    assert out[out["size"] == 0].taken.sum() == 0
