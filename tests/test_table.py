import math

import pytest

from millrace.errors import config, errors, report
from millrace.operators import aggregate, clean, encode, relational, window
from millrace.operators.aggregate import Agg
from millrace.operators.ordering import bounded_frame, number_rows, running
from millrace.table import Series, Table


@pytest.fixture(scope="module")
def trips(spark):
    return Table.of(spark, {"boat": ["Elke", "Rune", "Elke", "Tove", "Rune", "Elke", "Rune"], "gear": list("nltnntl"), "catch": [12.5, 40, 7, 90, 3.5, 11, 8], "days": [2, 9, 4, 1, 6, 3, 8], "port": ["Ost", None, "Ost", "Nord", None, "West", "Nord"]})


def test_group_by_keeps_first_seen_order(trips):
    out = trips.group_by("boat").aggregate(Agg("catch", "sum"), Agg("port", "count"), Agg(None, "countall"), Agg("days", "first"), Agg("days", "last"), Agg("gear", "nunique"))
    assert out.columns == ["boat", "catch_sum", "port_count", "count_all", "days_first", "days_last", "gear_nunique"]
    assert out.collect() == [["Elke", 30.5, 3, 3, 2, 3, 2], ["Rune", 51.5, 1, 3, 9, 8, 2], ["Tove", 90.0, 1, 1, 1, 1, 1]]


def test_empty_aggregates(spark):
    t = Table.of(spark, {"k": ["a"], "v": ["text"]})
    assert t.group_by("k").aggregate(Agg("v", "sum")).collect() == [["a", None]]
    assert math.isnan(t.group_by("k").aggregate(Agg("v", "sum"), nan_on_empty=True).collect()[0][1])


def test_custom_aggregate(trips):
    import pandas as pd

    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    assert [r[1] for r in trips.group_by("boat").aggregate(Agg("catch", "custom", "spread", spread)).collect()] == [5.5, 36.5, 0.0]


def test_pivot(spark):
    t = Table.of(spark, {"lake": ["Vättern", "Mjøsa", "Vättern", "Vättern"], "fish": ["pike", "char", "char", "pike"], "kilos": [4, 7, 2, 9]})
    out = t.pivot(["lake"], "fish", "kilos", "sum", fill=0.0)
    assert sorted(out.df.drop("__rid").select("lake", "char", "pike").collect()) == [("Mjøsa", 7.0, 0.0), ("Vättern", 2.0, 13.0)]
    with pytest.raises(Exception, match="several values"):
        t.pivot(["lake"], "fish", "kilos").df.collect()
    with pytest.raises(ValueError):
        t.pivot(["lake"], "lake", "kilos")


def test_unpivot_is_row_major(spark):
    t = Table.of(spark, {"id": [1, 2], "x": [1.0, None], "y": [3.0, 4.0]})
    assert t.unpivot(["id"]).collect() == [[1, "x", 1.0], [1, "y", 3.0], [2, "x", None], [2, "y", 4.0]]
    assert t.unpivot(["id"], drop_na=True).collect() == [[1, "x", 1.0], [1, "y", 3.0], [2, "y", 4.0]]
    assert t.unpivot(["id", "x", "y"]).n_rows == 0


def test_merge(spark):
    a, b = Table.of(spark, {"ID": [1, 2, 3], "Name": ["A", "B", "C"]}), Table.of(spark, {"ID": [2, 3, 4], "Name": ["x", "y", "z"]})
    assert a.merge(b, mode="inner", on="ID").df.count() == 2
    out = a.merge(b, mode="outer", on="ID")
    assert out.columns == ["ID", "Name", "Name_other"] and sorted(r.ID for r in out.df.collect()) == [1, 2, 3, 4]
    x, y = Table.of(spark, {"V": [10, 20]}, row_names=["R1", "R2"]), Table.of(spark, {"W": [100, 300]}, row_names=["R1", "R3"])
    assert x.merge(y, mode="outer").df.count() == 3 and x.merge(y, mode="inner").df.count() == 1
    assert x.append_rows(y).df.count() == 4


def test_sorting_is_stable(spark):
    t = Table.of(spark, {"A": [3, 1, 2, 1], "B": list("abcd")})
    assert [r[1] for r in t.sort(("A", True)).collect()] == list("bdca")
    assert [r[1] for r in t.sort(("A", False)).collect()] == list("acbd")


def test_sampling(spark):
    t = Table.of(spark, {"a": list(range(50))})
    assert t.sample(10, seed=1).n_rows == 10 and t.sample(0).n_rows == 0 and t.sample(51).n_rows == 0 and t.sample(80, replace=True).n_rows == 80
    assert t.sample_frac(0.01).n_rows == 1
    assert sorted(r[0] for r in t.shuffle(3).collect()) == list(range(50)) != [r[0] for r in t.shuffle(3).collect()]
    a, b = t.train_test_split(0.7, seed=2)
    assert (a.n_rows, b.n_rows) == (35, 15) and not {r[0] for r in a.collect()} & {r[0] for r in b.collect()}
    a, _ = t.train_test_split(0.7, shuffle=False)
    assert [r[0] for r in a.collect()] == list(range(35)) and a.name.endswith("_Train")


def test_addresses_and_edits(spark):
    t = Table.of(spark, {"x": [1, 2, 3], "y": ["a", "b", None]})
    assert t.resolve("B") == "y" and t.resolve(-1) == "y" and t.letter_of("y") == "B" and t.at(-1, "A") == 3 and t.row(1) == [2, "b"]
    assert t.set(0, "x", 9).collect()[0] == [9, "a"] and t.set_row(2, [7, "z"]).collect()[2] == [7, "z"]
    assert t.swap_cols("x", "y").columns == ["y", "x"] and t.swap_rows(0, 2).collect()[0] == [3, None]
    assert t.with_col("z", [5, 6]).collect() == [[1, "a", 5], [2, "b", 6], [3, None, None]]
    assert t.names_to_first_row().collect()[0] == ["x", "y"] and t.names_to_first_row().row_to_names(0).columns == ["x", "y"]
    assert t.set_names(["p", "q", "r"]).columns == ["p", "q", "r"]
    assert t.drop_rows(0).collect() == [[2, "b"], [3, None]] and t.rows_between(1).n_rows == 2
    assert t.drop_rows_with("nil").n_rows == 2 and t.drop_cols_with("string").columns == ["x"]
    assert t.find_rows(2) == [1] and t.find_cols(part="b") == ["B"] and t.count(2) == 1 and t.counter()[2] == 1
    assert t.replace(2, 20).at(1, "x") == 20 and t.replace_missing("?").at(2, "y") == "?"
    assert t.transpose().df.count() == 2
    n = t.col_to_row_names("y")
    assert n.row_names() == ["a", "b", None] and n.row_index_of("b") == 1 and n.at("b", "x") == 2 and n.row_names_to_first_col("n").columns == ["n", "x"]
    assert Table.of(spark, {"a": [1, 2, 3]}, row_names=["r", "r", "r"]).row_names() == ["r", "r_1", "r_2"]
    assert "nil" in t.show() and t.map(lambda v: v * 2, "x", "bigint").at(1, "x") == 4


def test_describe(spark):
    t = Table.of(spark, {"x": [1, 2, 3], "label": ["a", "b", "a"], "y": [10.0, None, float("nan")]})
    d = {r.stat: r for r in t.describe().collect()}
    assert list(d) == ["count", "missing", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert d["mean"].x == 2 and d["missing"].y == 2 and d["std"].y is None
    d = {r.stat: r for r in t.describe(include_all=True).collect()}
    assert (d["top"].label, d["freq"].label, d["unique"].label) == ("a", "2.0", "2.0")


def test_encoders(spark):
    t = Table.of(spark, {"color": ["red", "blue", "red"], "size": ["S", "M", "S"], "value": [10, 20, 30]})
    hot, e = t.one_hot("color")
    assert hot.columns == ["color_red", "color_blue", "size", "value"] and hot.collect()[1] == [0, 1, "M", 20]
    assert [r[0] for r in e.inverse_transform(hot.df).orderBy("__rid").select("color").collect()] == ["red", "blue", "red"]
    lab, e = t.label_encode("color", "lexicographic")
    assert [r[0] for r in lab.collect()] == [1, 0, 1] and e.inverse([0, 1]) == ["blue", "red"]
    o, _ = t.ordinal_encode("size", ["S", "M"])
    assert [r[1] for r in o.collect()] == [0, 1, 0]
    with pytest.raises(Exception, match="unknown category"):
        encode.LabelEncoder("color", values=["red"]).transform(t.df).collect()
    s, scaler = t.scale("minmax", "value")
    assert [r[2] for r in s.collect()] == [0, 0.5, 1] and [r[2] for r in Table(scaler.inverse_transform(s.df)).collect()] == [10, 20, 30]
    flat = Table.of(spark, {"v": [5.0, 5.0]})
    assert [r[0] for r in flat.scale("standard", "v")[0].collect()] == [0, 0]
    with pytest.raises(ValueError):
        t.scale("standard", "color")


def test_impute(spark):
    t = Table.of(spark, {"n": [1.0, None, None, 4.0, float("nan")], "s": ["x", None, "y", "x", None]})
    assert [r[0] for r in t.fill("forward", ["n"]).collect()] == [1, 1, 1, 4, 4]
    assert [r[0] for r in t.fill("forward", ["n"], limit=1).collect()][:3] == [1, 1, None]
    assert [r[0] for r in t.fill("backward", ["n"]).collect()][:4] == [1, 4, 4, 4]
    assert [r[0] for r in t.fill("mean").collect()] == [1, 2.5, 2.5, 4, 2.5]
    assert [r[1] for r in t.fill("mode", ["s"]).collect()] == ["x", "x", "y", "x", "x"]
    assert [r[0] for r in t.fill("interpolate", ["n"]).collect()][:4] == [1, 2, 3, 4]
    grouped = clean.fill_interpolated(t.df.selectExpr("__rid", "n", "'g' as g"), ["n"], "__rid", ["g"], extrapolate=True)
    assert [r.n for r in grouped.orderBy("__rid").collect()] == [1, 2, 3, 4, 5]
    whole = clean.fill_interpolated(Table.of(spark, {"n": [None, None, 3.0, None, 7.0]}).df, ["n"], "__rid", extrapolate=True)
    assert [r.n for r in whole.orderBy("__rid").collect()] == [-1, 1, 3, 5, 7]
    alone = clean.fill_interpolated(Table.of(spark, {"n": [None, 3.0, None]}).df, ["n"], "__rid", extrapolate=True)
    assert [r.n for r in alone.collect()] == [3, 3, 3]
    assert [clean.interpolate_at([0, 1, 4, 9], 1.5, h) for h in ("linear", "quadratic", "lagrange", "newton", "nearest")] == pytest.approx([2.5, 2.25, 2.25, 2.25, 4])
    assert clean.interpolate_at([0, 1, 4], 1.5, "hermite", [0, 2, 4]) == pytest.approx(2.25)


def test_series(spark):
    s = Series.of(spark, [3, [1, 4], 1, 5])
    assert s.values() == [3, 1, 4, 1, 5] and s.sum() == 14 and s.median() == 3 and s.mode() == [1] and s.range() == 4
    assert s.quartile(1) == 1 and s.percentile(25) == 1 and s.iqr() == pytest.approx(3.5)
    assert s.rank().values() == [3, 1.5, 4, 1.5, 5] and s.sort().values() == [1, 1, 3, 4, 5] and s.reverse().values() == [5, 1, 4, 1, 3]
    assert s.insert(1, 9).values() == [3, 9, 1, 4, 1, 5] and s.append(7).values()[-1] == 7 and s.drop(0).values() == [1, 4, 1, 5]
    assert s.replace(1, 0, "first").values() == [3, 0, 4, 1, 5] and s.replace(1, 0, "last").values() == [3, 1, 4, 0, 5] and s.find(1) == [1, 3]
    assert s.normalize().values() == [0.5, 0, 0.75, 0, 1]
    assert Series.of(spark, ["heLLo"]).capitalize().values() == ["Hello"] and Series.of(spark, ["1", "x"]).parse_numbers().values() == [1, None]


def test_windows_over_chunks(spark):
    """Chunks of a few rows give what one window over all rows gives."""
    df = number_rows(spark.range(57).selectExpr("id", "if(id % 5 = 0, null, id * 1.0) v"), "id")
    w = window.Rolling(7, 2, center=True)
    got = bounded_frame(df, {"m": w.mean("v").build, "l": window.shift("v", 3).build}, 3, 3, chunk=7).orderBy("id").collect()
    v = [None if i % 5 == 0 else float(i) for i in range(57)]
    for i, r in enumerate(got):
        own = [x for x in v[max(0, i - 3) : i + 4] if x is not None]
        assert r.m == pytest.approx(sum(own) / len(own)) and r.l == (v[i - 3] if i >= 3 else None)
    from pyspark.sql import functions as F

    got = running(df, {"s": (F.col("v"), "sum"), "p": (F.col("v") / 10, "product"), "m": (F.col("v"), "max"), "n": (F.col("v"), "count"), "last": (F.col("v"), "last")}, chunk=4).orderBy("id").collect()
    for i, r in enumerate(got):
        own = [x for x in v[: i + 1] if x is not None]
        assert r.n == len(own) and r["last"] == (own[-1] if own else None) and r.s == (pytest.approx(sum(own)) if own else None)


GOLDEN = [  # input, sequence, what comes out
    ([1.0, 2.0, 4.0], lambda: window.shift("v", 1), [None, 1, 2]), ([1.0, 2.0, 4.0], lambda: window.shift("v", -1, 0.0), [2, 4, 0]), ([1.0, None, 4.0], lambda: window.diff("v"), [None, None, None]), ([1.0, 2.0, 4.0], lambda: window.pct_change("v"), [None, 1, 1]), ([0.0, 2.0], lambda: window.pct_change("v"), [None, None]),
    ([1.0, 2.0, 3.0, 4.0], lambda: window.Rolling(3).sum("v"), [None, None, 6, 9]), ([1.0, None, 3.0, 4.0], lambda: window.Rolling(3, 2).mean("v"), [None, None, 2, 3.5]), ([1.0, 2.0, 3.0, 4.0], lambda: window.Rolling(3, center=True).median("v"), [None, 2, 3, None]),
    ([1.0, 2.0, 4.0], lambda: window.Rolling(2).std("v"), [None, 0.7071067811865476, 1.4142135623730951]), ([1.0, 2.0, 3.0], lambda: window.Rolling(2, weights=(1, 3)).mean("v"), [None, 1.75, 2.75]), ([1.0, 2.0, 3.0], lambda: window.Rolling(2, 1).apply("v", lambda x: float(len(x))), [1, 2, 2]),
]


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_sequences(spark, case):
    values, s, want = GOLDEN[case]
    got = Table.of(spark, {"v": values}).windowed({"out": s()}).collect()
    assert [r[1] for r in got] == pytest.approx(want)


def test_grouped_windows(spark):
    t = Table.of(spark, {"id": list("ABABAB"), "price": [10.0, 100.0, 12.0, 110.0, 11.0, 105.0]})
    got = t.group_by("id").windowed({"d": window.diff("price"), "c": window.cumulative("price", "sum"), "e": window.Expanding(2).mean("price")}).collect()
    assert [r[2] for r in got] == [None, None, 2, 10, -1, -5] and [r[3] for r in got] == [10, 100, 22, 210, 33, 315] and [r[4] for r in got] == pytest.approx([None, None, 11, 105, 11, 105])
    assert t.cumulative({"s": ("price", "sum")}).collect()[-1][-1] == 348 and t.expanding({"m": ("price", "mean")}).collect()[1][-1] == 55


def test_smoothing(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 4, 8])], "g string, i int, v double")
    assert [r.smoothed for r in window.smoothing(df, "v", 0.5, "i", ["g"]).orderBy("i").collect()] == [1, 1.5, 2.75, 5.375]
    assert window.smoothing(df, "v", 0.5, "i", ["g"], beta=0.5).count() == 4


def test_quantiles_by_counts(spark):
    df = spark.range(1000).selectExpr("cast(id % 37 as double) v")
    want = aggregate.type7, aggregate.type6
    for kind, f in ((7, want[0]), (6, want[1])):
        got = aggregate.quantiles(df, "v", [0.1, 0.5, 0.9], kind)
        assert [got[p] for p in (0.1, 0.5, 0.9)] == pytest.approx([df.agg(f("v", p) if kind == 7 else f(df.v, p)).first()[0] for p in (0.1, 0.5, 0.9)])
    assert aggregate.quantiles(df.limit(0), "v", [0.5]) == {0.5: None}


def test_unknown_operation(trips):
    with pytest.raises(ValueError):
        trips.group_by("boat").aggregate(Agg("catch", "nope"))
    with pytest.raises(ValueError):
        relational.merge(trips.df, trips.df, "sideways", "boat")


def test_errors_are_kept_in_a_ring():
    errors.pop_all()
    config.dont_panic = True
    report("warning", "p", "f", "one")
    report("fatal", "q", "f", "two")
    config.dont_panic = False
    assert [e.message for e in errors.all()] == ["one", "two"] and errors.pop(last=True).message == "two" and errors.pop(where=lambda e: e.package == "p").message == "one" and errors.pop() is None
    with pytest.raises(RuntimeError):
        report("fatal", "q", "f", "three")
    errors.pop_all()


def test_guarded_chains_go_on(trips):
    g = trips.guarded().drop_cols("nope").select("boat", "days").filter("['days'] > 3")
    assert g.columns == ["boat", "days"] and g.table.n_rows == 4 and "nope" in str(g.err())
    assert g.clear_err().err() is None and trips.guarded().select("boat").err() is None


def test_equality_of_lists(spark):
    a, b, c = (Series.of(spark, v) for v in ([1, 2, None, 2], [2, None, 1, 2], [1, 2, None]))
    assert a.is_equal_to(a) and not a.is_equal_to(b) and a.is_the_same_as(b) and not a.is_the_same_as(c) and not a.is_equal_to(c)


def test_expanding_variance_of_large_values(spark):
    import statistics

    values = [1e9 + v for v in (1.0, 2.5, 4.0, 9.0, 9.5)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = [r["var"] for r in window.expanding_all(df, {"var": ("v", "var")}, "i").orderBy("i").collect()]
    assert got[0] is None and got[1:] == pytest.approx([statistics.variance(values[: k + 1]) for k in range(1, 5)], rel=1e-6)


def test_column_stats_of_the_sorted_values_and_of_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5)], "v double")
    r = aggregate.column_stats(df, "v").first()
    assert (r.q1, r.q2, r.q3, r.iqr, r.median, r["sum"]) == (1.0, 3.0, 4.5, 3.5, 3.0, 14.0)
    assert list(aggregate.column_stats(df.limit(0), "v").first())[5] is None
    assert aggregate.column_stats(df, "v", ["q1"]).columns == ["q1"]


def test_rolling_functions_may_give_whole_numbers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, None, 5.0, 9.0])], "i long, v double")
    got = window.apply(df, {"n": window.Rolling(2, min_obs=1).apply("v", len), "m": window.Rolling(2, min_obs=1).apply("v", lambda f: sum(x is None for x in f))}, "i").orderBy("i").collect()
    assert [r.n for r in got] == [1.0, 2.0, 2.0, 2.0] and [r.m for r in got] == [0.0, 1.0, 1.0, 0.0]
