import datetime as dt
import os

import pytest

from millrace.functions import interop, lp
from millrace.plans import plots
from millrace.plans.session import COMMANDS, CommandError, Session
from millrace.sources import market, parquet, sql, text, workbook
from millrace.streaming import events
from millrace.table import Table

D = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('name,age,city\nJohn,30,"NY, C"\nJane,,LA\nÉva,1.5,"a\nb"\n')
    df = text.read_csv(spark, p)
    assert df.dtypes == [("name", "string"), ("age", "double"), ("city", "string")]
    assert [tuple(r) for r in df.collect()] == [("John", 30.0, "NY, C"), ("Jane", None, "LA"), ("Éva", 1.5, "a\nb")]
    assert text.read_csv(spark, p, row_names=True).columns == ["__rowname", "age", "city"]
    assert text.read_csv(spark, p, header=False).count() == 4
    text.write_csv(df, str(tmp_path / "out"), bom=True)
    part = next(f for f in os.listdir(tmp_path / "out") if f.endswith(".csv"))
    assert open(tmp_path / "out" / part, "rb").read().startswith(b"\xef\xbb\xbfname")
    assert [tuple(r) for r in text.read_csv_string(spark, "a,b\n1,x\n2").collect()] == [(1.0, "x"), (2.0, None)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "big5"])
def test_encodings(spark, tmp_path, encoding):
    p = str(tmp_path / "e.csv")
    body = "名稱,值\n蘋果價格今天上漲了很多,1\n"
    with open(p, "wb") as f:
        f.write(body.encode(encoding))
    got = text.detect_encoding(spark, p)
    assert open(p, "rb").read().decode(got).lstrip("﻿") == body
    assert workbook.read_text(spark, p) == body


def test_json(spark, tmp_path):
    df = text.read_json_data(spark, '[{"a": 1, "b": "x"}, {"a": null, "c": true}]')
    assert [tuple(r) for r in df.collect()] == [(1.0, "x", None), (None, None, True)]
    assert text.to_json_string(df) == '[{"a":1.0,"b":"x","c":null},{"a":null,"b":null,"c":true}]'
    text.write_json(df, str(tmp_path / "j"), names=False)
    assert set(spark.read.json(str(tmp_path / "j")).columns) == {"A", "B", "C"}
    assert text.read_json_data(spark, {"a": 1}).count() == 1


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    df = spark.createDataFrame([(1, "x & <y>", None), (2, "é", 2.5)], "a int, b string, c double")
    workbook.write_workbook({"One": df, "Two": df.select("a")}, p)
    assert workbook.sheet_names(open(p, "rb").read()) == ["One", "Two"]
    assert [tuple(r) for r in workbook.read_sheet(spark, p, "One").collect()] == [("1", "x & <y>", None), ("2", "é", "2.5")]
    with pytest.raises(ValueError):
        workbook.read_sheet(spark, p, "Nope")
    out = workbook.workbook_to_csv(spark, p, str(tmp_path / "csv"))
    assert text.read_csv(spark, out[0]).count() == 2
    os.makedirs(tmp_path / "in")
    for n in ("x", "y"):
        with open(tmp_path / "in" / f"{n}.csv", "w") as f:
            f.write("k,v\n1,2\n")
    q = str(tmp_path / "c.xlsx")
    workbook.folder_to_workbook(spark, str(tmp_path / "in"), q)
    workbook.csv_to_workbook(spark, [str(tmp_path / "in" / "x.csv")], q, ["more"], append=True)
    assert workbook.sheet_names(open(q, "rb").read()) == ["x", "y", "more"]


def test_parquet(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 as k").coalesce(1).write.option("parquet.block.size", 4096).parquet(p)
    info = parquet.inspect(spark, p)
    assert info["rows"] == 1000 and info["columns"] == ["id", "k"] and info["row_groups"][0]["columns"][0]["min"] == 0
    f = parquet.inspect(spark, f"{D}/orders.parquet")
    assert parquet.read(spark, f"{D}/orders.parquet", ["o_orderkey"], [0]).count() == f["row_groups"][0]["rows"]
    assert len(list(parquet.stream(spark, p, 300))) == 4 and parquet.read_column(spark, p, "k").columns == ["k"]
    with pytest.raises(ValueError):
        parquet.read_column(spark, p, "k", max_values=10)
    assert parquet.filter_formula(spark, p, "['k'] == 3").count() == 143
    parquet.apply_formula(spark, p, "NEW('twice') = A * 2")
    assert spark.read.parquet(p).filter("twice = id * 2").count() == 1000


def test_sql(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two")], "a int, b string")
    spark.sql("DROP TABLE IF EXISTS t_sql")
    sql.write(df, "t_sql")
    with pytest.raises(Exception):  # noqa: B017
        sql.write(df, "t_sql")
    sql.write(df.selectExpr("a", "a * 1.5 as c"), "t_sql", "append")
    got = sql.read(spark, sql.Query(table="t_sql", where="a > 1", order_by="b", types={"a": "double"}))
    assert got.count() == 2 and dict(got.dtypes)["a"] == "double" and "c" in got.columns
    assert sql.read(spark, sql.Query(statement="SELECT * FROM t_sql WHERE a = :x"), args={"x": 1}).count() == 2
    assert [len(c) for c in sql.stream(spark, sql.Query(table="t_sql"), 3)] == [3, 1]
    spark.sql("DROP TABLE t_sql")


def test_streams_give_what_batches_give(spark, tmp_path):
    df = spark.read.parquet(f"{D}/events.parquet")
    src = str(tmp_path / "src")
    df.coalesce(2).write.parquet(src)
    stream = events.read_folder(spark, src, df.schema)
    aggs = {"n": ("value", "count"), "total": ("value", "sum")}
    events.run_once(events.tumbling(stream, "ts", "1 day", ["event_type"], aggs, late="30 days"), "tumbled", str(tmp_path / "c1"), "complete")
    rows = lambda d: sorted((str(r[0]), r[2], r.n, round(r.total, 4)) for r in d.collect())
    assert rows(spark.table("tumbled")) == rows(events.tumbling(df, "ts", "1 day", ["event_type"], aggs))
    events.run_once(events.smoothed(stream, "user_id", "value", "event_id", 0.5), "smooth", str(tmp_path / "c2"))
    assert spark.table("smooth").count() == df.count()
    out = str(tmp_path / "sink")
    events.to_batches(stream.select("event_id"), str(tmp_path / "c3"), events.upsert_parquet(out)).awaitTermination()
    assert spark.read.parquet(out).count() == df.count()
    assert events.sessions(df, "ts", "1 hour", ["user_id"], {"n": ("event_id", "count")}).count() > 0 and events.deduplicated(df, ["user_id"], "ts", "1 day").count() == df.select("user_id").distinct().count()


def test_market_connector(spark):
    def transport(url, timeout):
        if "chart" in url:
            return {"chart": {"result": [{"timestamp": [1, 2], "indicators": {"quote": [{"close": [10.5, 11.0], "volume": [5, 6]}]}}]}}
        return {"quoteSummary": {"result": [{"price": {"regularMarketPrice": {"raw": 3.5, "fmt": "3.50"}, "currency": "USD"}}]}}

    c = market.Client(spark, pause=0, transport=transport)
    assert [tuple(r) for r in c.table("X", "history").collect()] == [(1.0, 10.5, 5.0), (2.0, 11.0, 6.0)]
    assert c.tables(["X", "Y"], "quote").count() == 2 and c.rows("X", "quote")[0]["regularMarketPrice"] == 3.5
    with pytest.raises(ValueError):
        c.table("X", "nothing_of_the_kind")
    tries = []

    def failing(url, timeout):
        tries.append(1)
        raise OSError("no network")

    with pytest.raises(OSError):
        market.Client(spark, pause=0, transport=failing).table("X", "quote")
    assert len(tries) == 3
    r = market.Reviews(spark, "s", "r", transport=lambda u, t: {"places": [{"id": "1"}], "reviews": [{"text": "ok"}], "next": ""})
    assert r.search("x") == [{"id": "1"}] and r.reviews("1", 3).count() == 1


def test_linear_programmes(spark, tmp_path):
    m = lp.Model().set_objective("max", "3 x + 2 y").add_constraint("x + y <= 4").add_constraint("x + 3 y <= 6").add_bound("x <= 3")
    s = lp.solve(m)
    assert s.objective == pytest.approx(11) and s.values == {"x": pytest.approx(3), "y": pytest.approx(1)}
    assert lp.solve(lp.parse_lp(m.to_lp())).objective == pytest.approx(11)
    k = lp.Model().set_objective("Maximize", "8 a + 11 b + 6 c + 4 d").add_constraint("5 a + 7 b + 4 c + 3 d <= 14")
    for v in "abcd":
        k.add_binary(v)
    assert lp.solve(k).objective == 21
    i = lp.parse_lingo("MODEL: MIN = 3*x + 4*y; x + 2*y >= 7; 3*x + y >= 8; @GIN(x); @GIN(y); END")
    assert lp.solve(i).objective == 17 and lp.solve(i).status == "optimal"
    assert lp.solve(lp.Model("Maximize", "x", ["x >= 1"])).status == "unbounded" and lp.solve(lp.Model("Maximize", "x", ["x <= 1", "x >= 2"])).status == "infeasible"
    p = str(tmp_path / "m.lp")
    m.write_lp(p)
    assert lp.tables(spark, lp.solve_file(p))[0].count() == 2


def test_charts(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i * i), "ab"[i % 2]) for i in range(50)], "x int, y double, g string")
    assert sum(plots.histogram(df, "y", 7)["counts"]) == 50 and len(plots.box(df, "y", "g")["items"]) == 2 and len(plots.scatter(df, "x", "y", "g")["series"]) == 2
    for spec in (plots.line(df, "x", ["y"]), plots.bar(df, "x", ["y"]), plots.scatter(df, "x", "y"), plots.histogram(df, "y"), plots.function_plot(lambda v: v * v, 0, 1), plots.gauge(3), plots.heatmap(df, "x", "g", "y"), plots.sankey(df.selectExpr("g", "cast(x as string) t", "y"), "g", "t", "y"), plots.word_counts(df, "g")):
        plots.save_html(spec, str(tmp_path / "c.html"))
        assert os.path.getsize(tmp_path / "c.html") > 100


def test_interop(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert interop.from_pandas(spark, interop.to_pandas(df)).collect() == df.collect() and interop.to_series(df, "b").tolist() == [2.0]
    assert interop.run_code("result = sum(x)", x=[1, 2, 3]) == 6
    with pytest.raises(RuntimeError):
        interop.run_code("1 / 0")
    assert interop.Group([lambda: 1, lambda: df.count()]).run().results() == [1, 1]


def test_session(spark, tmp_path):
    s = Session(spark, home=str(tmp_path / "env"))
    s.run("""
    # a list and a table
    newdl 1 2 3 4 nil 6 as x
    newdl a b a b a b as g
    newdt x g as t
    setcolnames t v k
    """)
    assert s.run("sum x") == 16 and s.run("mean x") == pytest.approx(3.2) and s.run("shape t") == (6, 2) and s.run("cols t") == ["v", "k"]
    s.run("groupby t by k agg v:sum:total v:countall as g1")
    assert s.run("show g1").splitlines()[0].split() == ["k", "total", "v_countall"]
    assert s.run("filter t \"['v'] > 2\" as f").df.count() == 3
    s.run("addcolccl t twice ['v'] * 2")
    assert s.run("get t 1 twice") == 4
    s.run("fillna t mean cols v\nsort t v desc\nsample t 3 seed 1 as few\nsplit t train 0.5 as tr te\npivot t index k columns twice values v agg sum as p\nencode t label k as enc\nscale fit minmax t v as sc\nscale apply t sc as scaled")
    assert s.run("shape few")[0] == 3 and s.run("shape tr")[0] == 3
    assert s.run("cumsum x as c").values() == [1, 3, 6, 10, None, 16] and s.run("shift x 1 as sh").values()[1] == 1 and s.run("rolling x 2 sum as r").values()[:3] == [None, 3, 5] and s.run("expanding x 1 mean as e").values()[1] == 1.5
    s.run("newdl 2 4 6 8 10 13 as y\nnewdl 1 2 3 4 5 6 as z")
    assert s.run("corr z y").statistic > 0.9 and s.run("regression linear y z").coefficients[1] == pytest.approx(2.1429, abs=1e-3) and s.run("ttest two z y").p < 0.1
    assert s.run("anova oneway z y").df == 1 and s.run("chisq indep g z").df == 5 and s.run("ftest var z y").statistic < 1
    s.run("newdt z y as m\nkmeans m 2 as km\nhclust m single as tree\ncutree tree k 2 as cut\ndbscan m 3 2 as db")
    assert len(s.get("cut")) == 6 and s.run("silhouette m cut")[1] > 0 and sorted(s.get("km").sizes) and s.run("pca m 1").values[0] > 1
    assert s.run("knn_classify m g m 1 as knn") is not None
    path = str(tmp_path / "out.parquet")
    s.run(f"save t {path}\nload {path} as back")
    assert s.run("shape back") == s.run("shape t")
    assert s.run(f"plot line m z y save {tmp_path}/p.html")["kind"] == "line"
    s.run("env export one\ndrop t")
    with pytest.raises(CommandError):
        s.run("shape t")
    s.run("env open one")
    assert s.run("shape t")[0] == 6 and "one" in s.run("env list") and s.run("env info")["name"] == "one"
    with pytest.raises(CommandError):
        s.run("nonsense")
    assert s.run("help groupby").startswith("groupby") and len(COMMANDS) >= 95
    s.run("exit\nsum x")
    assert s.done


def test_dates_in_tables(spark):
    t = Table.of(spark, {"d": [dt.datetime(2024, 1, 1), None]})
    assert t.types() == {"d": "timestamp"} and t.n_rows == 2


def test_interactive_session(spark):
    from millrace.plans.session import complete, interact

    s, said = Session(spark), []
    lines = iter(["newdl 1 2 3 as x", "nonsense", "sum x", "exit", "never"])
    interact(s, lambda prompt: next(lines), said.append)
    assert said[1].startswith("CommandError") and said[2] == 6.0 and len(said) == 3
    assert complete(s, "groupb") == ["groupby"] and complete(s, "sum ") == ["x"]
    ended, tell = Session(spark), []

    def end(prompt):
        raise EOFError

    interact(ended, end, tell.append)
    assert tell == []


def test_png(tmp_path):
    import struct
    import zlib

    from millrace.plans import plots

    spec = plots.chart("bar", "t", x=["a", "b"], series=[{"name": "n", "data": [1, 3]}])
    plots.save_png(spec, str(tmp_path / "c.png"))
    data = (tmp_path / "c.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (640, 400)
    size = struct.unpack(">I", data[33:37])[0]
    rows = zlib.decompress(data[41 : 41 + size])
    assert len(rows) == 400 * (1 + 640 * 3) and bytes(plots.COLOURS[0]) in rows
    for kind in ("line", "step", "scatter"):
        body = {"x": [0, 1, 2], "series": [{"name": "n", "data": [[0, 1], [1, 2]] if kind == "scatter" else [1, None, 3]}]}
        assert plots.to_png(plots.chart(kind, **body))[:4] == b"\x89PNG"
    with pytest.raises(ValueError):
        plots.save_png(plots.gauge(3), str(tmp_path / "g.png"))


def test_actor_packages_and_index():
    from millrace.functions import interop
    from millrace.functions.values import BiIndex

    actor, seen = interop.Actor(), []
    interop.Group([lambda i=i: actor.do(seen.append, i) for i in range(20)]).run().wait()
    assert sorted(seen) == list(range(20))
    assert "pyspark" in interop.packages() and "pyspark==" in interop.freeze()
    with pytest.raises(ValueError):
        interop.pip("eat", "x")
    b = BiIndex(["a", "b"])
    b.set(2, "a")
    assert (b.place("a"), b.name(0), b.name(1), len(b)) == (2, None, "b", 2)
