"""Plans that would hold at scale: no task that takes all rows, pruned columns, filters at the scan."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import formula
from millrace.operators import aggregate, clean, ordering, relational, window
from millrace.operators.aggregate import Agg

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def told(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{D}/lineitem.parquet")


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{D}/events.parquet")


def test_aggregates_are_partial_and_columns_pruned(lines):
    p = plan(aggregate.group_aggregate(lines, ["l_returnflag"], [Agg("l_quantity", "sum"), Agg("l_tax", "var")]))
    assert "partial_sum" in p and "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in p


def test_formula_filters_are_pushed(lines):
    p = told(formula.filter_rows(lines, "10 < ['l_quantity'] <= 20 && ['l_discount'] >= 0.05").select("l_orderkey"))
    assert all(x in p for x in ("GreaterThan(l_quantity,10.0)", "LessThanOrEqual(l_quantity,20.0)", "GreaterThanOrEqual(l_discount,0.05)"))


@pytest.mark.parametrize(
    "make",
    [
        lambda e: window.apply(e, {"m": window.Rolling(5).mean("value")}, ["ts", "event_id"]),
        lambda e: formula.with_column(e, "l", "LAG(['value'], 2)", ["ts", "event_id"]),
        lambda e: window.apply(e, {"m": window.Rolling(5).mean("value")}, ["ts", "event_id"], ["user_id"]),
    ],
)
def test_no_window_gathers_all_rows(events, make):
    """Windows are partitioned by a chunk of the order or by the group; what meets in one task is a row per partition."""
    for part in plan(make(events)).split("\n"):
        if "Window [" in part:
            assert "chunk" in part or "user_id" in part or "__part" in part, part


@pytest.mark.parametrize(
    "make",
    [
        lambda e: window.cumulative_all(e, {"s": ("value", "sum")}, ["ts", "event_id"]),
        lambda e: window.rank_average(e, "value"),
        lambda e: clean.fill_forward(e, ["value"], ["ts", "event_id"]),
        lambda e: formula.with_column(e, "c", "CUMSUM(['value'])", ["ts", "event_id"]),
    ],
)
def test_running_values_meet_by_chunk(events, make):
    for part in plan(make(events)).split("\n"):
        if "Window [" in part:
            assert "__chunk" in part or "__part" in part, part


def test_python_stays_out_of_expressions(lines, events):
    for df in (
        formula.execute(lines, "NEW('a') = ['l_quantity'] * 2 + SUM(['l_tax']); NEW('b') = IF(['a'] > 3, 'x', UPPER(['l_returnflag']))"),
        relational.pivot(lines, ["l_linestatus"], "l_returnflag", "l_quantity", "sum"), clean.fill_with(events, ["value"], "median"), window.apply(events, {"d": window.diff("value")}, ["ts"], ["user_id"]),
    ):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_row_numbers_are_those_of_the_order(events):
    got = ordering.number_rows(events.repartition(13), [F.col("value").desc(), "event_id"], "at").orderBy("at").select("at", "event_id").collect()
    want = [r.event_id for r in events.orderBy(F.col("value").desc(), "event_id").collect()]
    assert [r.event_id for r in got] == want and [r.at for r in got] == list(range(len(want)))
