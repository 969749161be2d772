"""Registered queries of the engine's own operators, with the SQL that gives the same rows.

Each query runs an operator over whole tables. ``QUERIES`` maps a name to a
function of (spark, sf_dir), ``SQL`` to the statement for a SQL engine over the
same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import formula
from millrace.operators import aggregate as A
from millrace.operators import clean as C
from millrace.operators import encode as E
from millrace.operators import relational as R
from millrace.operators import window as WN
from millrace.operators.aggregate import Agg
from millrace.operators.window import Expanding, Rolling
from millrace.plans.registry import QUERIES, SQL, folder, formula_query, query, read, simple, stat_query  # noqa: F401

#: The shortest key of lineitem without repeated rows.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


# Filter, formula, grouping, order.


@query("flagship_slice", "SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS net_sum, avg(l_discount) AS disc_mean, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL")
def _flagship(spark, d):
    t = formula.filter_rows(read(spark, d, "lineitem"), "['l_quantity'] > 10")
    t = formula.execute(t, "NEW('net') = ['l_extendedprice'] * (1 - ['l_discount'])")
    t = A.group_aggregate(t, ["l_returnflag", "l_linestatus"], [Agg("net", "sum", "net_sum"), Agg("l_discount", "mean", "disc_mean"), Agg(None, "countall", "n")])
    return R.sort_by(t, [("l_returnflag", True), ("l_linestatus", True)])


# Aggregation.

simple("agg_numeric", "lineitem", lambda t: A.group_aggregate(t, ["l_returnflag", "l_linestatus"], [Agg("l_quantity", op, op) for op in ("sum", "mean", "min", "max", "std", "stdp", "var", "varp", "count", "nunique")]),
       "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum, avg(l_quantity) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, stddev_samp(l_quantity) AS std, stddev_pop(l_quantity) AS stdp, var_samp(l_quantity) AS var, var_pop(l_quantity) AS varp, count(l_quantity) AS count, count(DISTINCT l_quantity) AS nunique FROM lineitem GROUP BY ALL", rounded="sum mean std stdp var varp")
simple("agg_median", "lineitem", lambda t: A.group_aggregate(t, ["l_shipdate"], [Agg("l_extendedprice", "median", "median")]), "SELECT l_shipdate, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL")
simple("agg_first_last", "orders", lambda t: A.group_aggregate(t, ["o_custkey"], [Agg("o_totalprice", "first", "first"), Agg("o_totalprice", "last", "last"), Agg(None, "countall")], order_by="o_orderkey"),
       "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last, count(*) AS count_all FROM orders GROUP BY ALL")
simple("agg_all", "part", lambda t: A.aggregate_all(t.select("p_brand", "p_size", "p_retailprice"), ["p_brand"], "max"), "SELECT p_brand, CAST(max(p_size) AS DOUBLE) AS p_size_max, max(p_retailprice) AS p_retailprice_max FROM part GROUP BY ALL")
simple("agg_null_groups", "orders", lambda t: A.group_count(t.withColumn("status", F.nullif("o_orderstatus", F.lit("F"))), ["status"]), "SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS count FROM orders GROUP BY ALL")
simple("describe_numeric", "part", lambda t: A.describe(t), """
  WITH a AS (SELECT count(*)::DOUBLE AS c, avg(p_partkey) AS m1, stddev_samp(p_partkey) AS s1, quantile_cont(p_partkey::DOUBLE, [0, .25, .5, .75, 1]) AS q1, avg(p_size) AS m2, stddev_samp(p_size) AS s2, quantile_cont(p_size::DOUBLE, [0, .25, .5, .75, 1]) AS q2, avg(p_retailprice) AS m3, stddev_samp(p_retailprice) AS s3, quantile_cont(p_retailprice, [0, .25, .5, .75, 1]) AS q3 FROM part)
  SELECT unnest(['count', 'missing', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat, unnest([c, 0, m1, s1, q1[1], q1[2], q1[3], q1[4], q1[5]]) AS p_partkey, unnest([c, 0, m2, s2, q2[1], q2[2], q2[3], q2[4], q2[5]]) AS p_size, unnest([c, 0, m3, s3, q3[1], q3[2], q3[3], q3[4], q3[5]]) AS p_retailprice FROM a""", rounded="p_partkey p_size p_retailprice")
simple("describe_grouped", "lineitem", lambda t: A.group_describe(t.select("l_returnflag", "l_tax"), ["l_returnflag"], [0.5]), """
  SELECT l_returnflag, count(l_tax)::DOUBLE AS l_tax_count, 0.0::DOUBLE AS l_tax_missing, avg(l_tax) AS l_tax_mean, stddev_samp(l_tax) AS l_tax_std, min(l_tax) AS l_tax_min, median(l_tax) AS "l_tax_50%", max(l_tax) AS l_tax_max FROM lineitem GROUP BY ALL""", rounded="l_tax_mean l_tax_std", digits=9)
simple("column_stats", "part", lambda t: A.column_stats(t, "p_retailprice"), """
  WITH s AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) AS r, count(*) OVER () AS n FROM part),
  q AS (SELECT p, (SELECT x FROM s WHERE r = floor(p * (n + 1))) AS lo, (SELECT x FROM s WHERE r = floor(p * (n + 1)) + 1) AS hi, p * (n + 1) - floor(p * (n + 1)) AS f FROM (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p, (SELECT count(*) FROM part) AS n)),
  v AS (SELECT list(lo + (hi - lo) * f ORDER BY p) AS v FROM q)
  SELECT sum(x) AS sum, avg(x) AS mean, min(x) AS min, max(x) AS max, max(x) - min(x) AS range, median(x) AS median, exp(avg(ln(x))) AS gmean, var_samp(x) AS var, var_pop(x) AS varp, stddev_samp(x) AS stdev, stddev_pop(x) AS stdevp, (SELECT v[1] FROM v) AS q1, (SELECT v[2] FROM v) AS q2, (SELECT v[3] FROM v) AS q3, (SELECT v[3] - v[1] FROM v) AS iqr FROM s""", rounded="sum mean gmean var varp stdev stdevp")
simple("mad_about_median", "part", lambda t: A.mad_about_median(t, "p_retailprice"), "SELECT avg(abs(p_retailprice - (SELECT median(p_retailprice) FROM part))) AS mad FROM part", rounded="mad")
simple("weighted_mean", "lineitem", lambda t: A.weighted_mean(t, "l_discount", "l_quantity"), "SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS weighted_mean FROM lineitem", rounded="weighted_mean", digits=9)
simple("modes", "part", lambda t: A.modes(t, "p_size"), "WITH c AS (SELECT p_size AS mode, count(*) AS n FROM part GROUP BY ALL) SELECT mode, n FROM c WHERE n = (SELECT max(n) FROM c)")
simple("counter", "orders", lambda t: A.counter(t, "o_orderpriority"), "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY ALL")
simple("table_mean", "lineitem", lambda t: A.table_mean(t.select("l_quantity", "l_discount", "l_tax")), "SELECT (sum(l_quantity) + sum(l_discount) + sum(l_tax)) / (count(*) * 3) AS mean FROM lineitem", rounded="mean")


@query("quantiles_exact", "SELECT quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem")
def _quantiles(spark, d):
    q = A.quantiles(read(spark, d, "lineitem"), "l_extendedprice", (0.1, 0.5, 0.99))
    return spark.createDataFrame([(q[0.1], q[0.5], q[0.99])], "p10 double, p50 double, p99 double")


# Joins and unions.

_CUSTOMER_ORDERS = "SELECT {key} AS o_custkey, o_orderkey, o_totalprice, c_name, c_nationkey FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) o {how} JOIN (SELECT c_custkey, c_name, c_nationkey FROM customer) c ON o_custkey IS NOT DISTINCT FROM c_custkey"
for _how, _sql, _key in (("inner", "", "o_custkey"), ("left", "LEFT", "o_custkey"), ("right", "RIGHT", "coalesce(o_custkey, c_custkey)"), ("outer", "FULL", "coalesce(o_custkey, c_custkey)")):
    query(f"merge_{_how}", _CUSTOMER_ORDERS.format(key=_key, how=_sql))(
        lambda spark, d, how=_how: R.merge(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), how, ["o_custkey", "c_custkey"])
    )


@query("merge_nullsafe_suffix", "WITH n AS (SELECT nullif(n_regionkey, 2) AS k, n_name AS name FROM nation), r AS (SELECT nullif(r_regionkey, 2) AS k, r_name AS name FROM region) SELECT n.k, n.name, r.name AS name_other FROM n JOIN r ON n.k IS NOT DISTINCT FROM r.k")
def _null_merge(spark, d):
    n = read(spark, d, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k"), F.col("n_name").alias("name"))
    r = read(spark, d, "region").select(F.nullif("r_regionkey", F.lit(2)).alias("k"), F.col("r_name").alias("name"))
    return R.merge(n, r, "inner", "k")


@query("merge_vertical_inner", "SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def _stack_inner(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    return R.stack(s.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "s_name"), c.select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")), "inner")


@query("merge_vertical_outer", "SELECT s_nationkey AS nation, s_name, NULL AS c_name FROM supplier UNION ALL SELECT c_nationkey, NULL, c_name FROM customer")
def _stack_outer(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    return R.stack(s.select(F.col("s_nationkey").alias("nation"), "s_name"), c.select(F.col("c_nationkey").alias("nation"), "c_name"), "outer")


# Reshape, order, samples.

simple("pivot_sum", "orders", lambda t: R.pivot(t, ["o_orderpriority"], "o_orderstatus", "o_totalprice", "sum", fill=0.0, sort_columns=True),
       "SELECT o_orderpriority, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS F, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS O, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY ALL", rounded="F O P", digits=2)
simple("pivot_median", "lineitem", lambda t: R.pivot(t, ["l_linestatus"], "l_returnflag", "l_quantity", "median", sort_columns=True),
       "SELECT l_linestatus, median(l_quantity) FILTER (l_returnflag = 'A') AS A, median(l_quantity) FILTER (l_returnflag = 'N') AS N, median(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY ALL")
simple("unpivot", "part", lambda t: R.unpivot(t, ["p_partkey"], ["p_size", "p_retailprice"]), "SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
simple("transpose", "region", lambda t: R.transpose(t.select("r_regionkey", "r_name"), "r_regionkey"), "SELECT 'r_name' AS \"column\", max(r_name) FILTER (r_regionkey = 0) AS \"0\", max(r_name) FILTER (r_regionkey = 1) AS \"1\", max(r_name) FILTER (r_regionkey = 2) AS \"2\", max(r_name) FILTER (r_regionkey = 3) AS \"3\", max(r_name) FILTER (r_regionkey = 4) AS \"4\" FROM region")
simple("sort_multi", "orders", lambda t: R.sort_by(t.select("o_orderstatus", "o_totalprice", "o_orderkey"), [("o_orderstatus", False), ("o_totalprice", True)], tie="o_orderkey"), "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY 1 DESC, 2, 3")
simple("row_numbers", "events", lambda t: WN.ordering.number_rows(t.select("event_id", "ts"), ["ts", "event_id"], "place"), "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
simple("sample_n", "orders", lambda t: R.sample(t, 100, seed=3, keys=["o_orderkey"]), None)
simple("train_test_split", "orders", lambda t: R.train_test_split(t, 0.8, seed=3, keys=["o_orderkey"])[0].agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM orders")
simple("shuffle", "orders", lambda t: R.shuffle(t, seed=3, keys=["o_orderkey"]), "SELECT * FROM orders")

# Sequences: over the whole table in chunks, and per group.


def _events(t: DataFrame) -> DataFrame:
    return t.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))


_EV = "WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"
_ORDER, _BY = ["ts", "event_id"], ["user_id"]
_G = "(PARTITION BY user_id ORDER BY ts, event_id"

simple("shift_diff", "events", lambda t: WN.apply(_events(t), {"lag": WN.shift("v", 1), "lead": WN.shift("v", -2), "diff": WN.diff("v", 3), "pct": WN.pct_change("v", 1)}, _ORDER),
       f"{_EV} SELECT *, lag(v) OVER w AS lag, lead(v, 2) OVER w AS lead, v - lag(v, 3) OVER w AS diff, (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) AS pct FROM e WINDOW w AS (ORDER BY ts, event_id)", rounded="diff pct")
simple("rolling_global", "events", lambda t: WN.apply(_events(t), {"s": Rolling(5, min_obs=2).sum("v"), "m": Rolling(7, min_obs=1, center=True).mean("v"), "hi": Rolling(4).max("v")}, _ORDER),
       f"{_EV} SELECT *, CASE WHEN count(v) OVER a >= 2 THEN sum(v) OVER a END AS s, CASE WHEN count(v) OVER b >= 1 THEN avg(v) OVER b END AS m, CASE WHEN count(v) OVER c >= 4 THEN max(v) OVER c END AS hi FROM e WINDOW a AS (ORDER BY ts, event_id ROWS 4 PRECEDING), b AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), c AS (ORDER BY ts, event_id ROWS 3 PRECEDING)", rounded="s m")
simple("cumulative_global", "events", lambda t: WN.cumulative_all(_events(t), {"total": ("v", "sum"), "hi": ("v", "max"), "lo": ("v", "min")}, _ORDER),
       f"{_EV} SELECT *, CASE WHEN v IS NOT NULL THEN sum(v) OVER w END AS total, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS hi, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS lo FROM e WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", rounded="total")
simple("expanding_global", "events", lambda t: WN.expanding_all(_events(t), {"mean": ("v", "mean"), "lo": ("v", "min")}, _ORDER, min_obs=3),
       f"{_EV} SELECT *, CASE WHEN count(v) OVER w >= 3 THEN avg(v) OVER w END AS mean, CASE WHEN count(v) OVER w >= 3 THEN min(v) OVER w END AS lo FROM e WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)", rounded="mean", digits=9)
simple("group_shift", "events", lambda t: WN.apply(_events(t), {"lag": WN.shift("v", 1, 0.0), "diff": WN.diff("v"), "pct": WN.pct_change("v", 2)}, _ORDER, _BY),
       f"{_EV} SELECT *, lag(v, 1, 0) OVER w AS lag, v - lag(v) OVER w AS diff, (v - lag(v, 2) OVER w) / nullif(lag(v, 2) OVER w, 0) AS pct FROM e WINDOW w AS {_G})", rounded="diff pct")
simple("group_cumulative", "events", lambda t: WN.apply(_events(t), {k: WN.cumulative("v", k) for k in ("sum", "max", "min")} | {"product": WN.cumulative(F.lit(1) + F.col("v") / 1e6, "product")}, _ORDER, _BY),
       f"{_EV} SELECT *, CASE WHEN v IS NOT NULL THEN sum(v) OVER w END AS sum, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS max, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS min, CASE WHEN v IS NOT NULL THEN product(1 + v / 1e6) OVER w END AS product FROM e WINDOW w AS {_G} ROWS UNBOUNDED PRECEDING)", rounded="sum product")
simple("group_rolling", "events", lambda t: WN.apply(_events(t), {"sum": Rolling(4, 2).sum("v"), "mean": Rolling(4, 2).mean("v"), "min": Rolling(4, 2).min("v"), "max": Rolling(4, 2).max("v"), "std": Rolling(4, 2).std("v"), "var": Rolling(4, 2).var("v"), "median": Rolling(4, 2).median("v")}, _ORDER, _BY),
       f"{_EV} SELECT *, " + ", ".join(f"CASE WHEN count(v) OVER w >= 2 THEN {f}(v) OVER w END AS {n}" for n, f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"), ("var", "var_samp"), ("median", "median"))) + f" FROM e WINDOW w AS {_G} ROWS 3 PRECEDING)", rounded="sum mean std var")
simple("group_rolling_weighted", "events", lambda t: WN.apply(_events(t), {"sum": Rolling(3, 1, weights=(0.2, 0.3, 0.5)).sum("v"), "mean": Rolling(3, 1, weights=(0.2, 0.3, 0.5)).mean("v")}, _ORDER, _BY), f"""{_EV},
  l AS (SELECT *, lag(v, 2) OVER w AS a, lag(v) OVER w AS b FROM e WINDOW w AS {_G}))
  SELECT event_id, user_id, ts, v, CASE WHEN coalesce(a, b, v) IS NOT NULL THEN coalesce(a * 0.2::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0) + coalesce(v * 0.5::DOUBLE, 0) END AS sum,
    CASE WHEN coalesce(a, b, v) IS NOT NULL THEN (coalesce(a * 0.2::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0) + coalesce(v * 0.5::DOUBLE, 0)) / ((CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END) + (CASE WHEN v IS NULL THEN 0 ELSE 0.5::DOUBLE END)) END AS mean FROM l""", rounded="sum mean", digits=9)
simple("group_rolling_corr", "lineitem", lambda t: WN.apply(t.select("l_suppkey", *[k for k in LINE_KEY if k != "l_suppkey"], "l_quantity", "l_extendedprice"), {"corr": Rolling(20, 5).corr("l_quantity", "l_extendedprice")}, LINE_KEY, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", F.round("corr", 6).alias("corr")),
       "SELECT l_orderkey, l_linenumber, l_suppkey, round(CASE WHEN count(*) OVER w >= 5 THEN corr(l_quantity, l_extendedprice) OVER w END, 6) AS corr FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS 19 PRECEDING)")
simple("group_expanding", "events", lambda t: WN.apply(_events(t), {"sum": Expanding(2).sum("v"), "mean": Expanding(2).mean("v"), "std": Expanding(2).std("v"), "median": Expanding(2).median("v")}, _ORDER, _BY),
       f"{_EV} SELECT *, " + ", ".join(f"CASE WHEN count(v) OVER w >= 2 THEN {f}(v) OVER w END AS {n}" for n, f in (("sum", "sum"), ("mean", "avg"), ("std", "stddev_samp"), ("median", "median"))) + f" FROM e WINDOW w AS {_G} ROWS UNBOUNDED PRECEDING)", rounded="sum mean std", digits=9)
simple("rank_average", "part", lambda t: WN.rank_average(t.select("p_partkey", "p_size"), "p_size"), "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rank FROM part")
simple("moving_average", "events", lambda t: WN.moving_average(t.select("event_id", "user_id", "ts", "value"), "value", 3, _ORDER, _BY), "SELECT * FROM (SELECT event_id, user_id, ts, value, CASE WHEN count(*) OVER w = 3 THEN avg(value) OVER w END AS moving_average FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE moving_average IS NOT NULL", rounded="moving_average", digits=9)
simple("exponential_smoothing", "events", lambda t: WN.smoothing(t.select("event_id", "user_id", "value"), "value", 0.5, "event_id", ["user_id"]), """
  WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  s AS (SELECT event_id, user_id, value, r, value AS smoothed FROM o WHERE r = 1 UNION ALL SELECT o.event_id, o.user_id, o.value, o.r, 0.5 * o.value + 0.5 * s.smoothed FROM o JOIN s ON o.user_id = s.user_id AND o.r = s.r + 1)
  SELECT event_id, user_id, value, smoothed FROM s""", rounded="smoothed", digits=9)

# Filters, replacement, imputation.

simple("filter_formula", "lineitem", lambda t: formula.filter_rows(t.select("l_orderkey", "l_quantity", "l_discount"), "10 < ['l_quantity'] <= 20 && ['l_discount'] >= 0.05"), "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE 10 < l_quantity AND l_quantity <= 20 AND l_discount >= 0.05")
simple("filter_rows_any", "part", lambda t: C.filter_rows(t, lambda df, c: C.contains_text(df, c, "STEEL")), "SELECT * FROM part WHERE contains(p_name, 'STEEL') OR contains(p_brand, 'STEEL') OR contains(p_type, 'STEEL')")
simple("filter_cells", "part", lambda t: C.filter_cells(t.select("p_partkey", "p_size"), lambda df, c: F.col(c) > 40), "SELECT CASE WHEN p_partkey > 40 THEN p_partkey END AS p_partkey, CASE WHEN p_size > 40 THEN p_size END AS p_size FROM part WHERE p_partkey > 40 OR p_size > 40")
simple("drop_rows_nil", "orders", lambda t: C.drop_rows(t.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s")), "nil"), "SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'")
simple("drop_columns_string", "customer", lambda t: C.drop_columns(t, "string"), "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
simple("count_value", "orders", lambda t: C.count_value(t, "F"), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
simple("find_rows", "nation", lambda t: C.find_rows(t, values=[3], rid="n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_nationkey = 3 OR n_regionkey = 3")
simple("replace_value", "orders", lambda t: C.replace(t.select("o_orderkey", "o_orderstatus"), "O", "open"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
simple("replace_missing", "events", lambda t: C.replace_missing(_events(t), 0.0, columns=["v"]), f"{_EV} SELECT event_id, user_id, ts, coalesce(v, 0) AS v FROM e")
simple("replace_outliers", "lineitem", lambda t: C.replace_outliers(t.select(*LINE_KEY, "l_extendedprice"), "l_extendedprice", 2.0, -1.0), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN abs(l_extendedprice - m) > 2 * s THEN -1 ELSE l_extendedprice END AS l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)")
simple("clear_outliers", "lineitem", lambda t: C.clear_outliers(t.select("l_orderkey", "l_extendedprice"), "l_extendedprice", 1.5), "SELECT l_orderkey, l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) WHERE abs(l_extendedprice - m) <= 1.5 * s")
simple("fill_forward", "events", lambda t: C.fill_forward(_events(t), ["v"], _ORDER), f"{_EV} SELECT event_id, user_id, ts, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id) AS v FROM e")
simple("fill_backward_grouped", "events", lambda t: C.fill_backward(_events(t), ["v"], _ORDER, _BY), f"{_EV} SELECT event_id, user_id, ts, first_value(v IGNORE NULLS) OVER {_G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM e")
simple("fill_forward_limit", "events", lambda t: C.fill_forward(t.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v")), ["v"], _ORDER, limit=1),
       "WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events) SELECT event_id, user_id, ts, coalesce(v, lag(v) OVER (ORDER BY ts, event_id)) AS v FROM e")
for _how, _f in (("mean", "avg(v)"), ("median", "median(v)")):
    simple(f"fill_{_how}", "events", lambda t, how=_how: C.fill_with(_events(t), ["v"], how), f"{_EV} SELECT event_id, user_id, ts, coalesce(v, (SELECT {_f} FROM e)) AS v FROM e")
simple("fill_mode", "orders", lambda t: C.fill_with(t.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")), ["p"], "mode", order_by="o_orderkey"),
       "WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) SELECT o_orderkey, coalesce(p, (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)) AS p FROM o")
simple("fill_interpolated", "events", lambda t: C.fill_interpolated(_events(t), ["v"], _ORDER, _BY), f"""{_EV},
  r AS (SELECT *, row_number() OVER {_G}) AS i FROM e),
  n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS lv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS li, first_value(v IGNORE NULLS) OVER b AS rv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ri FROM r WINDOW a AS {_G} ROWS UNBOUNDED PRECEDING), b AS {_G} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, user_id, ts, coalesce(v, lv + (rv - lv) * (i - li) / (ri - li)) AS v FROM n""", rounded="v", digits=9)

# Encoding and scaling.

simple("onehot", "orders", lambda t: E.OneHotEncoder("o_orderstatus").fit(t := t.select("o_orderkey", "o_orderstatus"), "lexicographic").transform(t), "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
simple("label_first_seen", "orders", lambda t: E.LabelEncoder("o_orderpriority").fit(t := t.select("o_orderkey", "o_orderpriority"), "o_orderkey").transform(t),
       "WITH f AS (SELECT o_orderpriority AS p, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INT) AS i FROM orders GROUP BY 1) SELECT o_orderkey, i AS o_orderpriority FROM orders JOIN f ON o_orderpriority = p")
simple("label_frequency", "orders", lambda t: E.LabelEncoder("o_orderpriority", "frequency").fit(t := t.select("o_orderkey", "o_orderpriority")).transform(t),
       "WITH f AS (SELECT o_orderpriority AS p, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS INT) AS i FROM orders GROUP BY 1) SELECT o_orderkey, i AS o_orderpriority FROM orders JOIN f ON o_orderpriority = p")
simple("ordinal", "orders", lambda t: E.OrdinalEncoder("o_orderstatus", values=["P", "O", "F"]).fit(t := t.select("o_orderkey", "o_orderstatus")).transform(t), "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o_orderstatus FROM orders")
for _kind, _c, _s in (("standard", "avg(p_retailprice)", "stddev_samp(p_retailprice)"), ("minmax", "min(p_retailprice)", "max(p_retailprice) - min(p_retailprice)"), ("maxabs", "min(0)", "max(abs(p_retailprice))")):
    simple(f"scale_{_kind}", "part", lambda t, kind=_kind: E.Scaler(kind).fit_transform(t.select("p_partkey", "p_retailprice"), ["p_retailprice"]), f"SELECT p_partkey, (p_retailprice - (SELECT {_c} FROM part)) / (SELECT {_s} FROM part) AS p_retailprice FROM part")
simple("scale_robust", "part", lambda t: E.Scaler("robust").fit_transform(t.select("p_partkey", "p_retailprice"), ["p_retailprice"]), """
  WITH s AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) AS r, count(*) OVER () AS n FROM part),
  q AS (SELECT list(lo + (hi - lo) * f ORDER BY p) AS v FROM (SELECT p, (SELECT x FROM s WHERE r = floor(p * (n + 1))) AS lo, (SELECT x FROM s WHERE r = floor(p * (n + 1)) + 1) AS hi, p * (n + 1) - floor(p * (n + 1)) AS f FROM (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p, (SELECT count(*) FROM part) AS n)))
  SELECT p_partkey, (p_retailprice - (SELECT v[2] FROM q)) / (SELECT v[3] - v[1] FROM q) AS p_retailprice FROM part""", rounded="p_retailprice", digits=9)
simple("scale_inverse", "part", lambda t: (s := E.Scaler("standard").fit(t := t.select("p_partkey", "p_retailprice"), ["p_retailprice"])).inverse_transform(s.transform(t)).withColumn("p_retailprice", F.round("p_retailprice", 6)), "SELECT p_partkey, round(p_retailprice, 6) AS p_retailprice FROM part")

# Formulas.


formula_query("ccl_arith", "lineitem", [*LINE_KEY, "l_quantity", "l_extendedprice"], "NEW('a') = F + G * 2; NEW('b') = (G - F) / F; NEW('c') = -F ^ 2; NEW('d') = ['l_quantity'] % 7", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_quantity + l_extendedprice * 2 AS a, (l_extendedprice - l_quantity) / l_quantity AS b, -(l_quantity * l_quantity) AS c, l_quantity % 7 AS d FROM lineitem")
formula_query("ccl_if_nested", "lineitem", [*LINE_KEY, "l_quantity", "l_extendedprice"], "NEW('r') = IF(AND(F > 10, G < 50000), F * 2 + G, 0)", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, CASE WHEN l_quantity > 10 AND l_extendedprice < 50000 THEN l_quantity * 2 + l_extendedprice ELSE 0 END AS r FROM lineitem")
formula_query("ccl_compare_chain", "part", ["p_partkey", "p_size"], "NEW('in') = 10 < B <= 20; NEW('ne') = B != 7", "SELECT p_partkey, p_size, p_size > 10 AND p_size <= 20 AS \"in\", p_size <> 7 AS ne FROM part")
formula_query("ccl_logic_case", "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"], "NEW('g') = CASE(['o_orderstatus'] == 'F', 'done', C > 100000 || C < 1000, 'odd', 'open'); NEW('x') = OR(C > 5, false) && true", "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 100000 OR o_totalprice < 1000 THEN 'odd' ELSE 'open' END AS g, o_totalprice > 5 AS x FROM orders")
formula_query("ccl_string", "customer", ["c_custkey", "c_name", "c_mktsegment"], "NEW('a') = UPPER(B) & '-' & LOWER(C) & '-' & A; NEW('l') = LEN(B); NEW('s') = MID(B, 3, 4) & LEFT(C, 2) & RIGHT(C, 2); NEW('f') = FIND('e', C); NEW('r') = REPLACE(B, '0', 'o'); NEW('c') = CONTAINS(C, 'ING'); NEW('e') = STARTSWITH(C, 'A') || ENDSWITH(C, 'Y'); NEW('m') = REGEX_MATCH(C, '^[A-M]')",
              "SELECT c_custkey, c_name, c_mktsegment, upper(c_name) || '-' || lower(c_mktsegment) || '-' || c_custkey AS a, length(c_name)::DOUBLE AS l, substr(c_name, 3, 4) || left(c_mktsegment, 2) || right(c_mktsegment, 2) AS s, strpos(c_mktsegment, 'e')::DOUBLE AS f, replace(c_name, '0', 'o') AS r, contains(c_mktsegment, 'ING') AS c, starts_with(c_mktsegment, 'A') OR ends_with(c_mktsegment, 'Y') AS e, regexp_matches(c_mktsegment, '^[A-M]') AS m FROM customer")
formula_query("ccl_date", "orders", ["o_orderkey", "o_orderdate"], "NEW('y') = YEAR(B) * 100 + MONTH(B); NEW('d') = DAYOFMONTH(B); NEW('w') = WEEKDAY(B); NEW('n') = DATEADD(B, 10, 'day'); NEW('diff') = DATEDIFF(['n'], B, 'hour'); NEW('days') = DAY(['n'] - B); NEW('t') = FORMAT_DATE(B, '2006/01/02')",
              "SELECT o_orderkey, o_orderdate, (year(o_orderdate) * 100 + month(o_orderdate))::DOUBLE AS y, day(o_orderdate)::DOUBLE AS d, dayofweek(o_orderdate)::DOUBLE AS w, o_orderdate + INTERVAL 10 DAY AS n, 240.0::DOUBLE AS diff, 10.0::DOUBLE AS days, strftime(o_orderdate, '%Y/%m/%d') AS t FROM orders")
formula_query("ccl_math", "part", ["p_partkey", "p_size", "p_retailprice"], "NEW('r') = ROUND(C / 7, 2); NEW('f') = FLOOR(C) + CEIL(C) + TRUNC(-C); NEW('s') = SQRT(B) + POW(B, 2) + EXP(B / 100); NEW('l') = LN(C) + LOG10(C) + LOG(C, 2); NEW('g') = SIGN(B - 25) * ABS(B - 25) + MOD(B, 4)",
              "SELECT p_partkey, p_size, p_retailprice, sign(p_retailprice) * floor(abs(p_retailprice / 7) * 100 + 0.5) / 100 AS r, floor(p_retailprice) + ceil(p_retailprice) + ceil(-p_retailprice) AS f, sqrt(p_size) + p_size ^ 2 + exp(p_size / 100) AS s, ln(p_retailprice) + log10(p_retailprice) + ln(p_retailprice) / ln(2) AS l, (sign(p_size - 25) * abs(p_size - 25) + p_size % 4)::DOUBLE AS g FROM part")
formula_query("ccl_convert", "orders", ["o_orderkey", "o_orderpriority"], "NEW('n') = TONUM(LEFT(B, 1)); NEW('t') = TOSTR(A) & '!'; NEW('b') = IFNULL(TOBOOL(LEFT(B, 1)), false); NEW('i') = IFNULL(TONUM(B), 0 - 1); NEW('c') = COALESCE(nil, TONUM(B), A)",
              "SELECT o_orderkey, o_orderpriority, CAST(left(o_orderpriority, 1) AS DOUBLE) AS n, o_orderkey || '!' AS t, left(o_orderpriority, 1) = '1' AS b, -1.0::DOUBLE AS i, o_orderkey::DOUBLE AS c FROM orders")
formula_query("ccl_aggregate_broadcast", "part", ["p_partkey", "p_size", "p_retailprice"], "NEW('share') = C / SUM(C); NEW('z') = (B - AVG(B)) / STDEV(B); NEW('t') = SUM(B * C) + COUNT(A) + MAX(B) - MIN(B:C) + MEDIAN(B)",
              "SELECT p_partkey, p_size, p_retailprice, p_retailprice / (SELECT sum(p_retailprice) FROM part) AS share, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part) AS z, (SELECT sum(p_size * p_retailprice) + count(*) + max(p_size) - least(min(p_size), min(p_retailprice)) + median(p_size) FROM part) AS t FROM part")
formula_query("ccl_sequence", "events", ["event_id", "ts", "value"], "NEW('l') = LAG(C, 1); NEW('d') = DIFF(C, 2); NEW('p') = PCT_CHANGE(C); NEW('cs') = CUMSUM(C); NEW('cm') = CUMMAX(C); NEW('rm') = ROLLING_MEAN(C, 3); NEW('rs') = ROLLING_STD(C, 4)",
              "SELECT event_id, ts, value, lag(value) OVER w AS l, value - lag(value, 2) OVER w AS d, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS p, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS cs, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS cm, CASE WHEN count(*) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(value) OVER (w ROWS 2 PRECEDING) END AS rm, CASE WHEN count(*) OVER (w ROWS 3 PRECEDING) = 4 THEN stddev_samp(value) OVER (w ROWS 3 PRECEDING) END AS rs FROM events WINDOW w AS (ORDER BY ts, event_id)", ["ts", "event_id"])
formula_query("ccl_row_access", "nation", ["n_nationkey", "n_name", "n_regionkey"], "NEW('first') = B.0; NEW('before') = A.(# - 1); NEW('at') = # * 2; NEW('rows') = SUM((A:C).(0:2)); NEW('mine') = SUM(A, C, #)",
              "SELECT n_nationkey, n_name, n_regionkey, (SELECT arg_min(n_name, n_nationkey) FROM nation) AS first, lag(n_nationkey) OVER (ORDER BY n_nationkey) AS before, (row_number() OVER (ORDER BY n_nationkey) - 1)::DOUBLE * 2 AS at, (SELECT sum(n_nationkey + n_regionkey)::DOUBLE FROM nation WHERE n_nationkey < 3) AS rows, (n_nationkey + n_regionkey + row_number() OVER (ORDER BY n_nationkey) - 1)::DOUBLE AS mine FROM nation", ["n_nationkey"])
formula_query("ccl_script", "lineitem", [*LINE_KEY, "l_extendedprice", "l_discount", "l_tax"], "NEW('net') = ['l_extendedprice'] * (1 - ['l_discount'])\nNEW('charge') = ['net'] * (1 + ['l_tax'])\n['l_discount'] = ROUND(['l_discount'] * 100)",
              "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, floor(l_discount * 100 + 0.5) AS l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")

# Statistics: the statistic by SQL, p-values by tests of their own.

from millrace.functions import finance, multivariate, regression  # noqa: E402
from millrace.functions import statistics as S  # noqa: E402
from millrace.operators import marketing  # noqa: E402


stat_query("covariance_correlation", "lineitem", lambda t: {"cov": S.covariance(t, "l_quantity", "l_tax"), "pearson": S.pearson(t, "l_quantity", "l_extendedprice").statistic}, "SELECT covar_samp(l_quantity, l_tax) AS cov, corr(l_quantity, l_extendedprice) AS pearson FROM lineitem")
stat_query("correlation_spearman", "part", lambda t: {"rho": S.spearman(t, "p_size", "p_retailprice").statistic}, "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part) SELECT corr(a, b) AS rho FROM r")
stat_query("correlation_kendall", "supplier", lambda t: {"tau": S.kendall(t, "s_nationkey", "s_acctbal").statistic}, "WITH p AS (SELECT sign(a.s_nationkey - b.s_nationkey) AS x, sign(a.s_acctbal - b.s_acctbal) AS y FROM supplier a, supplier b WHERE a.s_suppkey < b.s_suppkey) SELECT sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS tau FROM p")
stat_query("moments", "lineitem", lambda t: {"skew": S.skewness(t, "l_extendedprice"), "kurt": S.kurtosis(t, "l_extendedprice"), "m4": S.moment(t, "l_quantity", 4) / 1e3}, "WITH m AS (SELECT avg(l_extendedprice) AS m, avg(l_quantity) AS ms FROM lineitem) SELECT avg((l_extendedprice - m) ^ 3) / avg((l_extendedprice - m) ^ 2) ^ 1.5 AS skew, avg((l_extendedprice - m) ^ 4) / avg((l_extendedprice - m) ^ 2) ^ 2 - 3 AS kurt, avg((l_quantity - ms) ^ 4) / 1e3 AS m4 FROM lineitem, m")
_two = "(SELECT count(*) AS n1, avg(l_quantity) AS m1, var_samp(l_quantity) AS v1 FROM lineitem WHERE l_returnflag = 'A'), (SELECT count(*) AS n2, avg(l_quantity) AS m2, var_samp(l_quantity) AS v2 FROM lineitem WHERE l_returnflag = 'R')"
_ar = lambda t: ((t.filter("l_returnflag = 'A'"), "l_quantity"), (t.filter("l_returnflag = 'R'"), "l_quantity"))
stat_query("ttest_single", "lineitem", lambda t: {"t": S.t_test_single((t, "l_quantity"), 25.0).statistic}, "SELECT (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS t FROM lineitem")
stat_query("ttest_welch", "lineitem", lambda t: {"t": (r := S.t_test_two(*_ar(t))).statistic, "df": r.df / 1e3}, f"SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) / 1e3 AS df FROM {_two}")
stat_query("ttest_pooled", "lineitem", lambda t: {"t": S.t_test_two(*_ar(t), equal_variance=True).statistic}, f"SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM {_two}")
stat_query("ttest_paired", "part", lambda t: {"t": S.t_test_paired(t, "p_retailprice", "p_size").statistic}, "SELECT avg(p_retailprice - p_size) / (stddev_samp(p_retailprice - p_size) / sqrt(count(*))) AS t FROM part")
stat_query("ztest", "lineitem", lambda t: {"z": S.z_test_single((t, "l_quantity"), 25.0, 14.0).statistic, "z2": S.z_test_two(*_ar(t), 14.0, 15.0).statistic}, f"SELECT (SELECT (avg(l_quantity) - 25) / (14 / sqrt(count(*))) FROM lineitem) AS z, (m1 - m2) / sqrt(196 / n1 + 225 / n2) AS z2 FROM {_two}")
stat_query("ftest_variance", "lineitem", lambda t: {"f": S.f_test_variance(*_ar(t)).statistic}, f"SELECT v1 / v2 AS f FROM {_two}")
stat_query("anova_one_way", "lineitem", lambda t: {"f": S.anova_one_way(t, "l_quantity", "l_returnflag").statistic}, "WITH g AS (SELECT count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), a AS (SELECT avg(l_quantity) AS gm, count(*) AS t FROM lineitem) SELECT (sum(n * (m - gm) ^ 2) / (count(*) - 1)) / (sum((n - 1) * v) / (max(t) - count(*))) AS f FROM g, a")
stat_query("levene", "lineitem", lambda t: {"w": S.levene(t, "l_quantity", "l_returnflag").statistic}, "WITH d AS (SELECT l_returnflag AS k, abs(l_quantity - median(l_quantity) OVER (PARTITION BY l_returnflag)) AS x FROM lineitem), g AS (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY k), a AS (SELECT avg(x) AS gm, count(*) AS t FROM d) SELECT (sum(n * (m - gm) ^ 2) / (count(*) - 1)) / (sum((n - 1) * v) / (max(t) - count(*))) AS w FROM g, a")
stat_query("bartlett", "lineitem", lambda t: {"t": S.bartlett(t, "l_quantity", "l_returnflag").statistic}, "WITH g AS (SELECT count(*) AS n, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), s AS (SELECT sum(n) AS t, count(*) AS k, sum((n - 1) * v) / (sum(n) - count(*)) AS p, sum((n - 1) * ln(v)) AS l, sum(1 / (n - 1)) AS q FROM g) SELECT ((t - k) * ln(p) - l) / (1 + (q - 1 / (t - k)) / (3 * (k - 1))) AS t FROM s")
stat_query("chisq_independence", "orders", lambda t: {"chi2": (r := S.chi_square_independence(t, "o_orderstatus", "o_orderpriority")).statistic, "df": r.df}, "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c) SELECT sum((n - x) ^ 2 / x) AS chi2, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS df FROM e")
stat_query("chisq_fit", "orders", lambda t: {"chi2": S.chi_square_fit(t, "o_orderpriority").statistic}, "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority), e AS (SELECT avg(n) AS x FROM c) SELECT sum((n - x) ^ 2 / x) AS chi2 FROM c, e")
_ranks = "SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem"
stat_query("kruskal_wallis", "lineitem", lambda t: {"h": S.kruskal_wallis(t, "l_quantity", "l_returnflag").statistic}, f"WITH r AS ({_ranks}), s AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY g), t AS (SELECT sum(c ^ 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity)) SELECT (12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - max(t) / (sum(n)::DOUBLE ^ 3 - sum(n))) AS h FROM s, t")
stat_query("mann_whitney", "lineitem", lambda t: {"u": S.mann_whitney(*_ar(t)).statistic}, f"WITH r AS ({_ranks.replace('FROM lineitem', chr(70) + 'ROM lineitem WHERE l_returnflag IN (' + chr(39) + 'A' + chr(39) + ', ' + chr(39) + 'R' + chr(39) + ')')}) SELECT sum(r) - count(*) * (count(*) + 1) / 2 AS u FROM r WHERE g = 'A'")
stat_query("ols_simple", "part", lambda t: {"a": (f := regression.linear(t, "p_retailprice", ["p_size"])).coefficients[0], "b": f.coefficients[1], "r2": f.measures["r2"]}, "SELECT regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) AS b, regr_r2(p_retailprice, p_size) AS r2 FROM part")
stat_query("ols_logarithmic", "part", lambda t: {"a": (f := regression.logarithmic(t, "p_retailprice", "p_size")).coefficients[0], "b": f.coefficients[1]}, "SELECT regr_intercept(p_retailprice, ln(p_size)) AS a, regr_slope(p_retailprice, ln(p_size)) AS b FROM part WHERE p_size > 0")
stat_query("ols_exponential", "part", lambda t: {"a": (f := regression.exponential(t, "p_retailprice", "p_size")).measures["a"], "b": f.measures["b"]}, "SELECT exp(regr_intercept(ln(p_retailprice), p_size)) AS a, regr_slope(ln(p_retailprice), p_size) AS b FROM part")
stat_query("glm_logistic", "lineitem", lambda t: dict(zip("ab", regression.logistic(t.withColumn("y", (F.col("l_returnflag") == "R").cast("double")), "y", ["l_quantity"]).coefficients)), None)
stat_query("glm_poisson", "part", lambda t: dict(zip("ab", regression.poisson(t, "p_size", ["p_retailprice"]).coefficients)), None)


@query("pca")
def _pca(spark, d):
    c = multivariate.pca(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([(i, float(v), [float(x) for x in c.vectors[:, i]]) for i, v in enumerate(c.values)], "component int, eigenvalue double, loadings array<double>")


@query("kmeans")
def _kmeans(spark, d):
    t, names = read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return multivariate.assign(t, names, multivariate.kmeans(t, names, 5)).select(*LINE_KEY, "cluster")


query("knn_neighbors", """
  WITH p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INT) AS rank FROM p)
  SELECT vec_id, rank, neighbor_id, round(distance, 8) AS distance FROM r WHERE rank <= 5""")(
    lambda spark, d: multivariate.nearest_neighbors(e := read(spark, d, "embeddings"), e.filter("vec_id % 50 = 0"), "embedding", 5, "vec_id", "vec_id").withColumn("distance", F.round("distance", 8))
)
query("knn_classify", """
  WITH p AS (SELECT a.vec_id, b.vec_id AS i, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, i) AS rank FROM p), v AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rank <= 7 GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label::VARCHAR) AS k FROM v) SELECT vec_id, label AS predicted FROM w WHERE k = 1""")(
    lambda spark, d: multivariate.knn_classify(e := read(spark, d, "embeddings"), e.filter("vec_id % 50 = 0"), "embedding", "label", 7, "vec_id", "vec_id")
)

# Marketing and finance.

query("rfm", """
  WITH c AS (SELECT o_custkey AS customer, date_diff('day', max(o_orderdate)::DATE, DATE '2000-01-01')::DOUBLE AS recency, count(DISTINCT o_orderdate::DATE)::DOUBLE AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
  q AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS r, quantile_cont(frequency, [0.2, 0.4, 0.6, 0.8]) AS f, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM c),
  s AS (SELECT customer, 1 + len(list_filter(r, lambda t: recency <= t)) AS r_score, 1 + len(list_filter(f, lambda t: frequency > t)) AS f_score, 1 + len(list_filter(m, lambda t: monetary > t)) AS m_score FROM c, q)
  SELECT customer, r_score::INT AS r_score, f_score::INT AS f_score, m_score::INT AS m_score, (r_score + f_score + m_score)::INT AS rfm_score FROM s""")(
    lambda spark, d: marketing.rfm(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "2000-01-01")
)
query("customer_activity_index", """
  WITH k AS (SELECT o_custkey AS customer, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING count(*) >= 3),
  p AS (SELECT o_custkey AS customer, o_orderdate AS d FROM orders WHERE o_custkey IN (SELECT customer FROM k) UNION ALL SELECT customer, (SELECT max(last) FROM k) FROM k),
  g AS (SELECT customer, d, date_diff('day', lag(d) OVER w, d)::DOUBLE AS gap FROM p WINDOW w AS (PARTITION BY customer ORDER BY d)),
  n AS (SELECT customer, gap, row_number() OVER (PARTITION BY customer ORDER BY d) AS k FROM g WHERE gap > 0),
  a AS (SELECT customer, avg(gap) AS mle, sum(gap * k) / sum(k) AS wmle FROM n GROUP BY 1)
  SELECT customer, round(mle, 8) AS mle, round(wmle, 8) AS wmle, round((mle - wmle) / mle * 100, 8) AS cai FROM a""")(
    lambda spark, d: marketing.customer_activity_index(read(spark, d, "orders"), "o_custkey", "o_orderdate").select("customer", *[F.round(c, 8).alias(c) for c in ("mle", "wmle", "cai")])
)
query("basket", """
  WITH d AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT o) AS t FROM d), c AS (SELECT i, count(*) AS c FROM d GROUP BY 1),
  p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS n FROM d a JOIN d b USING (o) GROUP BY 1, 2)
  SELECT item_a, item_b, n, round(n / t, 10) AS support, round(n / x.c, 10) AS confidence, round((n / t) / (x.c / t * (y.c / t)), 10) AS lift FROM p JOIN c x ON item_a = x.i JOIN c y ON item_b = y.i, n""")(
    lambda spark, d: marketing.basket(read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand").select("item_a", "item_b", "n", *[F.round(c, 10).alias(c) for c in ("support", "confidence", "lift")])
)
simple("fin_columns", "orders", lambda t: t.select("o_orderkey", finance.sln_column(F.col("o_totalprice"), F.lit(100.0), F.lit(7.0)).alias("sln"), finance.pmt_column(F.lit(0.005), F.lit(360.0), F.col("o_totalprice")).alias("pmt")),
       "SELECT o_orderkey, (o_totalprice - 100) / 7 AS sln, -o_totalprice * 1.005::DOUBLE ^ 360 * 0.005::DOUBLE / (1.005::DOUBLE ^ 360 - 1) AS pmt FROM orders", rounded="sln pmt")
simple("fin_npv", "lineitem", lambda t: finance.npv_by_group(t, 0.01, "l_orderkey", "l_extendedprice", "l_linenumber"), "SELECT l_orderkey, sum(l_extendedprice / 1.01::DOUBLE ^ l_linenumber) AS npv FROM lineitem GROUP BY 1", rounded="npv", digits=4)
query("fin_amortization", """
  WITH RECURSIVE c AS (SELECT 0.005::DOUBLE AS r, -(100000 * 1.005::DOUBLE ^ 24 * 0.005::DOUBLE / (1.005::DOUBLE ^ 24 - 1)) AS p),
  s AS (SELECT 0 AS period, 0.0::DOUBLE AS interest, 0.0::DOUBLE AS principal, 100000.0::DOUBLE AS balance UNION ALL SELECT period + 1, -balance * r, p + balance * r, balance + p + balance * r FROM s, c WHERE period < 24)
  SELECT period, round(p, 4) AS payment, round(interest, 4) AS interest, round(principal, 4) AS principal, round(balance, 3) + 0.0 AS balance FROM s, c WHERE period > 0""")(
    lambda spark, d: finance.schedule_table(spark, "0.005", 24, 100000).select("period", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("payment", "interest", "principal")], (F.round(F.col("balance").cast("double"), 3) + 0.0).alias("balance"))
)

# Parquet, SQL, time windows.

from millrace.sources import parquet as parquet_source  # noqa: E402
from millrace.sources import sql as sql_source  # noqa: E402
from millrace.streaming import events as streams  # noqa: E402

query("scan_parquet_columns", "SELECT o_orderkey, o_totalprice FROM orders")(lambda spark, d: parquet_source.read(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"]))
query("parquet_formula_filter", "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")(lambda spark, d: parquet_source.filter_formula(spark, f"{d}/lineitem.parquet", "['l_quantity'] > 45 && ['l_discount'] <= 0.02"))


@query("sql_query", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def _sql_query(spark, d):
    read(spark, d, "nation").createOrReplaceTempView("nation_of_query")
    return sql_source.read(spark, sql_source.Query(table="nation_of_query", columns=["n_name", "n_regionkey"], where="n_regionkey = 1"))


simple("tumbling_window", "events", lambda t: streams.tumbling(t, "ts", "1 hour", ["event_type"], {"n": ("value", "count"), "hi": ("value", "max")}),
       "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(value) AS n, max(value) AS hi FROM events GROUP BY ALL")
simple("sessions", "events", lambda t: streams.sessions(t, "ts", "2 hours", ["user_id"], {"n": ("event_id", "count")}), """
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
simple("time_bucket", "orders", lambda t: t.groupBy(streams.time_bucket(F.col("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n")), "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1")

# Files and the rest of the inventory.

from millrace.sources import text as text_source  # noqa: E402
from millrace.table import Table  # noqa: E402


@query("scan_csv_types", "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _csv(spark, d):
    at = folder(spark)
    text_source.write_csv(read(spark, d, "customer"), at)
    return text_source.read_csv(spark, f"{at}/*.csv", encoding="utf-8")


@query("scan_json", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _json(spark, d):
    at = folder(spark)
    text_source.write_json(read(spark, d, "nation"), at)
    return spark.read.json(at)


@query("table_chain", "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _chain(spark, d):
    t = Table(read(spark, d, "orders"), order_by="o_orderkey").filter("['o_totalprice'] > 1000").group_by("o_orderpriority").aggregate(Agg("o_totalprice", "sum", "total"), Agg(None, "countall", "n"))
    return t.df.drop("__rid")


simple("label_lexicographic", "orders", lambda t: E.LabelEncoder("o_orderpriority", "lexicographic").fit(t := t.select("o_orderkey", "o_orderpriority")).transform(t), "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority FROM orders")
simple("onehot_drop_first", "orders", lambda t: E.OneHotEncoder("o_orderstatus", drop_first=True, keep_original=True).fit(t := t.select("o_orderkey", "o_orderstatus"), "lexicographic").transform(t), "SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
simple("weighted_moving_average", "events", lambda t: WN.weighted_moving_average(t.select("event_id", "user_id", "ts", "value"), "value", 2, (1.0, 3.0), _ORDER, _BY), "SELECT * FROM (SELECT event_id, user_id, ts, value, (lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 3 * value) / 4 AS weighted_moving_average FROM events) WHERE weighted_moving_average IS NOT NULL", rounded="weighted_moving_average", digits=8)
simple("moving_stdev", "events", lambda t: WN.moving_stdev(t.select("event_id", "user_id", "ts", "value"), "value", 3, _ORDER, _BY), "SELECT * FROM (SELECT event_id, user_id, ts, value, CASE WHEN count(*) OVER w = 3 THEN stddev_samp(value) OVER w END AS moving_stdev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE moving_stdev IS NOT NULL", rounded="moving_stdev")
simple("normalize_standardize", "part", lambda t: t.crossJoin(F.broadcast(A.column_stats(t, "p_retailprice", ["min", "range", "mean", "stdev"]))).select("p_partkey", ((F.col("p_retailprice") - F.col("min")) / F.col("range")).alias("n"), ((F.col("p_retailprice") - F.col("mean")) / F.col("stdev")).alias("s")),
       "SELECT p_partkey, (p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS n, (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part) AS s FROM part", rounded="n s", digits=9)
simple("drop_columns_value", "nation", lambda t: C.drop_columns(t, values=[24]), "SELECT n_name, n_regionkey FROM nation")
simple("find_rows_substring", "nation", lambda t: C.find_rows(t, part="AN", rid="n_nationkey"), "SELECT n_nationkey FROM nation WHERE contains(n_name, 'AN')")
simple("replace_nulls_text", "orders", lambda t: C.replace_missing(t.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")), "none"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS s FROM orders")
simple("fill_backward", "events", lambda t: C.fill_backward(_events(t), ["v"], _ORDER), f"{_EV} SELECT event_id, user_id, ts, first_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM e")
simple("ccl_filter_functions", "customer", lambda t: formula.filter_rows(t, "CONTAINS(['c_mktsegment'], 'U') && ['c_acctbal'] > AVG(['c_acctbal'])"), "SELECT * FROM customer WHERE contains(c_mktsegment, 'U') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
formula_query("ccl_concat_trim", "customer", ["c_custkey", "c_name"], "NEW('a') = CONCAT(B, '/', A); NEW('t') = TRIM('  ' & B & ' '); NEW('r') = REPEAT(LEFT(B, 1), 3); NEW('u') = SUBSTR(B, 1, 4)", "SELECT c_custkey, c_name, c_name || '/' || c_custkey AS a, c_name AS t, repeat(left(c_name, 1), 3) AS r, substr(c_name, 1, 4) AS u FROM customer")
formula_query("ccl_cumulative_kinds", "nation", ["n_nationkey", "n_name", "n_regionkey"], "NEW('s') = CUMSUM(C); NEW('m') = CUMMIN(C); NEW('p') = CUMPROD(C + 1); NEW('w') = ROLLING_SUM(C, 3); NEW('lo') = ROLLING_MIN(C, 2); NEW('l') = LEAD(A, 2)",
              "SELECT n_nationkey, n_name, n_regionkey, sum(n_regionkey) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS s, min(n_regionkey) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS m, product(n_regionkey + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS p, CASE WHEN count(*) OVER (w ROWS 2 PRECEDING) = 3 THEN sum(n_regionkey) OVER (w ROWS 2 PRECEDING)::DOUBLE END AS w, CASE WHEN count(*) OVER (w ROWS 1 PRECEDING) = 2 THEN min(n_regionkey) OVER (w ROWS 1 PRECEDING)::DOUBLE END AS lo, lead(n_nationkey, 2) OVER w AS l FROM nation WINDOW w AS (ORDER BY n_nationkey)", ["n_nationkey"])
stat_query("correlation_matrix", "lineitem", lambda t: dict(zip(("ab", "ac", "bc"), (lambda r: (r[0, 1], r[0, 2], r[1, 2]))(S.correlation_matrix(t, ["l_quantity", "l_discount", "l_extendedprice"])[0]))), "SELECT corr(l_quantity, l_discount) AS ab, corr(l_quantity, l_extendedprice) AS ac, corr(l_discount, l_extendedprice) AS bc FROM lineitem")
stat_query("wilcoxon_single", "supplier", lambda t: {"v": S.wilcoxon_single((t, "s_acctbal"), 4000.0).statistic}, "WITH d AS (SELECT s_acctbal - 4000 AS d FROM supplier WHERE s_acctbal <> 4000), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d) SELECT coalesce(sum(r) FILTER (d > 0), 0) AS v FROM r")


@query("factor_analysis")
def _factors(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    f = multivariate.factor_analysis(read(spark, d, "lineitem"), cols, 2)
    return spark.createDataFrame([(c, float(r[0]), float(r[1]), float(u)) for c, r, u in zip(cols, f.loadings, f.uniquenesses)], "column string, f1 double, f2 double, uniqueness double")


@query("clusters_of_suppliers")
def _clusters(spark, d):
    t = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_acctbal") / 1000).alias("b"))
    ids, x = multivariate.keyed_rows(t, ["a", "b"], "s_suppkey")
    tree, scan = multivariate.cut_tree(multivariate.hierarchical(x, "average"), k=min(3, len(x))), multivariate.dbscan(x, 2.0, 3)
    return spark.createDataFrame([(i, int(a), int(b)) for i, a, b in zip(ids, tree, scan)], "s_suppkey long, tree int, dbscan int")


# The chained API, money and commands register themselves.
from millrace.plans import model_queries, table_queries  # noqa: E402, F401
