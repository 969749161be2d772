"""Registered queries of statistics, models, formulas, charts, files and the parts that give plain values.

A model whose design tells its groups apart fits each group's mean, whatever its
family and link; that is how the fits are held against SQL.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions import formula, interop, lp, multivariate, regression
from millrace.functions import statistics as S
from millrace.operators import window as WN
from millrace.plans import plots
from millrace.plans.registry import formula_query, query, read, simple, stat_query
from millrace.plans.session import Session
from millrace.plans.table_queries import KEYS, bare, on_value, round_trip
from millrace.sources import parquet, sql, text, workbook
from millrace.table import Table

# Tests.

_CORR = "(SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c, count(*) AS n FROM lineitem)"
stat_query("bartlett_sphericity", "lineitem", lambda t: {"chi2": S.bartlett_sphericity(t, ["l_quantity", "l_discount", "l_tax"]).statistic, "df": S.bartlett_sphericity(t, ["l_quantity", "l_discount", "l_tax"]).df}, f"SELECT -(n - 1 - 11.0 / 6) * ln(1 + 2 * a * b * c - a * a - b * b - c * c) AS chi2, 3 AS df FROM {_CORR}")


def _regression_f(t):
    fit = regression.linear(t, "l_extendedprice", ["l_quantity"])
    explained = fit.measures["rss"] * fit.measures["r2"] / (1 - fit.measures["r2"])
    return {"f": S.f_test_regression(explained, fit.measures["rss"], 1, fit.n - 2).statistic / 1e6, "own": fit.measures["f"] / 1e6}


_F = "regr_r2(l_extendedprice, l_quantity) / (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 2) / 1e6"
stat_query("ftest_regression", "lineitem", _regression_f, f"SELECT {_F} AS f, {_F} AS own FROM lineitem")


def _nested_f(t):
    full, y = regression.linear(t, "p_retailprice", ["p_size"]), t.agg(F.var_pop("p_retailprice") * F.count("p_retailprice"), F.count("p_retailprice")).first()
    return {"f": S.f_test_nested(y[0], full.measures["rss"], y[1] - 1, y[1] - 2).statistic}


stat_query("ftest_nested", "part", _nested_f, "SELECT regr_r2(p_retailprice, p_size) / (1 - regr_r2(p_retailprice, p_size)) * (count(*) - 2) AS f FROM part")
_CELLS = "c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, coalesce(var_samp(o_totalprice), 0) AS v FROM orders GROUP BY ALL), g AS (SELECT avg(o_totalprice) AS g FROM orders), x AS (SELECT o_orderstatus AS a, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), y AS (SELECT o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), s AS (SELECT (SELECT sum(n * (m - g) ^ 2) FROM x, g) AS sa, (SELECT sum(n * (m - g) ^ 2) FROM y, g) AS sb, (SELECT sum(n * (m - g) ^ 2) FROM c, g) AS sc, (SELECT sum((n - 1) * v) FROM c) AS sw, (SELECT count(*) FROM x) - 1 AS da, (SELECT count(*) FROM y) - 1 AS db, (SELECT sum(n) - count(*) FROM c) AS dw)"
stat_query("anova_two_way", "orders", lambda t: {k: v.statistic for k, v in S.anova_two_way(t, "o_totalprice", "o_orderstatus", "o_orderpriority").items()}, f"WITH {_CELLS} SELECT sa / da / (sw / dw) AS a, sb / db / (sw / dw) AS b, (sc - sa - sb) / (da * db) / (sw / dw) AS interaction FROM s")


def _matched(t: DataFrame) -> DataFrame:
    """One value for each supplier and line number: subjects under seven conditions."""
    return t.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"))


_MATCHED = "m AS (SELECT l_suppkey AS s, l_linenumber AS c, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)"
stat_query("anova_repeated", "lineitem", lambda t: {"f": S.anova_repeated(_matched(t), "q", "l_suppkey", "l_linenumber").statistic}, f"WITH {_MATCHED}, g AS (SELECT avg(q) AS g, var_pop(q) * count(*) AS total FROM m), c AS (SELECT sum(n * (a - g) ^ 2) AS v, count(*) AS k FROM (SELECT avg(q) AS a, count(*) AS n FROM m GROUP BY c), g), s AS (SELECT sum(n * (a - g) ^ 2) AS v, count(*) AS k FROM (SELECT avg(q) AS a, count(*) AS n FROM m GROUP BY s), g) SELECT c.v / (c.k - 1) / ((total - c.v - s.v) / ((c.k - 1) * (s.k - 1))) AS f FROM g, c, s")
stat_query("friedman", "lineitem", lambda t: {"q": S.friedman(_matched(t), "q", "l_suppkey", "l_linenumber").statistic}, f"WITH {_MATCHED}, r AS (SELECT c, rank() OVER (PARTITION BY s ORDER BY q) + (count(*) OVER (PARTITION BY s, q) - 1) / 2 AS r, count(*) OVER (PARTITION BY s, q) AS t FROM m), u AS (SELECT c, sum(r) AS r, count(*) AS n FROM r GROUP BY c), k AS (SELECT count(*) AS k, max(n) AS n FROM u) SELECT 12 * (SELECT sum((r - k.n * (k + 1) / 2) ^ 2) FROM u) / (n * k * (k + 1) - (SELECT sum(t * t - 1) FROM r) / (k - 1)) AS q FROM k")
stat_query("wilcoxon_paired", "lineitem", lambda t: {"v": S.wilcoxon_paired(t.groupBy("l_suppkey").agg(S.exact_mean("l_quantity").alias("a"), S.exact_mean(F.col("l_linenumber") * 6.4).alias("b")), "a", "b").statistic}, "WITH d AS (SELECT avg(l_quantity) - avg(l_linenumber * 6.4::DOUBLE) AS d FROM lineitem GROUP BY l_suppkey), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT sum(r) FILTER (d > 0) AS v FROM r")
on_value("diag", "region", lambda t: {"of": ",".join(f"{v:g}" for v in S.diag([[1, 2], [3, 4]])), "total": float(S.diag([5, 6], 3, 3).sum()), "size": int(S.diag(4).sum())}, "SELECT '1,4' AS \"of\", 16.0::DOUBLE AS total, 4 AS size")



def _slope(first: str, second: str, third: str) -> str:
    """The coefficient of one of three predictors: that of what the other two leave of it."""
    less = lambda a, b: f"{a} - regr_slope({a}, {b}) OVER () * {b} AS {a}"
    return f"(WITH a AS (SELECT l_extendedprice AS y, {less(first, third)}, {less(second, third)} FROM lineitem), b AS (SELECT y, {less(first, second)} FROM a) SELECT regr_slope(y, {first}) FROM b)"


_Q, _D, _TAX = "l_quantity", "l_discount", "l_tax"
stat_query("ols_multiple", "lineitem", lambda t: {k: v / 1e5 for k, v in zip("abcd", regression.linear(t, "l_extendedprice", [_Q, _D, _TAX]).coefficients)}, f"SELECT (y - b * q - c * d - e * t) / 1e5 AS a, b / 1e5 AS b, c / 1e5 AS c, e / 1e5 AS d FROM (SELECT avg(l_extendedprice) AS y, avg({_Q}) AS q, avg({_D}) AS d, avg({_TAX}) AS t, {_slope(_Q, _D, _TAX)} AS b, {_slope(_D, _Q, _TAX)} AS c, {_slope(_TAX, _Q, _D)} AS e FROM lineitem)")

# Fits: predictions are the means of the groups that the design tells apart.


def fitted(name: str, fit, sql_text: str) -> None:
    query(f"fit_{name}", sql_text)(lambda spark, d: fit(spark, d).select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in fit(spark, d).dtypes]))


def _sizes(spark, d) -> DataFrame:
    return read(spark, d, "part").withColumn("x", (F.col("p_size") % 3).cast("double"))


def _groups(name: str, model) -> None:
    """``model`` of two binary columns and their product: four groups."""

    def run(spark, d):
        t = read(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_orderstatus") == "F").cast("double").alias("b"), (F.col("o_orderkey") % 2).cast("double").alias("u"), (F.col("o_custkey") % 2).cast("double").alias("v"))
        t = t.withColumn("uv", F.col("u") * F.col("v"))
        return model(t).select("u", "v", F.round("prediction", 6).alias("prediction")).distinct()

    query(f"fit_{name}", "SELECT (o_orderkey % 2)::DOUBLE AS u, (o_custkey % 2)::DOUBLE AS v, round(" + {"linear": "avg(o_totalprice)"}.get(name, "avg((o_orderstatus = 'F')::INT)") + ", 6) AS prediction FROM orders GROUP BY ALL")(run)


_X = ["u", "v", "uv"]
_groups("linear", lambda t: regression.linear(t, "y", _X).predict(t))
_groups("logistic", lambda t: regression.logistic(t, "b", _X).predict(t))
_groups("gaussian", lambda t: regression.glm(t, "b", _X, "gaussian").predict(t))
_groups("probit", lambda t: regression.glm(t, "b", _X, "binomial", "probit").predict(t))
_groups("cloglog", lambda t: regression.glm(t, "b", _X, "binomial", "cloglog").predict(t))
_groups("poisson_groups", lambda t: regression.poisson(t, "b", _X).predict(t))


@query("fit_polynomial", "SELECT (p_size % 3)::DOUBLE AS x, round(avg(p_retailprice), 5) AS prediction FROM part GROUP BY 1")
def _polynomial(spark, d):
    t = _sizes(spark, d)
    b = regression.polynomial(t, "p_retailprice", "x", 2).coefficients
    return t.select("x", F.round(F.lit(float(b[0])) + F.lit(float(b[1])) * F.col("x") + F.lit(float(b[2])) * F.col("x") * F.col("x"), 5).alias("prediction")).distinct()


@query("fit_poisson_offset", "SELECT (p_partkey % 2)::DOUBLE AS x, round(sum(p_size) / sum(1 + p_partkey % 5), 6) AS rate FROM part GROUP BY 1")
def _offset(spark, d):
    t = read(spark, d, "part").select((F.col("p_partkey") % 2).cast("double").alias("x"), F.col("p_size").alias("y"), F.log((1 + F.col("p_partkey") % 5).cast("double")).alias("o"))
    return regression.poisson(t, "y", ["x"], offset="o").predict(t, offset="o").select("x", F.round(F.col("prediction") / F.exp("o"), 6).alias("rate")).distinct()


stat_query("fit_logistic_odds", "orders", lambda t: dict(zip("ab", regression.logistic(t.select((F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("x")), "y", ["x"]).coefficients)), "WITH p AS (SELECT avg((o_orderstatus = 'F')::INT) FILTER (o_orderpriority = '1-URGENT') AS p1, avg((o_orderstatus = 'F')::INT) FILTER (o_orderpriority <> '1-URGENT') AS p0 FROM orders) SELECT ln(p0 / (1 - p0)) AS a, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS b FROM p")
stat_query("fit_poisson_rates", "part", lambda t: dict(zip("ab", regression.poisson(t.select("p_size", (F.col("p_partkey") % 2).alias("x")), "p_size", ["x"]).coefficients)), "SELECT ln(avg(p_size) FILTER (p_partkey % 2 = 0)) AS a, ln(avg(p_size) FILTER (p_partkey % 2 = 1)) - ln(avg(p_size) FILTER (p_partkey % 2 = 0)) AS b FROM part")

# Components, factors, clusters, neighbours.


@query("pca_two", "SELECT unnest([1, 2]) AS component, round(unnest([1 + abs(r), 1 - abs(r)]), 8) AS eigenvalue, round(unnest([sqrt(0.5), sqrt(0.5)]), 8) AS size FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
def _pca_two(spark, d):
    c = multivariate.pca(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(k + 1, round(float(c.values[k]), 8), round(float(abs(c.vectors[0, k])), 8)) for k in range(2)], "component int, eigenvalue double, size double")


def _one_factor(t: DataFrame, how: str) -> dict:
    cols = {"a": "p_size + p_partkey % 31", "b": "p_size + p_partkey * 7 % 43", "c": "p_size + p_partkey * 11 % 53"}
    f = multivariate.factor_analysis(t.select(*[F.expr(e).cast("double").alias(k) for k, e in cols.items()]), list(cols), 1, how, "none", max_iter=20000, tol=1e-11)
    return {k: round(float(h), 5) for k, h in zip(cols, f.communalities)}


_FACTOR = "SELECT ab * ac / bc AS a, ab * bc / ac AS b, ac * bc / ab AS c FROM (SELECT corr(x, y) AS ab, corr(x, z) AS ac, corr(y, z) AS bc FROM (SELECT p_size + p_partkey % 31 AS x, p_size + p_partkey * 7 % 43 AS y, p_size + p_partkey * 11 % 53 AS z FROM part))"
for _how in ("minres", "paf", "ml"):
    query(f"factor_{_how}", f"SELECT round(least(COLUMNS(*), 1.0::DOUBLE), 3) FROM ({_FACTOR})")(lambda spark, d, how=_how: spark.createDataFrame([tuple(round(v, 3) for v in _one_factor(read(spark, d, "part"), how).values())], "a double, b double, c double"))


def _balances(spark, d):
    return multivariate.keyed_rows(read(spark, d, "supplier"), ["s_acctbal"], "s_suppkey")


def _named_groups(spark, ids, labels) -> DataFrame:
    """Each row with the smallest id of its cluster, which tells the clusters whatever they are called."""
    first: dict = {}
    for i, c in zip(ids, labels):
        first.setdefault(int(c), i)
    return spark.createDataFrame([(i, first[int(c)]) for i, c in zip(ids, labels)], "s_suppkey long, first_member long")


_GAP_CLUSTERS = "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY g) AS first_member FROM (SELECT s_suppkey, sum(n) OVER (ORDER BY s_acctbal, s_suppkey) AS g FROM (SELECT *, CASE WHEN s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) <= {gap} THEN 0 ELSE 1 END AS n FROM supplier))"


@query("dbscan_line", _GAP_CLUSTERS.format(gap="150"))
def _dbscan(spark, d):
    ids, x = _balances(spark, d)
    return _named_groups(spark, ids, multivariate.dbscan(x, 150.0, 1))


@query("hclust_cut_height", _GAP_CLUSTERS.format(gap="200"))
def _cut_height(spark, d):
    ids, x = _balances(spark, d)
    return _named_groups(spark, ids, multivariate.cut_tree(multivariate.hierarchical(x, "single"), height=200.0))


@query("hclust_cut_k", "WITH g AS (SELECT s_suppkey, s_acctbal, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY gap DESC NULLS LAST) AS r FROM g), c AS (SELECT s_suppkey, sum(CASE WHEN r <= 3 THEN 1 ELSE 0 END) OVER (ORDER BY s_acctbal, s_suppkey) AS c FROM k) SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY c) AS first_member FROM c")
def _cut_k(spark, d):
    ids, x = _balances(spark, d)
    return _named_groups(spark, ids, multivariate.cut_tree(multivariate.hierarchical(x, "single"), k=4))


@query("silhouette_line", "WITH d AS (SELECT a.s_suppkey, a.s_suppkey % 2 AS own, b.s_suppkey % 2 AS other, avg(abs(a.s_acctbal - b.s_acctbal)) FILTER (a.s_suppkey <> b.s_suppkey) AS m FROM supplier a, supplier b GROUP BY 1, 2, 3), w AS (SELECT s_suppkey, max(m) FILTER (own = other) AS a, max(m) FILTER (own <> other) AS b FROM d GROUP BY 1) SELECT s_suppkey, round((b - a) / greatest(a, b), 8) AS width FROM w")
def _silhouette(spark, d):
    ids, x = _balances(spark, d)
    widths, _ = multivariate.silhouette(x, [i % 2 for i in ids])
    return spark.createDataFrame([(i, round(float(w), 8)) for i, w in zip(ids, widths)], "s_suppkey long, width double")


@query("kmeans_consistent", "SELECT count(*) AS n, 0 AS nearer_elsewhere FROM part")
def _kmeans(spark, d):
    """Every row is in the cluster of its nearest centre."""
    t = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"))
    m = multivariate.kmeans(t, ["a", "b"], 4, n_start=2, max_iter=30)
    far = lambda k: (F.col("a") - float(m.centers[k][0])) ** 2 + (F.col("b") - float(m.centers[k][1])) ** 2
    each = multivariate.assign(t, ["a", "b"], m).withColumn("d", F.array(*[far(k) for k in range(len(m.centers))]))
    labels = sorted(r[0] for r in each.select("cluster").distinct().collect())
    base = labels[0]
    return each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.element_at("d", F.col("cluster") - base + 1) > F.array_min("d") + 1e-9).cast("int").alias("nearer_elsewhere"))


query("knn_regress", """
  WITH p AS (SELECT a.vec_id, b.vec_id AS i, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ^ 2))) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, i) AS rank FROM p) SELECT vec_id, round(avg(label), 6) AS predicted FROM r WHERE rank <= 7 GROUP BY 1""")(
    lambda spark, d: multivariate.knn_regress(e := read(spark, d, "embeddings"), e.filter("vec_id % 50 = 0"), "embedding", "label", 7, "vec_id", "vec_id").withColumn("predicted", F.round("predicted", 6))
)

# Formulas: the functions that no other query calls.

formula_query("ccl_times", "events", ["event_id", "ts"], "NEW('later') = DATEADD(B, 90, 'minute'); NEW('h') = HOUR(['later'] - B); NEW('m') = MINUTE(['later'] - B); NEW('s') = SECOND(['later'] - B)", "SELECT event_id, ts, ts + INTERVAL 90 MINUTE AS later, 1.5::DOUBLE AS h, 90.0::DOUBLE AS m, 5400.0::DOUBLE AS s FROM events")
formula_query("ccl_missing", "orders", ["o_orderkey", "o_orderstatus"], "NEW('p') = IF(B == 'P', '#N/A', B); NEW('na') = ISNA(['p']); NEW('filled') = IFNA(['p'], 'none')", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '#N/A' ELSE o_orderstatus END AS p, o_orderstatus = 'P' AS na, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderstatus END AS filled FROM orders")
formula_query("ccl_spread", "part", ["p_partkey", "p_size"], "NEW('v') = VAR(B); NEW('p') = VARP(B); NEW('s') = STDEVP(B)", "SELECT p_partkey, p_size, (SELECT var_samp(p_size) FROM part) AS v, (SELECT var_pop(p_size) FROM part) AS p, (SELECT stddev_pop(p_size) FROM part) AS s FROM part")
formula_query("ccl_spread_columns", "part", ["p_partkey", "p_size", "p_retailprice"], "NEW('v') = VAR(B:C); NEW('s') = STDEVP(B:C)", "SELECT p_partkey, p_size, p_retailprice, (SELECT var_samp(x) FROM (SELECT p_size::DOUBLE AS x FROM part UNION ALL SELECT p_retailprice FROM part)) AS v, (SELECT stddev_pop(x) FROM (SELECT p_size::DOUBLE AS x FROM part UNION ALL SELECT p_retailprice FROM part)) AS s FROM part")
formula_query("ccl_rolling_max", "nation", ["n_nationkey", "n_name", "n_regionkey"], "NEW('hi') = ROLLING_MAX(C, 3)", "SELECT *, CASE WHEN count(*) OVER w = 3 THEN max(n_regionkey) OVER w END::DOUBLE AS hi FROM nation WINDOW w AS (ORDER BY n_nationkey ROWS 2 PRECEDING)", "n_nationkey")
formula_query("ccl_trims", "nation", ["n_nationkey", "n_name"], "NEW('l') = LTRIM('  ' & B & ' ') & '|'; NEW('r') = '|' & RTRIM(' ' & B & '  '); NEW('v') = VALUE('12.5') + A; NEW('t') = TEXT(A) & '!'", "SELECT n_nationkey, n_name, n_name || ' |' AS l, '| ' || n_name AS r, 12.5::DOUBLE + n_nationkey AS v, n_nationkey || '!' AS t FROM nation")
on_value("formula_parts", "region", lambda t: {
    "row": formula.is_row_dependent(formula.parse("['a'] + 1")), "whole": formula.is_row_dependent(formula.parse("SUM(A)")),
    "ordered": formula.needs_order(formula.parse("LAG(A, 1)")), "statements": len(formula.statements("NEW('x') = A; B = 2")), "target": formula.statements("NEW('x') = A")[0][0],
}, "SELECT true AS row, false AS whole, true AS ordered, 2 AS statements, 'x' AS target")


@query("formula_registered", "SELECT p_partkey, p_size, p_size * 2.0::DOUBLE AS d, (SELECT max(p_size) - min(p_size) FROM part)::DOUBLE AS spread FROM part")
def _registered(spark, d):
    formula.register_function("TWICE", lambda x: x * 2.0, "double")
    formula.register_aggregate("SPREAD", lambda c: F.max(c) - F.min(c))
    t = read(spark, d, "part").select("p_partkey", "p_size").withColumn("p_size", F.col("p_size").cast("double"))
    return formula.execute(t, "NEW('d') = TWICE(B); NEW('spread') = SPREAD(B)").withColumn("p_size", F.col("p_size").cast("int"))


@query("formula_over_lists", "SELECT unnest([11.0, 22.0, 33.0])::DOUBLE AS total, 60.0::DOUBLE AS whole")
def _over_lists(spark, d):
    m = formula.MapContext(spark, {"a": [1, 2, 3]})
    m.bind("b", [10, 20, 30])
    whole = m.evaluate("SUM(['b'])")
    m.execute("NEW('total') = ['a'] + ['b']")
    return spark.createDataFrame([(float(v), float(w)) for v, w in zip(m.columns["total"], whole)], "total double, whole double")


# Charts: what their documents hold.


def chart(name: str, table: str, build, sql_text: str) -> None:
    """A chart's document as one JSON text."""
    query(f"plot_{name}", sql_text)(lambda spark, d: spark.createDataFrame([(json.dumps(build(read(spark, d, table)), default=str, separators=(",", ":")),)], "document string"))


_BY = lambda t: t.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).orderBy("n_regionkey")
_KEYS_OF, _COUNTS_OF = "(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT n_regionkey AS k FROM nation))", "(SELECT string_agg(n, ',' ORDER BY k) FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1))"
chart("line", "nation", lambda t: plots.line(_BY(t), "n_regionkey", ["n"], "t"), f"SELECT '{{\"kind\":\"line\",\"title\":\"t\",\"x\":[' || {_KEYS_OF} || '],\"series\":[{{\"name\":\"n\",\"data\":[' || {_COUNTS_OF} || ']}}]}}' AS document")
chart("step", "nation", lambda t: plots.line(_BY(t), "n_regionkey", ["n"], "t", step=True), f"SELECT '{{\"kind\":\"step\",\"title\":\"t\",\"x\":[' || {_KEYS_OF} || '],\"series\":[{{\"name\":\"n\",\"data\":[' || {_COUNTS_OF} || ']}}]}}' AS document")
chart("bar", "nation", lambda t: plots.bar(_BY(t), "n_regionkey", ["n"], "t"), f"SELECT '{{\"kind\":\"bar\",\"title\":\"t\",\"x\":[' || {_KEYS_OF} || '],\"series\":[{{\"name\":\"n\",\"data\":[' || {_COUNTS_OF} || ']}}]}}' AS document")
_ITEMS = "(SELECT string_agg('{\"name\":' || k || ',\"value\":' || n || '}', ',' ORDER BY k) FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1))"
for _kind in ("pie", "funnel"):
    chart(_kind, "nation", lambda t, k=_kind: plots.parts(_BY(t), "n_regionkey", "n", "t", k), f"SELECT '{{\"kind\":\"{_kind}\",\"title\":\"t\",\"items\":[' || {_ITEMS} || ']}}' AS document")
chart("wordcloud", "part", lambda t: plots.word_counts(t, "p_type", "t", 3), "SELECT '{\"kind\":\"wordcloud\",\"title\":\"t\",\"items\":[' || string_agg('{\"name\":\"' || w || '\",\"value\":' || n || '}', ',' ORDER BY n DESC, w) || ']}' AS document FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(p_type), '\\W+')) AS w FROM part) WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 3)")
chart("scatter", "nation", lambda t: plots.scatter(t.orderBy("n_nationkey"), "n_nationkey", "n_regionkey", title="t"), "SELECT '{\"kind\":\"scatter\",\"title\":\"t\",\"series\":[{\"name\":\"n_regionkey\",\"data\":[' || string_agg('[' || n_nationkey || ',' || n_regionkey || ']', ',' ORDER BY n_nationkey) || ']}]}' AS document FROM nation")
chart("heatmap", "nation", lambda t: plots.heatmap(t.filter("n_nationkey >= 0").orderBy("n_nationkey").selectExpr("n_nationkey", "n_nationkey as y", "n_regionkey"), "n_nationkey", "y", "n_regionkey", "t"), "SELECT '{\"kind\":\"heatmap\",\"title\":\"t\",\"x\":[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || '],\"y\":[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || '],\"data\":[' || string_agg('[' || n_nationkey || ',' || n_nationkey || ',' || n_regionkey || ']', ',' ORDER BY n_nationkey) || ']}' AS document FROM nation")
chart("histogram", "part", lambda t: {"counts": plots.histogram(t, "p_size", 5)["counts"]}, "SELECT '{\"counts\":[' || string_agg(n, ',' ORDER BY b) || ']}' AS document FROM (SELECT b, count(p_size) AS n FROM range(5) r(b) LEFT JOIN (SELECT p_size, least(floor((p_size - lo) / (hi - lo) * 5), 4) AS at_bin FROM part, (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part)) ON at_bin = b GROUP BY b)")
chart("sankey", "nation", lambda t: {"links": sorted([x["source"], x["target"], x["value"]] for x in plots.sankey(t.selectExpr("n_regionkey", "n_nationkey % 2 as odd", "1 as w"), "n_regionkey", "odd", "w")["links"])}, "SELECT '{\"links\":[' || string_agg('[' || a || ',' || b || ',' || n || ']', ',' ORDER BY a, b) || ']}' AS document FROM (SELECT n_regionkey AS a, n_nationkey % 2 AS b, count(*) AS n FROM nation GROUP BY ALL)")
chart("kline", "orders", lambda t: plots.kline(t.groupBy(F.year("o_orderdate").alias("y")).agg(*[f("o_orderkey").alias(n) for f, n in ((F.min, "a"), (F.max, "b"), (F.min, "c"), (F.max, "d"))]), "y", ["a", "b", "c", "d"], "t"), "SELECT '{\"kind\":\"kline\",\"title\":\"t\",\"x\":[' || string_agg('\"' || y || '\"', ',' ORDER BY y) || '],\"data\":[' || string_agg('[' || a || ',' || b || ',' || a || ',' || b || ']', ',' ORDER BY y) || ']}' AS document FROM (SELECT year(o_orderdate) AS y, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1)")
chart("themeriver", "nation", lambda t: plots.theme_river(t.selectExpr("n_nationkey as d", "n_regionkey as v", "n_name as s"), "d", "v", "s", "t"), "SELECT '{\"kind\":\"themeriver\",\"title\":\"t\",\"data\":[' || string_agg('[\"' || n_nationkey || '\",' || n_regionkey || ',\"' || n_name || '\"]', ',' ORDER BY n_nationkey) || ']}' AS document FROM nation")
chart("gauge", "nation", lambda t: plots.gauge(t.count(), "t"), "SELECT '{\"kind\":\"gauge\",\"title\":\"t\",\"value\":' || count(*) || ',\"low\":0.0,\"high\":100.0}' AS document FROM nation")
chart("radar", "nation", lambda t: plots.radar({"n": [r[1] for r in _BY(t).collect()]}, [str(r[0]) for r in _BY(t).collect()], "t"), f"SELECT '{{\"kind\":\"radar\",\"title\":\"t\",\"axes\":[\"' || replace({_KEYS_OF}, ',', '\",\"') || '\"],\"series\":[{{\"name\":\"n\",\"data\":[' || {_COUNTS_OF} || ']}}]}}' AS document")
chart("function", "nation", lambda t: {"data": plots.function_plot(lambda x: x * x, 0.0, 4.0, 5)["series"][0]["data"]}, "SELECT '{\"data\":[0.0,1.0,4.0,9.0,16.0]}' AS document")
chart("box", "part", lambda t: {"first": plots.box(t, "p_size", "p_brand")["items"][0]["data"]}, "SELECT '{\"first\":[' || lo || ',' || a || ',' || b || ',' || c || ',' || hi || ']}' AS document FROM (SELECT p_brand, min(p_size)::DOUBLE AS lo, quantile_cont(p_size::DOUBLE, 0.25) AS a, quantile_cont(p_size::DOUBLE, 0.5) AS b, quantile_cont(p_size::DOUBLE, 0.75) AS c, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1 ORDER BY 1 LIMIT 1)")


@query("plot_files", "SELECT true AS has_chart, true AS has_data")
def _plot_files(spark, d):
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as at:  # the driver's own file, read back here
        path = os.path.join(at, "c.html")
        plots.save_html(plots.bar(_BY(read(spark, d, "nation")), "n_regionkey", ["n"], "t"), path)
        with open(path) as f:
            page = f.read()
    return spark.createDataFrame([("<svg" in page, '"kind": "bar"' in page)], "has_chart boolean, has_data boolean")


# Files.


@round_trip("workbook_sheet", "nation", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _sheet(spark, t, at):
    workbook.write_workbook({"one": t.ordered().orderBy("n_nationkey").select(*t.columns)}, f"{at}.xlsx")
    return workbook.read_sheet(spark, f"{at}.xlsx", "one")


@round_trip("csv_to_workbook", "nation", "SELECT (n_nationkey::DOUBLE)::VARCHAR AS n_nationkey, n_name, (n_regionkey::DOUBLE)::VARCHAR AS n_regionkey FROM nation")
def _csv_sheet(spark, t, at):
    t.write_csv(at, single=True)
    workbook.csv_to_workbook(spark, [at], f"{at}.xlsx", ["s"])
    return workbook.read_sheet(spark, f"{at}.xlsx", "s")


@round_trip("encodings", "nation", "SELECT 'utf-8' AS found, count(*) AS rows FROM nation")
def _encodings(spark, t, at):
    t.write_csv(at)
    found = text.guess_encoding("é ü ß 東京".encode())
    return spark.createDataFrame([(found.lower(), text.read_csv(spark, f"{at}/*.csv", encoding="utf-8").count())], "found string, rows long")


@round_trip("parquet_inspect", "nation", "SELECT count(*) AS rows, 'n_nationkey,n_name,n_regionkey' AS names, min(n_nationkey) AS low, max(n_nationkey) AS high FROM nation")
def _inspect(spark, t, at):
    t._with(t.df.coalesce(1)).write_parquet(at)
    m = parquet.inspect(spark, at)
    first = m["row_groups"][0]["columns"][0]
    return spark.createDataFrame([(m["rows"], ",".join(m["columns"]), first["min"], first["max"])], "rows long, names string, low int, high int")


@round_trip("parquet_stream", "nation", "SELECT count(*) AS rows, CAST(ceil(count(*) / 10) AS BIGINT) AS batches FROM nation")
def _stream(spark, t, at):
    t.write_parquet(at)
    sizes = [len(b) for b in parquet.stream(spark, at, 10)]
    return spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, batches long")


@round_trip("parquet_apply_formula", "nation", "SELECT n_nationkey, n_name, n_regionkey, n_regionkey * 2.0::DOUBLE AS x FROM nation")
def _apply(spark, t, at):
    t.write_parquet(at)
    parquet.apply_formula(spark, at, "NEW('x') = ['n_regionkey'] * 2")
    return spark.read.parquet(at)


@query("sql_stream", "SELECT count(*) AS rows, CAST(ceil(count(*) / 7) AS BIGINT) AS chunks FROM nation")
def _sql_stream(spark, d):
    read(spark, d, "nation").createOrReplaceTempView("nation_of_stream")
    sizes = [len(c) for c in sql.stream(spark, sql.Query(table="nation_of_stream"), 7)]
    return spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, chunks long")


# Programmes, processes, settings, errors.


def _programme() -> dict:
    m = lp.Model().set_objective("Maximize", "3 x + 2 y").add_constraint("x + y <= 4").add_constraint("x + 3 y <= 6").add_bound("x <= 3")
    s = lp.solve(m)
    whole = lp.solve(lp.Model().set_objective("Maximize", "x + y").add_constraint("2 x + 2 y <= 5").add_integer("x").add_integer("y"))
    return {"objective": float(s.objective), "x": float(s.values["x"]), "y": float(s.values["y"]), "text": "Subject To" in m.to_lp(), "whole": float(whole.objective)}


on_value("linear_programme", "region", lambda t: _programme(), "SELECT 11.0::DOUBLE AS objective, 3.0::DOUBLE AS x, 1.0::DOUBLE AS y, true AS text, 2.0::DOUBLE AS whole")
on_value("other_process", "region", lambda t: {"sum": interop.run_code("result = a + b", a=2, b=3), "side_by_side": ",".join(map(str, interop.Group([lambda: 1, lambda: 2]).run().results()))}, "SELECT 5 AS \"sum\", '1,2' AS side_by_side")


def _errors() -> dict:
    kept, panic = errors.errors.pop_all(), errors.config.dont_panic
    errors.config.dont_panic = True
    try:
        for level, name in (("warning", "one"), ("fatal", "two"), ("warning", "three")):
            errors.report(level, "p", name, "m")
        out = {"n": len(errors.errors.all()), "fatal": errors.has_error_above("warning"), "first": errors.errors.pop().function, "last": errors.errors.pop(last=True).function, "by_name": str(errors.errors.pop(where=lambda e: e.function == "three")), "left": len(errors.errors.pop_all())}
    finally:
        errors.config.dont_panic = panic
        for e in kept:
            errors.errors.push(e)
    return out


on_value("error_ring", "region", lambda t: _errors(), "SELECT 3 AS n, true AS fatal, 'one' AS first, 'three' AS last, 'None' AS by_name, 1 AS \"left\"")
on_value("guarded_chain", "nation", lambda t: {"rows": (g := t.guarded().drop_cols("n_name").drop_cols("nope").filter("['n_regionkey'] == 1")).table.n_rows, "failed": g.err() is not None, "cleared": g.clear_err().err() is None, "cols": g.n_cols}, "SELECT count(*) AS rows, true AS failed, true AS cleared, 2 AS cols FROM nation WHERE n_regionkey = 1")
on_value("session_state", "nation", lambda t: {"version": (s := Session(t.df.sparkSession)).run("version"), "history": len(s.run("vars") or {}) + len(s.run("history")), "commands": len(s.run("help")) > 90}, "SELECT '0.1' AS version, 3 AS history, true AS commands")

# Windows over whole tables.

simple("smoothing", "events", lambda t: WN.smoothing(t.select("event_id", "user_id", "value"), "value", 0.3, "event_id", ["user_id"]), "WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), s AS (SELECT event_id, user_id, value, r, value AS smoothed FROM e WHERE r = 1 UNION ALL SELECT e.event_id, e.user_id, e.value, e.r, 0.3::DOUBLE * e.value + 0.7 * s.smoothed FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1) SELECT event_id, user_id, value, smoothed FROM s", rounded="smoothed")


@query("expanding_spread", "SELECT p_partkey, p_retailprice + 1e6::DOUBLE AS v, round(CASE WHEN count(*) OVER w >= 2 THEN var_samp(p_retailprice) OVER w END, 4) AS var FROM part WINDOW w AS (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)")
def _expanding(spark, d):
    t = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") + 1e6).alias("v"))
    return WN.expanding_all(t, {"var": ("v", "var")}, "p_partkey").withColumn("var", F.round("var", 4))
