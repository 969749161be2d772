"""Registered queries of the chained table and series API: cells, names, columns, rows, replacement, encoders, samples, sources.

Each runs over a whole table in the order of its key. A query whose operator
gives a plain value has one row with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import finance as FN
from millrace.functions import formula, interop, values
from millrace.operators.aggregate import Agg
from millrace.operators.encode import LabelEncoder, OneHotEncoder, OrdinalEncoder, Scaler
from millrace.operators.ordering import RID
from millrace.operators.window import Rolling
from millrace.plans.registry import folder, query, read, simple
from millrace.plans.session import Session
from millrace.sources import sql, text
from millrace.table import NAME, Series, Table

#: The key of each table, in whose order rows stand.
KEYS = {"nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def bare(t) -> DataFrame:
    df = t.df if isinstance(t, Table) else t.table.select(t.name).df if isinstance(t, Series) else t
    return df.drop(RID, NAME)


def on_table(name: str, table: str, build: Callable[[Table], object], sql_text: str, columns: list[str] | None = None) -> None:
    """A query of a table in the order of its key."""

    def run(spark, d):
        df = read(spark, d, table)
        return bare(build(Table(df.select(*columns) if columns else df, KEYS[table])))

    query(name, sql_text)(run)


def on_series(name: str, table: str, column: str, build: Callable[[Series], Series], sql_text: str) -> None:
    """A query of a column in the order of the table's key; the row's place goes along."""

    def run(spark, d):
        t = Table(read(spark, d, table), KEYS[table])
        return build(Table(t.ordered().select(RID, column)).col(column)).table.ordered().select(F.col(RID).alias("place"), F.col(column).alias("value"))

    query(name, sql_text)(run)


def on_value(name: str, table: str, build: Callable[[Table], dict], sql_text: str) -> None:
    """A query whose operators give plain values: one row of them."""

    def run(spark, d):
        got = build(Table(read(spark, d, table), KEYS[table]))
        kind = lambda v: "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        return spark.createDataFrame([tuple(got.values())], ", ".join(f"`{k}` {kind(v)}" for k, v in got.items()))

    query(name, sql_text)(run)


_N, _C, _P = "FROM nation", "FROM customer", "FROM part"

# Columns: addresses, names, order, choice.

on_table("col_by_name", "customer", lambda t: t.col("c_name"), f"SELECT c_name {_C}")
on_table("col_by_letter", "customer", lambda t: t.col("D"), f"SELECT c_acctbal {_C}")
on_table("col_by_number", "customer", lambda t: t.col(-1), f"SELECT c_mktsegment {_C}")
on_value("col_addresses", "part", lambda t: {"number": t.number_of("p_type"), "letter": t.letter_of("p_type"), "name": t.resolve("C"), "by_number": t.resolve(5), "absent": t.number_of("nope")},
         "SELECT 3 AS number, 'D' AS letter, 'p_brand' AS name, 'p_retailprice' AS by_number, -1 AS absent")
on_value("col_names", "part", lambda t: {"names": ",".join(t.columns), "n": t.n_cols}, "SELECT 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS names, 6 AS n")
on_value("col_letters", "part", lambda t: {"z": formula.number_to_letter(25), "aa": formula.number_to_letter(26), "zz": formula.letter_to_number("ZZ"), "parsed": formula.letter_to_number("ab")}, "SELECT 'Z' AS z, 'AA' AS aa, 701 AS zz, 27 AS parsed")
on_table("update_col", "part", lambda t: t.with_col("p_size", F.col("p_size") * 2), f"SELECT * REPLACE (p_size * 2 AS p_size) {_P}")
on_table("append_cols", "nation", lambda t: t.with_col("place", list(range(100, 125))), f"SELECT *, 100 + row_number() OVER (ORDER BY n_nationkey) - 1 AS place {_N}")
on_table("rename_col", "nation", lambda t: t.rename("n_name", "name").rename("C", "region").rename(0, "key"), f"SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region {_N}")
on_table("rename_clash", "nation", lambda t: t.rename("n_name", "n_regionkey"), f'SELECT n_nationkey, n_name AS n_regionkey_1, n_regionkey {_N}')
on_table("set_col_names", "nation", lambda t: t.set_names(["a", "b", "c", "d"]), f"SELECT n_nationkey AS a, n_name AS b, n_regionkey AS c, NULL::VARCHAR AS d {_N}")
on_table("names_to_first_row", "region", lambda t: t.names_to_first_row(), "SELECT r_regionkey::VARCHAR AS A, r_name AS B FROM region UNION ALL SELECT 'r_regionkey', 'r_name'", ["r_regionkey", "r_name"])
on_table("row_to_names", "region", lambda t: t.row_to_names(0), "SELECT r_regionkey AS \"0\", r_name AS \"AFRICA\" FROM region WHERE r_regionkey > 0", ["r_regionkey", "r_name"])
on_table("drop_cols_by_name", "part", lambda t: t.drop_cols("p_name", "p_type"), f"SELECT * EXCLUDE (p_name, p_type) {_P}")
on_table("drop_cols_by_letter", "part", lambda t: t.drop_cols("B", "D"), f"SELECT * EXCLUDE (p_name, p_type) {_P}")
on_table("drop_cols_by_number", "part", lambda t: t.drop_cols(1, -1), f"SELECT * EXCLUDE (p_name, p_retailprice) {_P}")
on_table("drop_cols_number", "customer", lambda t: t.drop_cols_with("number"), f"SELECT c_name, c_mktsegment {_C}")
on_table("drop_cols_text", "customer", lambda t: t.drop_cols_with("string"), f"SELECT c_custkey, c_nationkey, c_acctbal {_C}")
_GAPS = "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'NaN'::DOUBLE ELSE s_acctbal END"


def _gaps(t: Table) -> Table:
    """A column with null and NaN cells, and a text column with a spreadsheet's mark for a missing cell."""
    k = F.col("s_suppkey")
    return t.with_col("v", F.when(k % 4 == 0, F.lit(None)).when(k % 5 == 0, float("nan")).otherwise(F.col("s_acctbal"))).with_col("s", F.when(k % 3 == 0, "#N/A").otherwise(F.col("s_name"))).select("s_suppkey", "v", "s")


_GAP_ROWS = f"SELECT s_suppkey, {_GAPS} AS v, CASE WHEN s_suppkey % 3 = 0 THEN '#N/A' ELSE s_name END AS s FROM supplier"
on_table("drop_cols_nil", "supplier", lambda t: _gaps(t).drop_cols_with("nil"), f"SELECT s_suppkey, s FROM ({_GAP_ROWS})")
on_table("drop_cols_nan", "supplier", lambda t: _gaps(t).drop_cols_with("nan"), f"SELECT s_suppkey, s FROM ({_GAP_ROWS})")
on_table("drop_cols_excel_na", "supplier", lambda t: _gaps(t).drop_cols_with("excel_na"), f"SELECT s_suppkey, v FROM ({_GAP_ROWS})")
on_table("swap_cols_by_name", "nation", lambda t: t.set_names(["a", "b", "c"]).swap_cols("a", "c").set_names(["x", "y", "z"]), f"SELECT n_regionkey AS x, n_name AS y, n_nationkey AS z {_N}")
on_table("swap_cols_by_letter", "nation", lambda t: t.swap_cols("A", "B").set_names(["x", "y", "z"]), f"SELECT n_name AS x, n_nationkey AS y, n_regionkey AS z {_N}")
on_table("swap_cols_by_number", "nation", lambda t: t.swap_cols(0, -1).set_names(["x", "y", "z"]), f"SELECT n_regionkey AS x, n_name AS y, n_nationkey AS z {_N}")
on_table("cols_from", "part", lambda t: t.cols_between("C"), f"SELECT p_brand, p_type, p_size, p_retailprice {_P}")
on_table("cols_upto", "part", lambda t: t.cols_between(None, "B"), f"SELECT p_partkey, p_name {_P}")
on_table("cols_between", "part", lambda t: t.cols_between(1, 3), f"SELECT p_name, p_brand, p_type {_P}")
on_table("cols_equal_letter", "part", lambda t: t.cols_between("E", "E"), f"SELECT p_size {_P}")
on_table("cols_named", "part", lambda t: t.select("p_name"), f"SELECT p_name {_P}")
on_table("cols_containing", "part", lambda t: t.cols_containing("p_p"), f"SELECT p_partkey {_P}")
on_table("cols_that_hold", "nation", lambda t: t.select(*t.find_cols(7)), f"SELECT n_nationkey {_N}")
on_value("find_cols", "nation", lambda t: {"both": ",".join(t.find_cols(3)), "every": ",".join(t.find_cols(3, 20)), "part": ",".join(t.find_cols(part="NATION")), "all_part": ",".join(t.find_cols(part="A", every=True)), "none": ",".join(t.find_cols("x"))},
         f"""SELECT CASE WHEN count_if(n_nationkey = 3) > 0 THEN 'A' ELSE '' END || CASE WHEN count_if(n_regionkey = 3) > 0 THEN ',C' ELSE '' END AS "both", CASE WHEN count_if(n_nationkey = 3) > 0 AND count_if(n_nationkey = 20) > 0 THEN 'A' ELSE '' END AS every,
         CASE WHEN count_if(contains(n_name, 'NATION')) > 0 THEN 'B' ELSE '' END AS part, CASE WHEN count_if(contains(n_name, 'A')) = count(*) THEN 'B' ELSE '' END AS all_part, '' AS "none" {_N}""")

# Cells and rows.

on_value("get_cells", "orders", lambda t: {"first": t.at(0, "o_totalprice"), "last": t.at(-1, "o_orderpriority"), "by_letter": t.at(10, "A"), "beyond": str(t.at(10**9, 0))},
         "SELECT arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_orderpriority, o_orderkey) AS last, (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 10) AS by_letter, 'None' AS beyond FROM orders")
on_value("get_row", "nation", lambda t: {"row": "|".join(map(str, t.row(3))), "last": "|".join(map(str, t.row(-1)))}, f"SELECT (SELECT n_nationkey || '|' || n_name || '|' || n_regionkey {_N} WHERE n_nationkey = 3) AS row, (SELECT n_nationkey || '|' || n_name || '|' || n_regionkey {_N} ORDER BY n_nationkey DESC LIMIT 1) AS last")
on_table("update_element", "customer", lambda t: t.set(5, "c_name", "someone").set(-1, "D", 0.5), f"WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n {_C}) SELECT c_custkey, CASE WHEN r = 6 THEN 'someone' ELSE c_name END AS c_name, c_nationkey, CASE WHEN r = n THEN 0.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM c")
on_table("update_row", "nation", lambda t: t.set_row(2, [99, "NEWLAND", 7]), f"SELECT CASE WHEN n_nationkey = 2 THEN 99 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 2 THEN 'NEWLAND' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN 7 ELSE n_regionkey END AS n_regionkey {_N}")
on_table("append_rows", "nation", lambda t: t.append_rows(Table.of(t.df.sparkSession, {"n_name": ["X", "Y"], "extra": [1.5, None]})), f"SELECT n_nationkey, n_name, n_regionkey, NULL::DOUBLE AS extra {_N} UNION ALL SELECT NULL, 'X', NULL, 1.5 UNION ALL SELECT NULL, 'Y', NULL, NULL")
on_table("append_table", "nation", lambda t: t.append_rows(t), f"SELECT * {_N} UNION ALL SELECT * {_N}")
on_table("swap_rows", "nation", lambda t: (s := t.swap_rows(0, 3)).with_col("place", F.col(RID)), f"SELECT *, CASE n_nationkey WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE n_nationkey END AS place {_N}")
on_table("drop_rows_by_index", "nation", lambda t: t.drop_rows(0, 4, -1), f"SELECT * {_N} WHERE n_nationkey NOT IN (0, 4, (SELECT max(n_nationkey) {_N}))")
on_table("rows_between", "orders", lambda t: t.rows_between(100, 250), "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 100 AND 250")
on_table("rows_below", "orders", lambda t: t.rows_between(None, 9), "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r <= 9")
on_table("rows_with_text", "customer", lambda t: t.drop_rows_with("string"), f"SELECT * {_C} WHERE c_name IS NULL AND c_mktsegment IS NULL")
on_table("drop_rows_number", "supplier", lambda t: _gaps(t).select("v", "s").drop_rows_with("number"), f"SELECT v, s FROM ({_GAP_ROWS}) WHERE v IS NULL")
on_table("drop_rows_nil", "supplier", lambda t: _gaps(t).drop_rows_with("nil"), f"SELECT * FROM ({_GAP_ROWS}) WHERE v IS NOT NULL")
on_table("drop_rows_nan", "supplier", lambda t: _gaps(t).drop_rows_with("nan"), f"SELECT * FROM ({_GAP_ROWS}) WHERE v IS NULL OR NOT isnan(v)")
on_table("drop_rows_value", "nation", lambda t: t.drop_rows_with(None, 2, "JAPAN"), f"SELECT * {_N} WHERE n_nationkey <> 2 AND n_regionkey <> 2 AND n_name <> 'JAPAN'")
on_table("drop_rows_excel_na", "supplier", lambda t: _gaps(t).drop_rows_with("excel_na"), f"SELECT * FROM ({_GAP_ROWS}) WHERE s <> '#N/A'")
on_value("table_size", "orders", lambda t: {"rows": t.size()[0], "cols": t.size()[1], "n_rows": t.n_rows}, "SELECT count(*) AS rows, 6 AS cols, count(*) AS n_rows FROM orders")
on_value("table_data", "nation", lambda t: {"rows": "|".join(",".join(map(str, r)) for r in t.collect()), "map": ",".join(t.to_map()["n_name"]), "letters": ",".join(t.to_map(names=False))}, f"SELECT string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, '|' ORDER BY n_nationkey) AS rows, string_agg(n_name, ',' ORDER BY n_nationkey) AS map, 'A,B,C' AS letters {_N}")
on_table("table_map", "part", lambda t: t.map(lambda v: v * 3 + 1, "p_size", "int"), f"SELECT * REPLACE (p_size * 3 + 1 AS p_size) {_P}")
on_table("table_clone", "part", lambda t: t.clone(), f"SELECT * {_P}")
on_table("filter_whole_rows", "nation", lambda t: t.filter_rows(lambda df, c: F.col(c).cast("string").contains("1")), f"SELECT * {_N} WHERE contains(n_nationkey::VARCHAR, '1') OR contains(n_name, '1') OR contains(n_regionkey::VARCHAR, '1')")
on_table("filter_cells", "nation", lambda t: t.filter_cells(lambda df, c: F.col(c).cast("string").contains("1")), f"SELECT CASE WHEN contains(n_nationkey::VARCHAR, '1') THEN n_nationkey END AS n_nationkey, CASE WHEN contains(n_name, '1') THEN n_name END AS n_name, CASE WHEN contains(n_regionkey::VARCHAR, '1') THEN n_regionkey END AS n_regionkey {_N} WHERE contains(n_nationkey::VARCHAR, '1') OR contains(n_name, '1') OR contains(n_regionkey::VARCHAR, '1')")
on_value("table_types", "part", lambda t: {"types": ",".join(t.types().values())}, "SELECT 'bigint,string,string,string,int,double' AS types")
on_value("table_show", "region", lambda t: {"text": t.select("r_regionkey", "r_name").show(0, 2)}, "SELECT 'r_regionkey  r_name' || chr(10) || string_agg(rpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name, chr(10) ORDER BY r_regionkey) AS text FROM region WHERE r_regionkey < 2")
on_value("table_count", "nation", lambda t: {"threes": t.count(3), "counted": sum(t.counter().values())}, f"SELECT (SELECT count_if(n_nationkey = 3) + count_if(n_regionkey = 3) {_N}) AS threes, (SELECT 3 * count(*) {_N}) AS counted")

# Row names.

_NAMED = lambda t: t.col_to_row_names("n_name")
on_table("col_to_row_names", "nation", lambda t: _NAMED(t).row_names_to_first_col("label"), f"SELECT n_name AS label, n_nationkey, n_regionkey {_N}")
on_table("drop_row_names", "nation", lambda t: _NAMED(t).drop_row_names(), f"SELECT n_nationkey, n_regionkey {_N}")
on_table("set_row_names", "region", lambda t: t.set_row_names(["a", "b", "b", "c", "d"]).row_names_to_first_col(), "SELECT ['a', 'b', 'b_1', 'c', 'd'][r_regionkey + 1] AS name, r_regionkey, r_name FROM region", ["r_regionkey", "r_name"])
on_table("set_row_name", "region", lambda t: t.set_row_name(2, "two").row_names_to_first_col(), "SELECT CASE WHEN r_regionkey = 2 THEN 'two' END AS name, r_regionkey, r_name FROM region", ["r_regionkey", "r_name"])
on_value("row_names", "nation", lambda t: {"names": ",".join(_NAMED(t).row_names()), "index": _NAMED(t).row_index_of(t.at(4, "n_name")), "row": str(_NAMED(t).row(t.at(4, "n_name"))[0]), "cell": str(_NAMED(t).at(t.at(4, "n_name"), "n_regionkey"))},
         f"SELECT string_agg(n_name, ',' ORDER BY n_nationkey) AS names, 4 AS index, '4' AS row, (SELECT n_regionkey::VARCHAR {_N} WHERE n_nationkey = 4) AS cell {_N}")
on_table("rows_by_name", "nation", lambda t: _NAMED(t).rows_named(t.at(6, "n_name")), f"SELECT n_nationkey, n_regionkey {_N} WHERE n_nationkey = 6")
on_table("rows_by_name_part", "nation", lambda t: _NAMED(t).rows_named(part="1"), f"SELECT n_nationkey, n_regionkey {_N} WHERE contains(n_name, '1')")
on_table("drop_rows_by_name", "nation", lambda t: _NAMED(t).drop_rows(t.at(6, "n_name"), t.at(7, "n_name")), f"SELECT n_nationkey, n_regionkey {_N} WHERE n_nationkey NOT IN (6, 7)")
on_table("swap_rows_by_name", "nation", lambda t: _NAMED(t).swap_rows(t.at(1, "n_name"), t.at(2, "n_name")).with_col("place", F.col(RID)), f"SELECT n_nationkey, n_regionkey, CASE n_nationkey WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE n_nationkey END AS place {_N}")


@query("merge_on_row_names", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey = r_regionkey")
def _row_name_merge(spark, d):
    n = Table(read(spark, d, "nation"), "n_nationkey").select("n_nationkey").with_col("k", F.col("n_nationkey")).col_to_row_names("k")
    r = Table(read(spark, d, "region"), "r_regionkey").select("r_regionkey").with_col("k", F.col("r_regionkey")).col_to_row_names("k")
    return bare(n.merge(r, "horizontal", "inner"))


@query("stack_row_names", "SELECT coalesce(n || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END) AS name, v FROM (SELECT n, v, row_number() OVER (PARTITION BY n ORDER BY t) AS k FROM (SELECT r_name AS n, r_regionkey AS v, 0 AS t FROM region UNION ALL SELECT r_name, r_regionkey + 10, 1 FROM region))")
def _row_name_stack(spark, d):
    a = Table(read(spark, d, "region"), "r_regionkey").select("r_regionkey", "r_name").rename("r_regionkey", "v")
    b = a.with_col("v", F.col("v") + 10)
    both = a.append_rows(b)
    return bare(both.col_to_row_names("r_name").row_names_to_first_col())


# Series.

_PLACE = "row_number() OVER (ORDER BY p_partkey) - 1 AS place"
on_series("list_reverse", "part", "p_size", lambda s: s.reverse(), f"SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS place, p_size AS value {_P}")
on_series("list_append", "part", "p_size", lambda s: s.append(7, None, 9), f"SELECT {_PLACE}, p_size AS value {_P} UNION ALL SELECT (SELECT count(*) {_P}) + i, [7, NULL, 9][i + 1] FROM range(3) t(i)")
on_series("list_concat", "part", "p_size", lambda s: s.concat(s), f"SELECT {_PLACE}, p_size AS value {_P} UNION ALL SELECT (SELECT count(*) {_P}) + row_number() OVER (ORDER BY p_partkey) - 1, p_size {_P}")
on_series("list_insert", "part", "p_size", lambda s: s.insert(2, 77), f"SELECT CASE WHEN r >= 2 THEN r + 1 ELSE r END AS place, p_size AS value FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS r {_P}) UNION ALL SELECT 2, 77")
on_series("list_update", "part", "p_size", lambda s: s.update(3, 55), f"SELECT {_PLACE}, CASE WHEN row_number() OVER (ORDER BY p_partkey) = 4 THEN 55 ELSE p_size END AS value {_P}")
on_series("list_drop", "part", "p_size", lambda s: s.drop(0), f"SELECT * FROM (SELECT {_PLACE}, p_size AS value {_P}) WHERE place > 0")
on_series("list_pop", "part", "p_size", lambda s: s.drop(-1), f"SELECT * FROM (SELECT {_PLACE}, p_size AS value, count(*) OVER () AS n {_P}) WHERE place < n - 1".replace("SELECT * FROM", "SELECT place, value FROM"))
on_series("list_map", "part", "p_size", lambda s: s.transform(F.col("p_size") * F.col("p_size")), f"SELECT {_PLACE}, p_size * p_size AS value {_P}")
on_series("list_upper", "part", "p_type", lambda s: s.upper(), f"SELECT {_PLACE}, upper(p_type) AS value {_P}")
on_series("list_lower", "part", "p_type", lambda s: s.lower(), f"SELECT {_PLACE}, lower(p_type) AS value {_P}")
on_series("list_capitalize", "part", "p_type", lambda s: s.capitalize(), f"SELECT {_PLACE}, upper(p_type[1]) || lower(p_type[2:]) AS value {_P}")
on_series("list_parse_numbers", "part", "p_brand", lambda s: s.transform(F.regexp_replace("p_brand", "Brand#", " ")).parse_numbers(), f"SELECT {_PLACE}, TRY_CAST(trim(replace(p_brand, 'Brand#', ' ')) AS DOUBLE) AS value {_P}")
on_series("list_parse_strings", "part", "p_size", lambda s: s.parse_strings(), f"SELECT {_PLACE}, p_size::VARCHAR AS value {_P}")
on_series("list_sort", "part", "p_size", lambda s: s.sort(False), f"SELECT row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place, p_size AS value {_P}")
on_series("list_rank", "part", "p_size", lambda s: s.rank(), f"SELECT {_PLACE}, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS value {_P}")
on_series("list_normalize", "part", "p_size", lambda s: s.normalize().transform(F.round("p_size", 9)), f"SELECT {_PLACE}, round((p_size - (SELECT min(p_size) {_P})) / (SELECT max(p_size) - min(p_size) {_P}), 9) AS value {_P}")
on_series("list_standardize", "part", "p_size", lambda s: s.standardize().transform(F.round("p_size", 9)), f"SELECT {_PLACE}, round((p_size - (SELECT avg(p_size) {_P})) / (SELECT stddev_samp(p_size) {_P}), 9) AS value {_P}")
on_series("list_replace_first", "part", "p_size", lambda s: s.replace(10, -1, "first"), f"SELECT {_PLACE}, CASE WHEN p_partkey = (SELECT min(p_partkey) {_P} WHERE p_size = 10) THEN -1 ELSE p_size END AS value {_P}")
on_series("list_replace_last", "part", "p_size", lambda s: s.replace(10, -1, "last"), f"SELECT {_PLACE}, CASE WHEN p_partkey = (SELECT max(p_partkey) {_P} WHERE p_size = 10) THEN -1 ELSE p_size END AS value {_P}")
on_series("list_replace_all", "part", "p_size", lambda s: s.replace(10, -1), f"SELECT {_PLACE}, CASE WHEN p_size = 10 THEN -1 ELSE p_size END AS value {_P}")
on_series("list_clear_outliers", "part", "p_retailprice", lambda s: s.clear_outliers(1.5), f"SELECT * EXCLUDE (m, s) FROM (SELECT {_PLACE}, p_retailprice AS value, avg(p_retailprice) OVER () AS m, stddev_samp(p_retailprice) OVER () AS s {_P}) WHERE abs(value - m) <= 1.5 * s")
on_series("list_rolling_apply", "part", "p_size", lambda s: s.windowed(Rolling(3).apply("p_size", lambda v: max(v) - min(v))), f"SELECT {_PLACE}, CASE WHEN count(*) OVER w = 3 THEN (max(p_size) OVER w - min(p_size) OVER w)::DOUBLE END AS value {_P} WINDOW w AS (ORDER BY p_partkey ROWS 2 PRECEDING)")


def _clear(kind: str, column: str):
    def run(spark, d):
        t = _gaps(Table(read(spark, d, "supplier"), "s_suppkey"))
        return Table(t.ordered().select(RID, column)).col(column).clear(kind).table.df.select(F.col(column).alias("value"))

    return run


for _kind, _column, _where in (("nil", "v", "v IS NOT NULL"), ("nan", "v", "v IS NULL OR NOT isnan(v)"), ("nil_or_nan", "v", "v IS NOT NULL AND NOT isnan(v)"), ("number", "v", "v IS NULL"), ("string", "s", "s IS NULL"), ("excel_na", "s", "s <> '#N/A'")):
    query(f"list_clear_{_kind}", f"SELECT {_column} AS value FROM ({_GAP_ROWS}) WHERE {_where}")(_clear(_kind, _column))

on_value("list_stats", "part", lambda t: {"n": len(c := t.col("p_size")), "sum": float(c.sum()), "lo": float(c.min()), "hi": float(c.max()), "range": float(c.range()), "median": float(c.median()), "q1": float(c.quartile(1)), "p90": float(c.percentile(90)), "tens": c.count(10)},
         f"SELECT count(*) AS n, sum(p_size)::DOUBLE AS sum, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, (max(p_size) - min(p_size))::DOUBLE AS range, median(p_size)::DOUBLE AS median, (SELECT s[floor(pos)::INT] + (s[floor(pos)::INT + 1] - s[floor(pos)::INT]) * (pos - floor(pos)) FROM (SELECT list(p_size ORDER BY p_size) AS s, (count(*) + 1) / 4 AS pos FROM part)) AS q1, quantile_cont(p_size, 0.9)::DOUBLE AS p90, count_if(p_size = 10) AS tens {_P}")
on_value("list_get", "part", lambda t: {"first": t.col("p_name").get(0), "last": t.col("p_name").get(-1), "found": len(t.col("p_size").find(10)), "place": str(t.col("p_size").find(10)[0])}, f"SELECT arg_min(p_name, p_partkey) AS first, arg_max(p_name, p_partkey) AS last, count_if(p_size = 10) AS found, (SELECT min(r)::VARCHAR FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS r {_P}) WHERE p_size = 10) AS place {_P}")
on_value("list_equality", "part", lambda t: {"same": (c := t.col("p_size")).is_equal_to(t.col("p_size")), "reversed": c.is_equal_to(c.reverse()), "as_set": c.is_the_same_as(c.reverse())}, "SELECT true AS same, false AS reversed, true AS as_set")
on_value("list_interpolate", "region", lambda t: {how: round(t.col("r_regionkey").transform(F.col("r_regionkey") * F.col("r_regionkey")).interpolate_at(2.5, how), 9) for how in ("linear", "quadratic", "lagrange", "newton", "nearest")}, "SELECT 6.5::DOUBLE AS linear, 6.25::DOUBLE AS quadratic, 6.25::DOUBLE AS lagrange, 6.25::DOUBLE AS newton, 9.0::DOUBLE AS nearest")
on_value("list_hermite", "region", lambda t: {"value": round(t.col("r_regionkey").transform(F.pow("r_regionkey", F.lit(3.0))).interpolate_at(2.5, "hermite", [3.0 * i * i for i in range(5)]), 6)}, "SELECT 15.625::DOUBLE AS value")
on_value("values_parse", "region", lambda t: {"numeric": values.is_numeric(1e3), "text": values.is_numeric("x"), "letters": values.column_letters(27), "number": values.column_number("AB"), "order": ",".join(map(str, values.sort_mixed(["b", 2, True, None, "a", 1.5]))), "root": str(values.square_root("2", 10))[:9], "power": str(values.power("3/2", 3))}, "SELECT true AS numeric, false AS text, 'AB' AS letters, 27 AS number, 'None,True,1.5,2,a,b' AS \"order\", '141421356' AS root, '27/8' AS power")

# Samples: how many rows, from where.

_ORDERS = lambda spark, d: Table(read(spark, d, "orders"), "o_orderkey")


def _sampled(t: Table, whole: Table) -> dict:
    return {"n": t.n_rows, "distinct": t.df.select("o_orderkey").distinct().count(), "inside": t.df.join(whole.df.select("o_orderkey").withColumnRenamed("o_orderkey", "k"), F.col("o_orderkey") == F.col("k"), "left_anti").count() == 0}


on_value("sample_rows", "orders", lambda t: _sampled(t.sample(120, seed=4), t), "SELECT least(120, count(*)) AS n, least(120, count(*)) AS distinct, true AS inside FROM orders".replace("AS distinct", 'AS "distinct"'))
on_value("sample_fraction", "orders", lambda t: _sampled(t.sample_frac(0.25, seed=4), t), "SELECT CAST(floor(count(*) * 0.25) AS BIGINT) AS n, CAST(floor(count(*) * 0.25) AS BIGINT) AS \"distinct\", true AS inside FROM orders")
on_value("sample_again", "orders", lambda t: {k: v for k, v in _sampled(t.sample(500, replace=True, seed=4), t).items() if k != "distinct"}, "SELECT 500 AS n, true AS inside")
on_value("list_sample", "orders", lambda t: {"n": t.select("o_totalprice").sample(50, seed=1).n_rows, "again": [*t.select("o_totalprice").sample(5, seed=1).col(0).values()] == [*t.select("o_totalprice").sample(5, seed=1).col(0).values()]}, "SELECT 50 AS n, true AS again")
on_value("split_rows", "orders", lambda t: {"train": (p := t.train_test_split(0.7, seed=2))[0].n_rows, "test": p[1].n_rows, "both": p[0].df.select("o_orderkey").intersect(p[1].df.select("o_orderkey")).count()}, "SELECT CAST(floor(count(*) * 0.7) AS BIGINT) AS train, count(*) - CAST(floor(count(*) * 0.7) AS BIGINT) AS test, 0 AS both FROM orders".replace("AS both", 'AS "both"'))
on_table("shuffle_rows", "orders", lambda t: t.shuffle(3), "SELECT * FROM orders")

# Encoders and scalers, there and back.

on_table("onehot_inverse", "orders", lambda t: (lambda r: r[0]._with(r[1].inverse_transform(r[0].df)))(t.one_hot("o_orderstatus")), "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
on_table("label_inverse", "orders", lambda t: (lambda r: r[0]._with(r[1].inverse_transform(r[0].df)))(t.label_encode("o_orderpriority")), "SELECT * FROM orders")
on_table("ordinal_encode", "orders", lambda t: t.ordinal_encode("o_orderstatus", ["P", "O", "F"])[0], "SELECT * REPLACE (CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS o_orderstatus) FROM orders")
on_table("ordinal_inverse", "orders", lambda t: (lambda r: r[0]._with(r[1].inverse_transform(r[0].df)))(t.ordinal_encode("o_orderstatus", ["P", "O", "F"])), "SELECT * FROM orders")
on_value("encoder_facts", "orders", lambda t: {"kinds": "/".join((OneHotEncoder.kind, LabelEncoder.kind, OrdinalEncoder.kind)), "categories": ",".join((e := OneHotEncoder("o_orderstatus").fit(t.df, "lexicographic")).values), "columns": ",".join(e.output_columns()), "classes": ",".join((x := LabelEncoder("o_orderstatus", "lexicographic").fit(t.df)).classes), "inverse": ",".join(x.inverse([2, 0]))},
         "SELECT 'onehot/label/ordinal' AS kinds, string_agg(s, ',' ORDER BY s) AS categories, string_agg('o_orderstatus_' || s, ',' ORDER BY s) AS columns, string_agg(s, ',' ORDER BY s) AS classes, list(s ORDER BY s)[3] || ',' || min(s) AS inverse FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)")
for _kind in ("standard", "minmax", "robust", "maxabs"):
    on_table(f"scaler_inverse_{_kind}", "part", lambda t, k=_kind: (lambda r: r[0]._with(r[1].inverse_transform(r[0].df).withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})))(t.scale(k, "p_size", "p_retailprice")), f"SELECT * REPLACE (p_size::DOUBLE AS p_size, round(p_retailprice, 6) AS p_retailprice) {_P}")
on_value("scaler_params", "part", lambda t: {"kind": (s := Scaler("minmax").fit(t.df, ["p_size"])).kind, "center": float(s.params["p_size"][0]), "spread": float(s.params["p_size"][1])}, f"SELECT 'minmax' AS kind, min(p_size)::DOUBLE AS center, (max(p_size) - min(p_size))::DOUBLE AS spread {_P}")
on_series("scaler_list", "part", "p_size", lambda s: Series(Table(Scaler("minmax").fit_transform(s.table.df, ["p_size"]).withColumn("p_size", F.round("p_size", 9))), "p_size"), f"SELECT {_PLACE}, round((p_size - (SELECT min(p_size) {_P})) / (SELECT max(p_size) - min(p_size) {_P})::DOUBLE, 9) AS value {_P}")


@query("agg_custom", "SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread, count(*) AS n FROM orders GROUP BY 1")
def _custom(spark, d):
    import pandas as pd

    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    return bare(_ORDERS(spark, d).group_by("o_orderpriority").aggregate(Agg("o_totalprice", "custom", "spread", spread), Agg(None, "countall", "n")))


# Sources and sinks, there and back.


def round_trip(name: str, table: str, sql_text: str):
    def add(f):
        query(name, sql_text)(lambda spark, d: f(spark, Table(read(spark, d, table), KEYS[table]), folder(spark)))
        return f

    return add


@round_trip("parquet_write", "orders", "SELECT * FROM orders")
def _parquet(spark, t, at):
    t.write_parquet(at)
    return bare(Table.read_parquet(spark, at))


@round_trip("parquet_column", "orders", "SELECT o_totalprice FROM orders")
def _parquet_column(spark, t, at):
    t.write_parquet(at)
    return Table.read_parquet(spark, at, ["o_totalprice"]).df


@round_trip("json_string", "nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _json_text(spark, t, at):
    return text.read_json_data(spark, t.to_json()).select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint"))


@round_trip("csv_string", "nation", "SELECT n_nationkey::DOUBLE AS a, n_name AS b FROM nation")
def _csv_text(spark, t, at):
    return text.read_csv_string(spark, "a,b\n" + "\n".join(f"{r[0]},{r[1]}" for r in t.collect())).select("a", "b")


@round_trip("sql_write", "nation", "SELECT n_nationkey, n_name FROM nation")
def _sql_write(spark, t, at):
    name = f"written_{at.rsplit('/', 1)[-1]}"
    t.select("n_nationkey", "n_name").write_sql(name, if_exists="replace")
    out = sql.read(spark, sql.Query(table=name))
    rows = out.select("n_nationkey", "n_name").collect()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@round_trip("interop_frames", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _frames(spark, t, at):
    return interop.from_pandas(spark, t.to_pandas()).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


# Money over columns.

#: Columns are made when a query runs: before that there is no session.
_T = "o_totalprice"
_months = "(1.0 + o_orderkey % 36)::DOUBLE"


def money(name: str, names: str, made: Callable, sql_text: str, digits: int = 6) -> None:
    """Columns ``names`` made from a price and a number of months, over the orders."""

    def build(t):
        return t.select("o_orderkey", *[c.alias(k) for k, c in zip(names.split(), made(F.col(_T), F.lit(1.0) + F.col("o_orderkey") % 36))])

    simple(f"fin_{name}", "orders", build, f"SELECT o_orderkey, {sql_text} FROM orders", rounded=names, digits=digits)


_R = "0.01::DOUBLE"
_PMT = f"(-{_T} * 1.01::DOUBLE ^ {_months} * {_R} / (1.01::DOUBLE ^ {_months} - 1))"
money("pv", "pv", lambda k, n: [FN.pv_column(F.lit(0.01), n, k)], f"-{_T} * (1 - 1.01::DOUBLE ^ (-{_months})) / {_R} AS pv", 4)
money("fv", "fv", lambda k, n: [FN.fv_column(F.lit(0.01), n, k, 100.0, FN.BEGIN)], f"-({_T} * 1.01::DOUBLE * (1.01::DOUBLE ^ {_months} - 1) / {_R} + 100 * 1.01::DOUBLE ^ {_months}) AS fv", 4)
money("pmt", "pmt", lambda k, n: [FN.pmt_column(F.lit(0.01), n, k)], f"{_PMT} AS pmt", 4)
money("nper", "n", lambda k, n: [FN.nper_column(F.lit(0.01), -k / 20, k)], f"-ln(1 - {_R} * 20) / ln(1.01::DOUBLE) AS n")
money("ipmt", "interest", lambda k, n: [FN.ipmt_column(F.lit(0.01), F.lit(1.0), n, k)], f"-{_T} * {_R} AS interest", 4)
money("ppmt", "principal", lambda k, n: [FN.ppmt_column(F.lit(0.01), F.lit(1.0), n, k)], f"{_PMT} + {_T} * {_R} AS principal", 4)
money("syd", "syd", lambda k, n: [FN.syd_column(k, F.lit(100.0), F.lit(8.0), F.lit(3.0))], f"({_T} - 100) * 6 * 2 / 72 AS syd")
money("rates", "effective nominal", lambda k, n: [FN.effective_rate_column(F.lit(0.06), n), FN.nominal_rate_column(F.lit(0.06), n)], f"(1 + 0.06::DOUBLE / {_months}) ^ {_months} - 1 AS effective, (1.06::DOUBLE ^ (1 / {_months}) - 1) * {_months} AS nominal", 9)
money("tbills", "price yield", lambda k, n: [FN.tbill_price_column(n, F.lit(0.05)), FN.tbill_yield_column(n, F.lit(98.0))], f"100 * (1 - 0.05::DOUBLE * {_months} / 360) AS price, 2.0::DOUBLE / 98 * 360 / {_months} AS \"yield\"", 9)


def decimals(name: str, f: Callable, columns: dict[str, str], rest: tuple, sql_text: str, digits: int = 6) -> None:
    """A decimal function of a row's cells, in Arrow batches, over the customers."""

    def build(t):
        return FN.per_row(t.select("c_custkey", *[F.expr(c).alias(k) for k, c in columns.items()]), "v", f, list(columns), *rest).select("c_custkey", F.col("v").cast("double").alias("v"))

    simple(f"fin_{name}", "customer", build, f"SELECT c_custkey, {sql_text} AS v FROM customer", rounded="v", digits=digits)


_a, _y = _A, _Y = "(abs(c_acctbal) + 1000)", "(1 + c_custkey % 9)"
decimals("effective_exact", lambda n, r: FN.effective_rate(r, n), {"n": _Y}, (0.08,), f"(1 + 0.08::DOUBLE / {_y}) ^ {_y} - 1", 8)
decimals("nominal_exact", lambda n, r: FN.nominal_rate(r, n), {"n": _Y}, (0.08,), f"(1.08::DOUBLE ^ (1.0 / {_y}) - 1) * {_y}", 8)
decimals("continuous", lambda n: FN.continuous_from_annual(n / 100), {"n": _Y}, (), f"ln(1 + {_y} / 100.0::DOUBLE)", 8)
decimals("annual", lambda n: FN.annual_from_continuous(n / 100), {"n": _Y}, (), f"exp({_y} / 100.0::DOUBLE) - 1", 8)
decimals("sln_exact", FN.sln, {"cost": _A}, (100, 7), f"({_a} - 100) / 7", 6)
decimals("syd_exact", lambda cost, per: FN.syd(cost, 100, 10, per), {"cost": _A, "per": _Y}, (), f"({_a} - 100) * (10 - {_y} + 1) * 2 / 110", 6)
decimals("ddb", lambda cost, per: FN.ddb(cost, 0, 10, per), {"cost": _A, "per": _Y}, (), f"{_a} * 0.8::DOUBLE ^ ({_y} - 1) * 0.2", 5)
decimals("vdb", lambda cost, per: FN.vdb(cost, 0, 10, 0, per, no_switch=True), {"cost": _A, "per": _Y}, (), f"{_a} * (1 - 0.8::DOUBLE ^ {_y})", 5)
decimals("cum_ppmt", lambda n, pv: FN.cum_ppmt(0.01, n, pv, 1, n), {"n": _Y, "pv": _A}, (), f"-{_a}", 5)
decimals("cum_ipmt", lambda n, pv: FN.cum_ipmt(0.01, n, pv, 1, n), {"n": _Y, "pv": _A}, (), f"{_a} - {_a} * 1.01::DOUBLE ^ {_y} * 0.01 / (1.01::DOUBLE ^ {_y} - 1) * {_y}", 5)
decimals("ipmt_exact", lambda n, pv: FN.ipmt(0.01, 1, n, pv), {"n": _Y, "pv": _A}, (), f"-{_a} * 0.01", 6)
decimals("ppmt_exact", lambda n, pv: FN.ppmt(0.01, n, n, pv), {"n": _Y, "pv": _A}, (), f"-{_a} * 1.01::DOUBLE ^ {_y} * 0.01 / (1.01::DOUBLE ^ {_y} - 1) / 1.01", 5)
decimals("pv_of_annuity", lambda n, p: FN.pv(0.01, n, p), {"n": _Y, "p": _A}, (), f"-{_a} * (1 - 1.01::DOUBLE ^ (-{_y})) / 0.01", 5)
decimals("fv_of_annuity", lambda n, p: FN.fv(0.01, n, p), {"n": _Y, "p": _A}, (), f"-{_a} * (1.01::DOUBLE ^ {_y} - 1) / 0.01", 5)
decimals("nper_exact", lambda p: FN.nper(0.01, -p / 20, p), {"p": _A}, (), "-ln(1 - 0.01::DOUBLE * 20) / ln(1.01::DOUBLE)", 8)
decimals("rate", lambda n: FN.rate(n, FN.pmt(0.02, n, 1000, scale=25), 1000), {"n": "2 + c_custkey % 9"}, (), "0.02::DOUBLE", 8)
decimals("npv_excel", lambda a: FN.npv_excel(0.1, [-a, a, a]), {"a": _A}, (), f"-{_a} / 1.1::DOUBLE + {_a} / 1.1::DOUBLE ^ 2 + {_a} / 1.1::DOUBLE ^ 3", 5)
decimals("npv_exact", lambda a: FN.npv(0.1, [-a, a, a]), {"a": _A}, (), f"-{_a} + {_a} / 1.1::DOUBLE + {_a} / 1.1::DOUBLE ^ 2", 5)
decimals("irr", lambda a, n: FN.irr([-a, a * (1 + n / 100)]), {"a": _A, "n": _Y}, (), f"{_y} / 100.0::DOUBLE", 8)
decimals("mirr", lambda a: FN.mirr([-a, a, a], 0.1, 0.12), {"a": _A}, (), "sqrt(2.12::DOUBLE) - 1", 8)


def _dates(year: int):
    import datetime as dt

    return [dt.date(year, 1, 1), dt.date(year + 1, 1, 1)]


decimals("xnpv", lambda a: FN.xnpv(0.1, [-a, a], _dates(2021)), {"a": _A}, (), f"-{_a} + {_a} / 1.1::DOUBLE", 5)
decimals("xirr", lambda a, n: FN.xirr([-a, a * (1 + n / 100)], _dates(2021)), {"a": _A, "n": _Y}, (), f"{_y} / 100.0::DOUBLE", 8)


def _bond(f: Callable, *args):
    """A function of a bond that runs for so many whole years from a coupon date."""
    import datetime as dt

    return lambda n: f(dt.date(2020, 1, 1), dt.date(2020 + int(n), 1, 1), *args)


decimals("price", _bond(FN.price, 0.05, 0.06, 100, 1), {"n": _Y}, (), f"5 * (1 - 1.06::DOUBLE ^ (-{_y})) / 0.06 + 100 / 1.06::DOUBLE ^ {_y}", 6)
decimals("yield", lambda n: _bond(FN.bond_yield, 0.05, _bond(FN.price, 0.05, 0.06, 100, 1)(n), 100, 1)(n), {"n": _Y}, (), "0.06::DOUBLE", 6)
_pv_of_bond = f"(5 * (1 - 1.06::DOUBLE ^ (-{_y})) / 0.06 + 100 / 1.06::DOUBLE ^ {_y})"
_weighted = f"(5 * ((1 - 1.06::DOUBLE ^ (-{_y})) / 0.06 * 1.06 - {_y} * 1.06::DOUBLE ^ (-{_y})) / 0.06 + 100 * {_y} / 1.06::DOUBLE ^ {_y})"
decimals("duration", _bond(FN.duration, 0.05, 0.06, 1), {"n": _Y}, (), f"{_weighted} / {_pv_of_bond}", 6)
decimals("mduration", _bond(FN.modified_duration, 0.05, 0.06, 1), {"n": _Y}, (), f"{_weighted} / {_pv_of_bond} / 1.06", 6)


def _in_days(f: Callable, *args):
    import datetime as dt

    return lambda n: f(dt.date(2021, 1, 1), dt.date(2021, 1, 1) + dt.timedelta(days=int(n) * 10), *args)


decimals("tbill_price", _in_days(FN.tbill_price, 0.05), {"n": _Y}, (), f"100 * (1 - 0.05::DOUBLE * {_y} * 10 / 360)", 8)
decimals("tbill_yield", _in_days(FN.tbill_yield, 98), {"n": _Y}, (), f"2.0::DOUBLE / 98 * 360 / ({_y} * 10)", 8)
decimals("tbill_eq", _in_days(FN.tbill_eq, 0.05), {"n": _Y}, (), f"365 * 0.05::DOUBLE / (360 - 0.05 * {_y} * 10)", 8)


def _accrued(n):
    import datetime as dt

    return FN.accrued_interest(dt.date(2021, 1, 1), dt.date(2021, 7, 1), dt.date(2021, 1, 1) + dt.timedelta(days=int(n) * 10), 0.06, 1000, 2, 3)


decimals("accrint", _accrued, {"n": _Y}, (), f"1000 * 0.06::DOUBLE * {_y} * 10 / 365", 8)
on_value("fin_decimals", "region", lambda t: {"text": str(FN.dec("1.10")), "whole": str(FN.dec(7)), "real": str(FN.dec(0.1)), "rounded": str(FN.sln(10, 0, 3, scale=4))}, "SELECT '1.10' AS text, '7' AS whole, '0.1' AS real, '3.3333' AS rounded")


# Commands: each gives what the operator behind it gives.


def command(name: str, table: str, script: str, sql_text: str, result: str = "t", columns: str = "*") -> None:
    """Lines of the command language over a table called ``t``; a list comes as its places and values."""

    def run(spark, d):
        s = Session(spark)
        s.variables["t"] = Table(read(spark, d, table).selectExpr(*([columns] if columns == "*" else columns.split(", "))), KEYS[table])
        last = s.run(script)
        got = s.variables.get(result) if result else last
        if isinstance(got, Series):
            return got.table.ordered().select(F.col(RID).alias("place"), F.col(got.name).alias("value"))
        if isinstance(got, (Table, DataFrame)):
            return bare(got)
        return spark.createDataFrame([(str(got),)], "value string")

    query(f"cmd_{name}", sql_text)(run)


_LIST = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, {} AS value FROM part"
_W = " WINDOW w AS (ORDER BY p_partkey ROWS {})"
command("filter", "nation", "filter t ['n_regionkey'] == 2 as t", f"SELECT * {_N} WHERE n_regionkey = 2")
command("ccl", "nation", "ccl t NEW('x') = ['n_nationkey'] * 2", f"SELECT *, n_nationkey * 2.0::DOUBLE AS x {_N}")
command("addcolccl", "nation", "addcolccl t y ['n_regionkey'] + 1", f"SELECT *, n_regionkey + 1.0::DOUBLE AS y {_N}")
command("sort", "nation", "sort t n_name desc\nrow t 0 as r", f"SELECT i - 1 AS place, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR][i] AS value FROM (SELECT * {_N} ORDER BY n_name DESC LIMIT 1), range(1, 4) x(i)", "r")
command("groupby", "orders", "groupby t by o_orderstatus agg o_totalprice:max:hi :countall:n as g", "SELECT o_orderstatus, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1", "g")
command("pivot", "orders", "pivot t index o_orderpriority columns o_orderstatus values o_orderkey agg count fillna 0 as p", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS F, count_if(o_orderstatus = 'O') AS O, count_if(o_orderstatus = 'P') AS P FROM orders GROUP BY 1", "p")
command("unpivot", "part", "unpivot t idvars p_partkey valuevars p_size,p_retailprice as u", f"SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value {_P} UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice {_P}", "u")
command("dropcol", "part", "dropcol t p_name 3", f"SELECT * EXCLUDE (p_name, p_type) {_P}".replace("p_name, p_type", "p_name, p_type"))
command("droprow", "nation", "droprow t 0 1", f"SELECT * {_N} WHERE n_nationkey > 1")
command("set", "nation", "set t 1 n_name HERE", f"SELECT * REPLACE (CASE WHEN n_nationkey = 1 THEN 'HERE' ELSE n_name END AS n_name) {_N}")
command("swap", "nation", "setcolnames t a b c\nswap t col a c\nsetcolnames t x y z", f"SELECT n_regionkey AS x, n_name AS y, n_nationkey AS z {_N}")
command("replace", "nation", "replace t 3 33", f"SELECT CASE n_nationkey WHEN 3 THEN 33 ELSE n_nationkey END AS n_nationkey, n_name, CASE n_regionkey WHEN 3 THEN 33 ELSE n_regionkey END AS n_regionkey {_N}")
command("clone", "nation", "clone t as u\ndrop t", f"SELECT * {_N}", "u")
command("rename", "nation", "rename t u", f"SELECT * {_N}", "u")
command("addcol", "region", "addcol t 5 6 7 8 9", "SELECT r_regionkey, r_regionkey + 5 AS col FROM region", "t", "r_regionkey")
command("addrow", "region", "addrow t 50 MOON", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'MOON'", "t", "r_regionkey, r_name")
command("clean", "supplier", "clean t nil", "SELECT s_suppkey, v FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier) WHERE v IS NOT NULL", "t", "s_suppkey, case when s_suppkey % 3 = 0 then null else s_acctbal end as v")
command("fillna", "supplier", "fillna t mean cols v", "SELECT s_suppkey, coalesce(v, (SELECT avg(s_acctbal) FROM supplier WHERE s_suppkey % 3 <> 0)) AS v FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS v FROM supplier)", "t", "s_suppkey, case when s_suppkey % 3 = 0 then null else s_acctbal end as v")
command("col", "part", "col t p_size as c", _LIST.format("p_size"), "c")
command("reverse", "part", "col t p_size as c\nreverse c", "SELECT row_number() OVER (ORDER BY p_partkey DESC) - 1 AS place, p_size AS value FROM part", "c")
command("upper", "part", "col t p_type as c\nupper c", _LIST.format("upper(p_type)"), "c")
command("lower", "part", "col t p_type as c\nlower c", _LIST.format("lower(p_type)"), "c")
command("capitalize", "part", "col t p_type as c\ncapitalize c", _LIST.format("upper(p_type[1]) || lower(p_type[2:])"), "c")
command("rank", "part", "col t p_size as c\nrank c", _LIST.format("rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2"), "c")
command("shift", "part", "col t p_size as c\nshift c 2", _LIST.format("lag(p_size, 2) OVER (ORDER BY p_partkey)"), "c")
command("diff", "part", "col t p_size as c\ndiff c", _LIST.format("(p_size - lag(p_size) OVER (ORDER BY p_partkey))::DOUBLE"), "c")
command("pctchange", "part", "col t p_size as c\npctchange c 1", _LIST.format("(p_size - lag(p_size) OVER (ORDER BY p_partkey)) / nullif(lag(p_size) OVER (ORDER BY p_partkey), 0)::DOUBLE"), "c")
command("movavg", "part", "col t p_size as c\nmovavg c 4", _LIST.format("CASE WHEN count(*) OVER w = 4 THEN avg(p_size) OVER w END") + _W.format("3 PRECEDING"), "c")
command("cumsum", "part", "col t p_size as c\ncumsum c", _LIST.format("(sum(p_size) OVER w)::DOUBLE") + _W.format("UNBOUNDED PRECEDING"), "c")
command("cummax", "part", "col t p_size as c\ncummax c", _LIST.format("(max(p_size) OVER w)::DOUBLE") + _W.format("UNBOUNDED PRECEDING"), "c")
command("cummin", "part", "col t p_size as c\ncummin c", _LIST.format("(min(p_size) OVER w)::DOUBLE") + _W.format("UNBOUNDED PRECEDING"), "c")
command("rolling", "part", "col t p_size as c\nrolling c 3 max", _LIST.format("CASE WHEN count(*) OVER w = 3 THEN (max(p_size) OVER w)::DOUBLE END") + _W.format("2 PRECEDING"), "c")
for _name, _sql in (("sum", "sum(p_size)::DOUBLE"), ("min", "min(p_size)::DOUBLE"), ("max", "max(p_size)::DOUBLE"), ("range", "(max(p_size) - min(p_size))::DOUBLE"), ("median", "median(p_size)::DOUBLE"), ("mean", "avg(p_size)")):
    command(_name, "part", f"col t p_size as c\n{_name} c", f"SELECT {_sql}::VARCHAR AS value FROM part", "")
command("count", "part", "col t p_size as c\ncount c 10", "SELECT count_if(p_size = 10)::VARCHAR AS value FROM part", "")
command("shape", "part", "shape t", "SELECT '(' || count(*) || ', 6)' AS value FROM part", "")
command("get", "nation", "get t 4 n_name", f"SELECT n_name AS value {_N} WHERE n_nationkey = 4", "")
command("find", "nation", "find t 24", f"SELECT '[' || string_agg(n_nationkey::VARCHAR, ', ' ORDER BY n_nationkey) || ']' AS value {_N} WHERE n_nationkey = 24 OR n_regionkey = 24", "")
command("encode", "orders", "encode t ordinal o_orderstatus order P,O,F as u", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS o_orderstatus FROM orders", "u", "o_orderkey, o_orderstatus")
command("merge", "nation", "col t n_regionkey as c\nclone t as u\nmerge t u horizontal inner on n_nationkey as m", f"SELECT n_nationkey, n_name, n_regionkey, n_name AS n_name_other, n_regionkey AS n_regionkey_other {_N}", "m")
