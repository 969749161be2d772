"""Joins, unions, reshaping, order and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.aggregate import aggregate_column, is_float, missing

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_other"
    return name


def merge(left: DataFrame, right: DataFrame, how: str, on: str | Sequence[str]) -> DataFrame:
    """Join on one key, or on one key of each side; null meets null. The key appears once, under the left name.

    Right columns whose names are taken get ``_other``. A join strategy is left
    to Catalyst, which broadcasts a side only below its size threshold.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in HOW or not 1 <= len(keys) <= 2:
        raise ValueError("a merge is inner, left, right or outer, on one key or one key of each side")
    lk, rk = keys[0], keys[-1]
    if lk not in left.columns or rk not in right.columns:
        raise ValueError(f"no key {lk!r} on the left or {rk!r} on the right")
    names, taken = {}, set(left.columns)
    for c in right.columns:
        names[c] = "__right_key" if c == rk else _free(c, taken)
        taken.add(names[c])
    r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = left.join(r, left[lk].eqNullSafe(r["__right_key"]), HOW[how])
    key = F.coalesce(left[lk], r["__right_key"]) if how in ("right", "outer") else left[lk]
    return joined.select(*[key.alias(c) if c == lk else left[c] for c in left.columns], *[r[n] for c, n in names.items() if c != rk])


def merge_on_row_names(left: DataFrame, right: DataFrame, how: str, name: str = "__rowname") -> DataFrame:
    """Join on row names; rows without a name meet nothing, but stay where the side is kept."""
    names, taken = {}, set(left.columns)
    for c in right.columns:
        names[c] = "__right_name" if c == name else _free(c, taken)
        taken.add(names[c])
    r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = left.join(r, left[name] == r["__right_name"], HOW[how])
    return joined.select(*[F.coalesce(left[c], r["__right_name"]).alias(c) if c == name else left[c] for c in left.columns], *[r[n] for n in names.values() if n != "__right_name"])


def stack(top: DataFrame, bottom: DataFrame, how: str = "outer") -> DataFrame:
    """Rows of both: over the shared columns (inner), or over all with nulls (outer, left, right)."""
    if how not in HOW:
        raise ValueError(f"unknown mode {how!r}")
    if how != "inner":
        return top.unionByName(bottom, allowMissingColumns=True)
    shared = [c for c in top.columns if c in bottom.columns]
    return top.select(*shared).unionByName(bottom.select(*shared))


def unique_names(df: DataFrame, name: str = "__rowname", order_by: str = ordering.RID) -> DataFrame:
    """Repeated row names get ``_1``, ``_2``; rows without a name stay so."""
    at = F.row_number().over(W.partitionBy(name).orderBy(order_by)) - 1
    return df.withColumn(name, F.when(F.col(name).isNotNull() & (at > 0), F.concat_ws("_", name, at.cast("string"))).otherwise(F.col(name)))


def printed(c: Column) -> Column:
    """A value as the headers of a pivot print it: whole numbers without a fraction, null as <nil>."""
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.coalesce(text, F.lit("<nil>"))


#: Distinct values that may become columns.
MAX_COLUMNS = 10_000


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: str, agg: str | None = None, fill=None, sort_columns: bool = False, order_by: str | None = None, custom=None) -> DataFrame:
    """Long to wide. Without ``agg`` a repeated cell is an error; columns in first-seen order, or sorted.

    The column values are listed first: they are the output's schema, and their
    number is checked.
    """
    if {columns, values} & set(index) or columns == values:
        raise ValueError("index, columns and values must not overlap")
    at = F.min(order_by if order_by else "__at")
    df = df if order_by else df.withColumn("__at", F.monotonically_increasing_id())
    seen = df.groupBy(F.col(columns).alias("v")).agg(at.alias("at"))
    order = [F.col("v").asc_nulls_first()] if sort_columns else [F.col("at"), F.col("v")]
    found = seen.orderBy(*order).limit(MAX_COLUMNS + 1).select(printed(F.col("v")).alias("p")).collect()
    heads = [r.p for r in found]
    if len(heads) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    if len(set(heads)) < len(heads) or set(heads) & set(index):
        raise ValueError("two columns of the pivot have the same header")
    keyed = df.drop("__at").withColumn("__head", printed(F.col(columns)))
    order_column = F.col(order_by) if order_by else None
    if agg is None:
        cells = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell of the pivot has several values"))).otherwise(F.first(values))
    else:
        cells = aggregate_column(df, values, agg, order_column, custom)
    out = keyed.groupBy(*index).pivot("__head", heads).agg(cells)
    return out.fillna(fill, subset=heads) if fill is not None and heads else out


def unpivot(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value", drop_na: bool = False) -> DataFrame:
    """Wide to long; without value columns there are no rows."""
    if var_name == value_name:
        raise ValueError("variable and value need different names")
    values = [c for c in df.columns if c not in id_vars] if value_vars is None else list(value_vars)
    if not values:
        return df.select(*id_vars, F.lit(None).cast("string").alias(var_name), F.lit(None).cast("string").alias(value_name)).limit(0)
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    if len(kinds) > 1:
        wide = "double" if all(k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal") for k in kinds) else "string"
        df = df.withColumns({c: F.col(c).cast(wide) for c in values})
    out = df.unpivot(list(id_vars), values, var_name, value_name)
    return out.filter(~missing(out, value_name)) if drop_na else out


def transpose(df: DataFrame, order_by: str, names: str | None = None, limit: int = 2000) -> DataFrame:
    """Rows to columns, as text unless all columns are of one type. The rows become the schema, so their number is limited."""
    body = [c for c in df.columns if c not in (order_by, names)]
    rows = df.orderBy(order_by).limit(limit + 1)
    long = unpivot(rows.select(order_by, *([names] if names else []), *body), [order_by, *([names] if names else [])], body, "column", "__value")
    heads = [r[0] for r in rows.select(F.coalesce(F.col(names).cast("string"), F.col(order_by).cast("string")) if names else F.col(order_by).cast("string")).collect()]
    if len(heads) > limit:
        raise ValueError(f"more than {limit} rows to turn into columns")
    at = F.create_map(*[x for i, c in enumerate(body) for x in (F.lit(c), F.lit(i))])
    head = F.coalesce(F.col(names).cast("string"), F.col(order_by).cast("string")) if names else F.col(order_by).cast("string")
    return long.withColumn("__head", head).groupBy("column").pivot("__head", heads).agg(F.first("__value")).orderBy(at[F.col("column")])


def sort_by(df: DataFrame, keys: Sequence[tuple[str, bool]], tie: str | None = None) -> DataFrame:
    """Stable order by (column, ascending); null first ascending and last descending, NaN above all numbers."""
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys if c in df.columns]
    return df.orderBy(*order, *([tie] if tie else []))


def _random(seed: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def sample(df: DataFrame, n: int, seed: int = 0, replace: bool = False, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly n rows, by a hash of the keys (all columns, if None); with replacement, n draws of row numbers.

    n of no use (none, or more than there are) gives an empty table. Without
    replacement only the n rows of the least hashes leave their tasks.
    """
    keys = list(keys or df.columns)
    if n <= 0:
        return df.limit(0)
    if not replace:
        return df.limit(0) if df.count() < n else df.orderBy(_random(seed, keys), *keys).limit(n)
    numbered = ordering.number_rows(df, keys)
    total = numbered.count()
    if not total:
        return df
    draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias(ordering.RID))
    return draws.join(numbered, ordering.RID).drop(ordering.RID)


def sample_frac(df: DataFrame, fraction: float, seed: int = 0, replace: bool = False, keys: Sequence[str] | None = None) -> DataFrame:
    """floor(n * fraction) rows, one at least."""
    n = df.count()
    return sample(df, max(1, int(n * fraction)) if n and fraction > 0 else 0, seed, replace, keys)


def simple_random_sample(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] | None = None) -> DataFrame:
    """n rows, or the whole table where it has no more."""
    return df if n >= df.count() else sample(df, n, seed, keys=keys)


def shuffle(df: DataFrame, seed: int = 0, keys: Sequence[str] | None = None) -> DataFrame:
    keys = list(keys or df.columns)
    return df.orderBy(_random(seed, keys), *keys)


def train_test_split(df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] | None = None, keep_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first floor(n * fraction) rows in the random order, or in the given one, and the rest."""
    keys = list(keys or df.columns)
    numbered = ordering.number_rows(df, keys if keep_order else [_random(seed, keys), *map(F.col, keys)])
    cut = int(numbered.count() * fraction)
    first = F.col(ordering.RID) < cut
    return numbered.filter(first).drop(ordering.RID), numbered.filter(~first).drop(ordering.RID)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in df.columns if is_float(df, c)})
