"""Grouped aggregation, list statistics and describe.

Everything is a declarative aggregate, so Spark combines on the map side.
``percentile`` is exact and holds the distinct values of a group; for whole
columns ``quantiles`` computes the same values by ranks over partitioned sums of
counts instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordering import RID

#: Textual names of the grouped operations.
OP_NAMES = {
    "sum": "sum", "mean": "mean", "avg": "mean", "average": "mean", "median": "median", "min": "min", "max": "max", "count": "count", "countall": "countall",
    "std": "std", "stdev": "std", "stddev": "std", "stdp": "stdp", "stdevp": "stdp", "stddevp": "stdp", "var": "var", "variance": "var", "varp": "varp",
    "first": "first", "last": "last", "nunique": "nunique", "custom": "custom",
}

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a float column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; cells that are no numbers are null."""
    return F.col(name).cast("double") if is_numeric(df, name) else F.lit(None).cast("double")


@dataclass(frozen=True)
class Agg:
    """One aggregate: source column, operation, name, and for ``custom`` a function of a pandas Series."""

    source: str | None
    op: str
    alias: str | None = None
    custom: Callable | None = None


def aggregate_column(df: DataFrame, source: str | None, op: str, order: Column | None = None, custom: Callable | None = None) -> Column:
    """The aggregate expression; ``order`` settles first and last."""
    if op not in OP_NAMES:
        raise ValueError(f"unknown aggregate operation {op!r}")
    op = OP_NAMES[op]
    if op == "countall":
        return F.count(F.lit(1))
    if source is None:
        raise ValueError(f"{op} needs a column")
    if source not in df.columns:
        raise ValueError(f"no column {source!r}")
    c, x = F.col(source), number(df, source)
    sane = F.when(~F.isnan(x), x)
    if op in ("first", "last"):
        if order is None:
            raise ValueError("first and last need an order of the rows")
        at = order
        return (F.min_by if op == "first" else F.max_by)(c, F.when(c.isNotNull(), at))
    if op == "custom":
        if custom is None:
            raise ValueError("custom needs a function")
        return F.pandas_udf(_of_series(custom), "double")(c)
    return {
        "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "median": lambda: F.percentile(sane, F.lit(0.5)), "min": lambda: F.min(sane), "max": lambda: F.max(sane),
        "count": lambda: F.count(c), "std": lambda: F.stddev_samp(x), "stdp": lambda: F.stddev_pop(x), "var": lambda: F.var_samp(x), "varp": lambda: F.var_pop(x),
        "nunique": lambda: F.count_distinct(c),
    }[op]()


def _of_series(custom: Callable) -> Callable:
    """A function of a pandas Series as a grouped aggregate, however its own arguments are annotated."""
    import pandas as pd

    def run(s):
        return float(custom(s))

    run.__annotations__ = {"s": pd.Series, "return": float}
    return run


def group_aggregate(df: DataFrame, keys: list[str], aggs: Iterable[Agg], order_by: str | None = None, nan_on_empty: bool = False) -> DataFrame:
    """One row per group; null and NaN keys are groups. An empty aggregate is null, or NaN where asked for."""
    order = F.col(order_by) if order_by else (F.col(RID) if RID in df.columns else None)
    plain, custom, names = [], [], []
    for a in aggs:
        op = OP_NAMES.get(a.op, a.op)
        c = aggregate_column(df, a.source, a.op, order, a.custom)
        if nan_on_empty and op in ("sum", "mean", "median", "min", "max", "std", "stdp", "var", "varp"):
            c = F.coalesce(c, F.lit(float("nan")))
        names.append(a.alias or ("count_all" if op == "countall" and a.source is None else f"{a.source}_{op}"))
        (custom if op == "custom" else plain).append(c.alias(names[-1]))
    if not custom:
        return df.groupBy(*keys).agg(*plain)
    # Python aggregates can't stand beside others: they are computed on their own and meet them by the keys.
    theirs = df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(*custom)
    ours = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    both = ours.join(theirs, [ours[k].eqNullSafe(theirs[f"__key{i}"]) for i, k in enumerate(keys)])
    return both.select(*keys, *names)


def aggregate_all(df: DataFrame, keys: list[str], op: str, order_by: str | None = None) -> DataFrame:
    return group_aggregate(df, keys, [Agg(c, op) for c in df.columns if c not in keys and c != RID], order_by)


def group_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


# Statistics of one column. Each returns an aggregate expression over a double column.


def type7(c: Column, p: float) -> Column:
    """Percentile with linear interpolation at p(n-1)."""
    return F.percentile(c, F.lit(float(p)))


def type6(c: Column, p: float) -> Column:
    """Quartile at position p(n+1), as an expression over the sorted values."""
    v = F.array_sort(F.collect_list(c))
    n = F.size(v)
    at = F.lit(float(p)) * (n + 1)
    low = F.greatest(F.lit(1), F.least(n, F.floor(at).cast("int")))
    high = F.greatest(F.lit(1), F.least(n, F.floor(at).cast("int") + 1))
    return F.when(n > 0, F.element_at(v, low) + (F.element_at(v, high) - F.element_at(v, low)) * F.greatest(F.lit(0.0), at - F.floor(at)))


def quantiles(df: DataFrame, column: str, probabilities: Iterable[float], kind: int = 7) -> dict[float, float | None]:
    """Exact quantiles of type 6 or 7 of a whole column at any size."""
    return quantiles_of(df, [column], probabilities, kind)[column]


def quantiles_of(df: DataFrame, columns: list[str], probabilities: Iterable[float], kind: int = 7) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of several columns, in one pass.

    Values are counted by column first; running sums over ranges of (column,
    value) then tell which values hold the wanted ranks, so no task holds all
    values of a column.
    """
    from millrace.operators.ordering import number_rows, running

    wanted = list(probabilities)
    if not wanted or not columns:
        return {c: {} for c in columns}
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), number(df, c).alias("v")) for i, c in enumerate(columns)]))
    counts = df.select(cells).filter("v is not null and not isnan(v)").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = running(number_rows(counts, ["c", "v"]), {"upto": (F.col("n"), "sum")})
    ends = {r.c: r.upto for r in upto.groupBy("c").agg(F.max("upto").alias("upto")).collect()}
    before, asked = 0, {}
    for i in sorted(ends):
        n = ends[i] - before
        for p in wanted:
            at = min(max(p * (n - 1) + 1 if kind == 7 else p * (n + 1), 1), n)
            asked[i, p] = before + int(at), before + min(int(at) + 1, n), at - int(at)
        before = ends[i]
    needed = sorted({r for a, b, _ in asked.values() for r in (a, b)})
    of = {}
    if needed:
        hit = upto.select("v", F.explode(F.filter(F.array(*[F.lit(r) for r in needed]), lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))).alias("r"))
        of = {r.r: r.v for r in hit.collect()}
    value = lambda a, b, f: of[a] + (of[b] - of[a]) * f
    return {c: {p: value(*asked[i, p]) if (i, p) in asked else None for p in wanted} for i, c in enumerate(columns)}


#: Statistics that come from the sorted values.
RANKED = ("median", "q1", "q2", "q3", "iqr")


def column_stats(df: DataFrame, column: str, only: Iterable[str] | None = None) -> DataFrame:
    """One row with the statistics of a numeric column: sum, mean, min, max, range, median, gmean, var, varp, stdev, stdevp, q1, q2, q3, iqr, or ``only`` some.

    Those of the sorted values come from ``quantiles``, so no task holds the column.
    """
    x = number(df, column)
    d = df.select(F.when(~F.isnan(x), x).alias("x"))
    plain = {
        "sum": F.sum("x"), "mean": F.avg("x"), "min": F.min("x"), "max": F.max("x"), "range": F.max("x") - F.min("x"), "gmean": F.exp(F.avg(F.when(F.col("x") > 0, F.ln("x")))),
        "var": F.var_samp("x"), "varp": F.var_pop("x"), "stdev": F.stddev_samp("x"), "stdevp": F.stddev_pop("x"),
    }
    names = list(only) if only is not None else ["sum", "mean", "min", "max", "range", "median", "gmean", "var", "varp", "stdev", "stdevp", "q1", "q2", "q3", "iqr"]
    at = {}
    if any(n in RANKED for n in names):
        q = quantiles(df, column, (0.25, 0.5, 0.75), kind=6)
        at = {"q1": q[0.25], "q2": q[0.5], "q3": q[0.75], "median": q[0.5], "iqr": None if q[0.25] is None else q[0.75] - q[0.25]}
    row = d.agg(*[plain[n].alias(n) for n in names if n in plain] or [F.count("x").alias("__n")])
    return row.select(*[F.col(n) if n in plain else F.lit(at[n]).cast("double").alias(n) for n in names])


def mad_about_median(df: DataFrame, column: str) -> DataFrame:
    """Mean absolute deviation about the median, in two passes."""
    middle = quantiles(df, column, (0.5,))[0.5]
    return df.select(number(df, column).alias("x")).agg(F.avg(F.abs(F.col("x") - F.lit(middle).cast("double"))).alias("mad"))


def weighted_mean(df: DataFrame, column: str, weight: str) -> DataFrame:
    x, w = number(df, column), number(df, weight)
    both = x.isNotNull() & w.isNotNull()
    return df.agg((F.sum(F.when(both, x * w)) / F.sum(F.when(both, w))).alias("weighted_mean"))


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values; none where every value is as frequent as any other."""
    counts = df.filter(~missing(df, column)).groupBy(F.col(column).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(ends)).filter("n = hi and (hi > lo or k = 1)").select("mode", "n")


def counter(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def table_mean(df: DataFrame) -> DataFrame:
    """Sum of all cells over rows times columns; a column without numbers makes it NaN."""
    sums = [F.coalesce(F.sum(number(df, c)), F.lit(float("nan"))) for c in df.columns]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return df.agg((total / (F.count(F.lit(1)) * len(df.columns))).alias("mean"))


def percentile_label(p: float) -> str:
    return f"{p * 100:g}%"


def _describe(df: DataFrame, c: str, percentiles: list[float]) -> dict[str, Column]:
    absent, x = missing(df, c), number(df, c)
    out = {"count": F.count(F.when(~absent, 1)).cast("double"), "missing": F.count(F.when(absent, 1)).cast("double")}
    x = F.when(~absent, x)
    if is_numeric(df, c):
        out |= {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x)} | {percentile_label(p): F.percentile(x, F.lit(p)) for p in percentiles} | {"max": F.max(x)}
    return out


def describe(df: DataFrame, percentiles: Iterable[float] = (0.25, 0.5, 0.75), include_all: bool = False, order_by: str | None = None) -> DataFrame:
    """Rows of statistics by name in the column ``stat``; all columns as text where ``include_all`` asks for text columns too."""
    ps = sorted(set(percentiles))
    columns = [c for c in df.columns if c != RID and (include_all or is_numeric(df, c))]
    stats = ["count", "missing", *(["unique", "top", "freq"] if include_all else []), "mean", "std", "min", *map(percentile_label, ps), "max"]
    values = {c: _describe(df, c, []) for c in columns}
    # Whole columns: by ranks over partitioned counts, not in one state.
    for c, found in quantiles_of(df, [c for c in columns if is_numeric(df, c)], ps).items():
        values[c] |= {percentile_label(p): F.max(F.lit(v).cast("double")) for p, v in found.items()}
    if include_all:
        df, order = (df, F.col(order_by)) if order_by else (df.withColumn("__at", F.monotonically_increasing_id()), F.col("__at"))
        for c in columns:
            if not is_numeric(df, c):
                values[c] |= {"unique": F.count_distinct(c).cast("double")}
    row = df.agg(*[v.alias(f"{c}\0{s}") for c in columns for s, v in values[c].items()])
    if include_all:
        for c in columns:
            if not is_numeric(df, c):
                top = df.filter(~missing(df, c)).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at")).agg(F.max_by(F.struct("v", "n"), F.struct("n", -F.col("at"))).alias("t"))
                row = row.crossJoin(F.broadcast(top.select(F.col("t.v").alias(f"{c}\0top"), F.col("t.n").cast("double").alias(f"{c}\0freq"))))
                values[c] |= {"top": None, "freq": None}
    kind = "string" if include_all else "double"
    cell = lambda c, s: F.col(f"`{c}\0{s}`").cast(kind).alias(c) if s in values[c] else F.lit(None).cast(kind).alias(c)
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("stat"), *[cell(c, s) for c in columns]) for i, s in enumerate(stats)])).alias("r")).orderBy("r.at").select("r.stat", *[F.col(f"r.`{c}`").alias(c) for c in columns])


def group_describe(df: DataFrame, keys: list[str], percentiles: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    ps = sorted(set(percentiles))
    columns = [c for c in df.columns if c not in keys and c != RID and is_numeric(df, c)]
    return df.groupBy(*keys).agg(*[v.alias(f"{c}_{s}") for c in columns for s, v in _describe(df, c, ps).items()])
