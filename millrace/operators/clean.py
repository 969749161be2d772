"""Filters, searches, replacement and imputation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordering
from millrace.operators.aggregate import is_float, is_numeric, missing, number, quantiles_of
from millrace.operators.ordering import RID

#: Fixed value: the text that spreadsheets write for a missing value.
EXCEL_NA = "#N/A"


def _any(cs: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def _all(cs: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs, F.lit(True))


def _cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (RID, "__rowname")]


def equals(df: DataFrame, c: str, value) -> Column:
    """Cell equal to a value of its own kind; other kinds never match. None matches null, NaN matches NaN."""
    kind = df.schema[c].dataType
    if value is None:
        return F.col(c).isNull()
    same = is_numeric(df, c) if isinstance(value, (int, float)) and not isinstance(value, bool) else isinstance(kind, T.BooleanType) if isinstance(value, bool) else isinstance(kind, T.StringType) if isinstance(value, str) else True
    return F.coalesce(F.col(c) == F.lit(value), F.lit(False)) if same else F.lit(False)


def class_of(df: DataFrame, c: str, kind: str) -> Column:
    """Whether a cell is of a class: string, number, nil, nan, nil_or_nan or excel_na."""
    text = isinstance(df.schema[c].dataType, T.StringType)
    return {
        "string": lambda: F.col(c).isNotNull() if text else F.lit(False), "number": lambda: F.col(c).isNotNull() if is_numeric(df, c) else F.lit(False),
        "nil": lambda: F.col(c).isNull(), "nan": lambda: F.coalesce(F.isnan(c), F.lit(False)) if is_float(df, c) else F.lit(False), "nil_or_nan": lambda: missing(df, c),
        "excel_na": lambda: F.coalesce(F.col(c) == EXCEL_NA, F.lit(False)) if text else F.lit(False),
    }[kind]()


def contains_text(df: DataFrame, c: str, part: str) -> Column:
    return F.coalesce(F.col(c).contains(part), F.lit(False)) if isinstance(df.schema[c].dataType, T.StringType) else F.lit(False)


# Rows and columns by what their cells hold.


def filter_rows(df: DataFrame, predicate: Callable[[DataFrame, str], Column]) -> DataFrame:
    """Whole rows where any cell meets the predicate."""
    return df.filter(_any(predicate(df, c) for c in _cells(df)))


def filter_cells(df: DataFrame, predicate: Callable[[DataFrame, str], Column]) -> DataFrame:
    """Rows with a cell that meets the predicate; their other cells become null."""
    kept = df.select(*[F.when(predicate(df, c), F.col(c)).alias(c) if c in _cells(df) else F.col(c) for c in df.columns], _any(predicate(df, c) for c in _cells(df)).alias("__hit"))
    return kept.filter("__hit").drop("__hit")


def drop_rows(df: DataFrame, kind: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Rows without a cell of the class, or without a cell equal to one of the values."""
    hit = _any(class_of(df, c, kind) for c in _cells(df)) if kind else _any(equals(df, c, v) for c in _cells(df) for v in values)
    return df.filter(~hit)


def drop_columns(df: DataFrame, kind: str | None = None, values: Sequence | None = None) -> DataFrame:
    """Columns without such a cell: one aggregate over all columns decides."""
    hit = {c: class_of(df, c, kind) if kind else _any(equals(df, c, v) for v in values) for c in _cells(df)}
    row = df.agg(*[F.max(h.cast("int")).alias(c) for c, h in hit.items()]).first()
    return df.drop(*[c for c in hit if row[c]])


def find_rows(df: DataFrame, values: Sequence = (), part: str | None = None, every: bool = False, rid: str = RID) -> DataFrame:
    """Numbers of rows that hold all the values, or whose cells (any, or every one) hold a text."""
    if part is not None:
        hit = (_all if every else _any)(contains_text(df, c, part) for c in _cells(df))
    else:
        hit = _all(_any(equals(df, c, v) for c in _cells(df)) for v in values)
    return df.filter(hit).select(rid)


def find_columns(df: DataFrame, values: Sequence = (), part: str | None = None, every: bool = False) -> list[str]:
    """Names of columns that hold all the values, or whose cells (any, or every one) hold a text."""
    cells = _cells(df)
    if part is not None:
        f = F.min if every else F.max
        row = df.agg(*[f(contains_text(df, c, part).cast("int")).alias(c) for c in cells]).first()
        return [c for c in cells if row[c]]
    row = df.agg(*[F.max(equals(df, c, v).cast("int")).alias(f"{c}\0{i}") for c in cells for i, v in enumerate(values)]).first()
    return [c for c in cells if all(row[f"{c}\0{i}"] for i in range(len(values)))]


def count_value(df: DataFrame, value) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.count_if(equals(df, c, value)) for c in _cells(df)], F.lit(0))
    return df.agg(total.cast("long").alias("count"))


# Replacement.


def replace(df: DataFrame, old, new, columns: Sequence[str] | None = None, rows: Column | None = None) -> DataFrame:
    """Cells equal to ``old`` become ``new``, in the given columns and rows."""
    where = rows if rows is not None else F.lit(True)
    own = columns if columns is not None else _cells(df)
    return df.withColumns({c: F.when(where & equals(df, c, old), F.lit(new).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in own if _fits(df, c, new)})


def replace_missing(df: DataFrame, new, nil: bool = True, nan: bool = True, columns: Sequence[str] | None = None, rows: Column | None = None) -> DataFrame:
    where = rows if rows is not None else F.lit(True)
    hit = lambda c: (class_of(df, c, "nil") if nil else F.lit(False)) | (class_of(df, c, "nan") if nan else F.lit(False))
    return df.withColumns({c: F.when(where & hit(c), F.lit(new).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in (columns if columns is not None else _cells(df)) if _fits(df, c, new)})


def _fits(df: DataFrame, c: str, value) -> bool:
    """Whether a column can hold the value: text columns any, number columns numbers."""
    return value is None or isinstance(df.schema[c].dataType, T.StringType) or (isinstance(value, (int, float)) and (is_numeric(df, c) or isinstance(df.schema[c].dataType, T.BooleanType)))


def replace_at_edge(df: DataFrame, c: str, old, new, last: bool = False, rid: str = RID) -> DataFrame:
    """Only the first, or last, equal cell of a column."""
    hit = equals(df, c, old)
    edge = df.agg((F.max if last else F.min)(F.when(hit, F.col(rid))).alias("at")).first()["at"]
    return df if edge is None else df.withColumn(c, F.when(F.col(rid) == edge, F.lit(new).cast(df.schema[c].dataType)).otherwise(F.col(c)))


def _limits(df: DataFrame, c: str, k: float) -> DataFrame:
    x = number(df, c)
    return df.agg((F.avg(x) - k * F.stddev_samp(x)).alias("__low"), (F.avg(x) + k * F.stddev_samp(x)).alias("__high"))


def replace_outliers(df: DataFrame, c: str, k: float, new: float) -> DataFrame:
    """Cells further than k sample deviations from the mean become ``new``; the limits are one row, sent to all tasks."""
    out = F.coalesce((F.col(c) < F.col("__low")) | (F.col(c) > F.col("__high")), F.lit(False))
    return df.crossJoin(F.broadcast(_limits(df, c, k))).withColumn(c, F.when(out, F.lit(float(new))).otherwise(F.col(c))).drop("__low", "__high")


def clear_outliers(df: DataFrame, c: str, k: float) -> DataFrame:
    out = F.coalesce((F.col(c) < F.col("__low")) | (F.col(c) > F.col("__high")), F.lit(False))
    return df.crossJoin(F.broadcast(_limits(df, c, k))).filter(~out).drop("__low", "__high")


def clear(df: DataFrame, c: str, kind: str) -> DataFrame:
    """Rows whose cell in the column is not of the class."""
    return df.filter(~class_of(df, c, kind))


# Imputation. Missing is null or NaN.


def _fill_ordered(df: DataFrame, columns: Sequence[str], order_by, by: Sequence[str] | None, limit: int, back: bool) -> DataFrame:
    keys = ordering.order_columns(order_by)
    if not by:
        # Over a whole table: the last value so far is a running value, and so is the row that held it.
        at = "__fill_rid"
        numbered = ordering.number_rows(df, order_by, at)
        if back:
            numbered = numbered.withColumn(at, -F.col(at) + F.lit(numbered.agg(F.max(at)).first()[0]))
        seen = lambda c: ~missing(df, c)
        parts = {f"__v_{c}": (F.when(seen(c), F.col(c)), "last") for c in columns} | {f"__at_{c}": (F.when(seen(c), F.col(at)), "last") for c in columns}
        out = ordering.running(numbered, parts, at)
        near = lambda c: F.lit(True) if limit <= 0 else F.col(at) - F.col(f"__at_{c}") <= limit
        return out.withColumns({c: F.when(missing(df, c) & near(c) & F.col(f"__v_{c}").isNotNull(), F.col(f"__v_{c}")).otherwise(F.col(c)) for c in columns}).select(df.columns)
    w = W.partitionBy(*by).orderBy(*keys)
    numbered = df.withColumn("__at", F.row_number().over(w))
    frame = w.rowsBetween(0, W.unboundedFollowing) if back else w.rowsBetween(W.unboundedPreceding, 0)
    pick = F.first if back else F.last

    def filled(c):
        have = ~missing(df, c)
        v, at = pick(F.when(have, F.col(c)), ignorenulls=True).over(frame), pick(F.when(have, F.col("__at")), ignorenulls=True).over(frame)
        near = F.lit(True) if limit <= 0 else F.abs(F.col("__at") - at) <= limit
        return F.when(have, F.col(c)).when(near & v.isNotNull(), v).otherwise(F.col(c))

    return numbered.withColumns({c: filled(c) for c in columns}).drop("__at")


def fill_forward(df: DataFrame, columns: Sequence[str], order_by, by: Sequence[str] | None = None, limit: int = 0) -> DataFrame:
    """The last value before a gap goes on into it, up to ``limit`` cells of each gap (0: all)."""
    return _fill_ordered(df, columns, order_by, by, limit, False)


def fill_backward(df: DataFrame, columns: Sequence[str], order_by, by: Sequence[str] | None = None, limit: int = 0) -> DataFrame:
    return _fill_ordered(df, columns, order_by, by, limit, True)


def fill_with(df: DataFrame, columns: Sequence[str], how: str, order_by: str | None = None) -> DataFrame:
    """Missing cells get the column's mean, median or mode (ties to the first seen); columns without numbers stay for the first two."""
    own = [c for c in columns if how == "mode" or is_numeric(df, c)]
    if not own:
        return df
    if how == "mode":
        df, at = (df, F.col(order_by)) if order_by else (df.withColumn("__at", F.monotonically_increasing_id()), F.col("__at"))
        row = None
        for c in own:
            counts = df.filter(~missing(df, c)).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
            one = counts.agg(F.max_by("v", F.struct("n", (-F.col("at")).alias("first"))).alias(f"__fill_{c}"))
            row = one if row is None else row.crossJoin(F.broadcast(one))
    else:
        if how not in ("mean", "median"):
            raise ValueError(f"can't fill with {how}")
        known = lambda c: F.when(~missing(df, c), F.col(c).cast("double"))
        middle = quantiles_of(df, own, (0.5,)) if how == "median" else {}
        row = df.agg(*[(F.avg(known(c)) if how == "mean" else F.max(F.lit(middle[c][0.5]).cast("double"))).alias(f"__fill_{c}") for c in own])
    filled = {c: F.when(missing(df, c), F.col(f"__fill_{c}")).otherwise(F.col(c)) for c in own}
    return df.crossJoin(F.broadcast(row)).withColumns(filled).select([c for c in df.columns if c != "__at"])


def _neighbours(df: DataFrame, columns: Sequence[str], order_by, by: Sequence[str] | None) -> DataFrame:
    """``df`` with each row's place (``__at``) and, by column, the nearest known points (i, v) up to it and from it on."""
    point = lambda c, at: F.when(~missing(df, c), F.struct(F.col(at).alias("i"), F.col(c).cast("double").alias("v")))
    if by:
        w = W.partitionBy(*by).orderBy(*ordering.order_columns(order_by))
        back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
        d = df.withColumn("__at", F.row_number().over(w).cast("long"))
        return d.withColumns({f"__l_{c}": F.last(point(c, "__at"), ignorenulls=True).over(back) for c in columns} | {f"__r_{c}": F.first(point(c, "__at"), ignorenulls=True).over(ahead) for c in columns})
    d = ordering.number_rows(df, order_by, "__at")
    d = ordering.running(d, {f"__l_{c}": (point(c, "__at"), "last") for c in columns}, "__at")
    d = d.withColumn("__back", -F.col("__at") + F.lit(d.agg(F.max("__at")).first()[0]))
    return ordering.running(d, {f"__r_{c}": (point(c, "__at"), "last") for c in columns}, "__back").drop("__back")


def fill_interpolated(df: DataFrame, columns: Sequence[str], order_by, by: Sequence[str] | None = None, extrapolate: bool = False) -> DataFrame:
    """Linear between the known cells of a group, or of the table, by position; the edges only with ``extrapolate``, along the outermost two."""
    d = _neighbours(df, columns, order_by, by)
    along = lambda p, q: p["v"] + (q["v"] - p["v"]) * (F.col("__at") - p["i"]) / (q["i"] - p["i"])
    for c in columns:
        own, left, right = F.when(~missing(df, c), F.col(c).cast("double")), F.col(f"__l_{c}"), F.col(f"__r_{c}")
        value = F.coalesce(own, F.when(left.isNotNull() & right.isNotNull(), along(left, right)))
        if extrapolate:
            # The outermost two points of each group: the first known one, and the first known one after it.
            keys = list(by or [])
            known = d.filter(~missing(df, c)).select(*keys, F.struct(F.col("__at").alias("i"), F.col(c).cast("double").alias("v")).alias("p"))
            ends = known.groupBy(*[F.col(k).alias(f"__j_{k}") for k in keys]).agg(F.min("p").alias("a"), F.max("p").alias("z"))
            met = known.join(ends, [known[k].eqNullSafe(ends[f"__j_{k}"]) for k in keys]) if keys else known.crossJoin(F.broadcast(ends))
            inner = met.groupBy(*keys).agg(F.first("a").alias("a"), F.first("z").alias("z"), F.min(F.when(F.col("p.i") > F.col("a.i"), F.col("p"))).alias("b"), F.max(F.when(F.col("p.i") < F.col("z.i"), F.col("p"))).alias("y"))
            inner = inner.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct("a", "b", "y", "z").alias(f"__e_{c}"))
            d = d.join(inner if keys else F.broadcast(inner), [d[k].eqNullSafe(inner[f"__k_{k}"]) for k in keys] or F.lit(True), "left").drop(*[f"__k_{k}" for k in keys])
            e = F.col(f"__e_{c}")
            value = F.coalesce(value, F.when(e["b"].isNull(), e["a"]["v"]).when(left.isNull(), along(e["a"], e["b"])).otherwise(along(e["y"], e["z"])))
        d = d.withColumn(f"__f_{c}", value)
    return d.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


# Interpolation of a series at a point, over its positions 0, 1, 2 ...


def interpolate_at(values: Sequence[float], x: float, how: str, derivatives: Sequence[float] | None = None) -> float:
    """The polynomial of the series at x: linear, quadratic, lagrange, newton, nearest or hermite."""
    n = len(values)
    if n == 0 or (how in ("linear", "quadratic") and not 0 <= x <= n - 1):
        return float("nan")
    y = [float(v) for v in values]
    if how == "nearest":
        return y[min(max(int(x + 0.5), 0), n - 1)]
    if how == "linear":
        i = min(int(x), n - 2) if n > 1 else 0
        return y[i] + (y[i + 1] - y[i]) * (x - i) if n > 1 else y[0]
    if how == "quadratic":
        if n < 3:
            return float("nan")
        i = min(max(int(x) - (x - int(x) < 0.5), 0), n - 3)
        points = range(i, i + 3)
    else:
        points = range(n)
    if how == "hermite":
        if derivatives is None or len(derivatives) != n:
            return float("nan")
        z = [i for i in range(n) for _ in (0, 1)]
        table = [y[i] for i in z]
        coefficients = [table[0]]
        for k in range(1, 2 * n):
            table = [derivatives[z[j]] if z[j + k] == z[j] else (table[j + 1] - table[j]) / (z[j + k] - z[j]) for j in range(2 * n - k)]
            coefficients.append(table[0])
        total, product = 0.0, 1.0
        for c, i in zip(coefficients, z):
            total += c * product
            product *= x - i
        return total
    total = 0.0
    for i in points:
        basis = 1.0
        for j in points:
            if i != j:
                basis *= (x - j) / (i - j)
        total += y[i] * basis
    return total
