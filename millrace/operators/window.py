"""Sequence functions: shift, difference, cumulative, rolling and expanding, per group or over a whole table.

Per group they are window expressions partitioned by the keys. Without keys the
whole table is one ordered sequence; ``apply`` then computes it in chunks of
consecutive rows (see ordering), never in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordering


@dataclass(frozen=True)
class Sequence:
    """A sequence function: from a WindowSpec (ordered, no frame) to a column, with the rows it reaches back and ahead (None: all before)."""

    build: Callable[[WindowSpec], Column]
    before: int | None
    after: int = 0


def number(c: str | Column) -> Column:
    """Numeric and not NaN, or null."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c), c)


def shift(c: str | Column, periods: int, fill=None) -> Sequence:
    c = F.col(c) if isinstance(c, str) else c
    return Sequence(lambda w: F.lag(c, periods, fill).over(w) if periods >= 0 else F.lead(c, -periods, fill).over(w), max(periods, 0), max(-periods, 0))


def diff(c: str | Column, periods: int = 1) -> Sequence:
    s = shift(number(c), periods)
    return Sequence(lambda w: number(c) - s.build(w), s.before, s.after)


def pct_change(c: str | Column, periods: int = 1) -> Sequence:
    s = shift(number(c), periods)
    return Sequence(lambda w: F.try_divide(number(c) - s.build(w), F.when(s.build(w) != 0, s.build(w))), s.before, s.after)


def cumulative(c: str | Column, how: str) -> Sequence:
    """Running sum, product, max or min; null at missing cells, where the value so far goes on."""
    f = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}[how]
    x = number(c)
    return Sequence(lambda w: F.when(x.isNotNull(), f(x).over(w.rowsBetween(W.unboundedPreceding, 0))), None)


@dataclass(frozen=True)
class Rolling:
    """Frames of ``window`` rows: trailing, or centred; a result needs ``min_obs`` numbers (the window, if 0)."""

    window: int
    min_obs: int = 0
    center: bool = False
    weights: tuple[float, ...] | None = None

    def __post_init__(self):
        if self.window < 1 or self.min_obs > self.window or self.min_obs < 0:
            raise ValueError("a window needs a row at least, and no more observations than rows")
        if self.weights is not None and len(self.weights) != self.window:
            raise ValueError("as many weights as rows are needed")

    @property
    def reach(self) -> tuple[int, int]:
        return ((self.window - 1) // 2, self.window // 2) if self.center else (self.window - 1, 0)

    def _gated(self, x: Column, make: Callable[[WindowSpec], Column], least: int = 1) -> Sequence:
        before, after = self.reach

        def build(w):
            frame = w.rowsBetween(-before, after)
            return F.when(F.count(x).over(frame) >= max(self.min_obs or self.window, least), make(frame))

        return Sequence(build, before, after)

    def _weighted(self, c, mean: bool) -> Sequence:
        x, (before, after) = number(c), self.reach

        def build(w):
            slots = [(F.lag(x, -k) if k < 0 else F.lead(x, k)).over(w) if k else x for k in range(-before, after + 1)]
            total = sum((F.coalesce(s * F.lit(float(v)), F.lit(0.0)) for s, v in zip(slots, self.weights)), F.lit(0.0))
            if mean:
                held = sum((F.when(s.isNotNull(), F.lit(float(v))).otherwise(0.0) for s, v in zip(slots, self.weights)), F.lit(0.0))
                total = F.try_divide(total, F.when(held != 0, held))
            n = sum((s.isNotNull().cast("int") for s in slots), F.lit(0))
            return F.when(n >= (self.min_obs or self.window), total)

        return Sequence(build, before, after)

    def sum(self, c) -> Sequence:
        return self._weighted(c, False) if self.weights else self._gated(x := number(c), lambda f: F.sum(x).over(f))

    def mean(self, c) -> Sequence:
        return self._weighted(c, True) if self.weights else self._gated(x := number(c), lambda f: F.avg(x).over(f))

    def min(self, c) -> Sequence:
        return self._gated(x := number(c), lambda f: F.min(x).over(f))

    def max(self, c) -> Sequence:
        return self._gated(x := number(c), lambda f: F.max(x).over(f))

    def median(self, c) -> Sequence:
        return self._gated(x := number(c), lambda f: F.percentile(x, F.lit(0.5)).over(f))

    def std(self, c) -> Sequence:
        return self._gated(x := number(c), lambda f: F.stddev_samp(x).over(f), 2)

    def var(self, c) -> Sequence:
        return self._gated(x := number(c), lambda f: F.var_samp(x).over(f), 2)

    def corr(self, c, other) -> Sequence:
        """Pearson over pairs that are complete; null for no spread or fewer than 2 pairs."""
        x, y = number(c), number(other)
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = lambda f: (F.var_pop(x).over(f) > 0) & (F.var_pop(y).over(f) > 0)
        return self._gated(x, lambda f: F.when(spread(f), F.try_divide(F.covar_pop(x, y).over(f), F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f))), 2)

    def apply(self, c, fn: Callable) -> Sequence:
        """A function of the list of the frame's cells, nulls included; NaN counts as an observation here. Frames go to Python in Arrow batches."""
        c = F.col(c) if isinstance(c, str) else c
        before, after = self.reach

        def over(frames):
            import pyarrow as pa

            return pa.array([None if f is None or (v := fn(f)) is None else float(v) for f in frames.to_pylist()], pa.float64())

        udf = F.arrow_udf(_annotated(over), "double")

        def build(w):
            frame = w.rowsBetween(-before, after)
            cells = F.transform(F.collect_list(F.struct(c.alias("v"))).over(frame), lambda s: s["v"])
            return F.when(F.count(c).over(frame) >= (self.min_obs or self.window), udf(cells))

        return Sequence(build, before, after)


def _annotated(f: Callable) -> Callable:
    import pyarrow as pa

    f.__annotations__ = {"frames": pa.Array, "return": pa.Array}
    return f


@dataclass(frozen=True)
class Expanding:
    """Frames from the first row on; a result needs ``min_obs`` numbers, 1 at least, and stands at missing cells too."""

    min_obs: int = 1

    def _gated(self, c, make: Callable, least: int = 1) -> Sequence:
        x = number(c)

        def build(w):
            frame = w.rowsBetween(W.unboundedPreceding, 0)
            return F.when(F.count(x).over(frame) >= max(self.min_obs, least), make(x).over(frame))

        return Sequence(build, None)

    def sum(self, c) -> Sequence:
        return self._gated(c, F.sum)

    def mean(self, c) -> Sequence:
        return self._gated(c, F.avg)

    def min(self, c) -> Sequence:
        return self._gated(c, F.min)

    def max(self, c) -> Sequence:
        return self._gated(c, F.max)

    def median(self, c) -> Sequence:
        return self._gated(c, lambda x: F.percentile(x, F.lit(0.5)))

    def std(self, c) -> Sequence:
        return self._gated(c, F.stddev_samp, 2)

    def var(self, c) -> Sequence:
        return self._gated(c, F.var_samp, 2)


def apply(df: DataFrame, columns: dict[str, Sequence], order_by, by: list[str] | None = None) -> DataFrame:
    """``df`` with the sequence functions as columns, in the order given, per group of ``by`` or over the whole table."""
    keys = ordering.order_columns(order_by)
    if by:
        w = W.partitionBy(*by).orderBy(*keys)
        return df.withColumns({k: s.build(w) for k, s in columns.items()})
    bounded = {k: s for k, s in columns.items() if s.before is not None}
    if len(bounded) < len(columns):
        raise ValueError("over a whole table use cumulative_all or expanding_all for frames from the first row")
    out = df if ordering.RID in df.columns else ordering.number_rows(df, order_by)
    out = ordering.bounded_frame(out, {k: s.build for k, s in bounded.items()}, max(s.before for s in bounded.values()), max(s.after for s in bounded.values()))
    return out if ordering.RID in df.columns else out.drop(ordering.RID)


def cumulative_all(df: DataFrame, columns: dict[str, tuple[str, str]], order_by) -> DataFrame:
    """Running sum, product, max or min over the whole table: name -> (column, how)."""
    numbered = ordering.number_rows(df, order_by)
    out = ordering.running(numbered, {k: (number(c), how) for k, (c, how) in columns.items()})
    return out.withColumns({k: F.when(number(c).isNotNull(), F.col(k)) for k, (c, _) in columns.items()}).drop(ordering.RID)


def expanding_all(df: DataFrame, columns: dict[str, tuple[str, str]], order_by, min_obs: int = 1) -> DataFrame:
    """Expanding sum, mean, min, max, var or std over the whole table: name -> (column, how), from running moments.

    Variances are those of the distances from the column's mean, so that squares of large values don't cancel.
    """
    numbered, parts = ordering.number_rows(df, order_by), {}
    spread = [k for k, (_, how) in columns.items() if how in ("var", "std")]
    middle = numbered.agg(*[F.avg(F.when(~F.isnan(number(columns[k][0])), number(columns[k][0]))).alias(f"m{i}") for i, k in enumerate(spread)]).first() if spread else ()
    for k, (c, how) in columns.items():
        x = number(c)
        if how in ("var", "std"):
            x = x - F.lit(middle[spread.index(k)] or 0.0)
        parts |= {f"__n_{k}": (x, "count"), f"__s_{k}": (x, "sum"), f"__q_{k}": (x * x, "sum")} | ({f"__m_{k}": (x, how)} if how in ("min", "max") else {})
    out = ordering.running(numbered, parts)
    for k, (_, how) in columns.items():
        n, s, q = (F.col(f"__{p}_{k}") for p in "nsq")
        v = F.try_divide(F.greatest(q - s * s / F.when(n > 0, n), F.lit(0.0)), F.when(n > 1, n - 1))
        value = {"sum": s, "mean": F.try_divide(s, F.when(n > 0, n)), "var": v, "std": F.sqrt(v)}.get(how, F.col(f"__m_{k}") if how in ("min", "max") else None)
        if value is None:
            raise ValueError(f"{how} over a whole table isn't made of running sums; use groups")
        out = out.withColumn(k, F.when(n >= max(min_obs, 2 if how in ("var", "std") else 1), value))
    return out.drop(ordering.RID, *parts)


def rank_average(df: DataFrame, column: str, ascending: bool = True, name: str = "rank") -> DataFrame:
    """Average rank of each value, ties sharing it; NaN last. Ranks come from the running counts of the distinct values."""
    c = F.col(column).cast("double")
    counts = df.groupBy(c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = ordering.running(ordering.number_rows(counts, F.col("__v").asc_nulls_first() if ascending else F.col("__v").desc_nulls_last()), {"__upto": (F.col("__n"), "sum")})
    ranks = upto.select("__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, c.eqNullSafe(F.col("__v"))).drop("__v")


def moving_average(df: DataFrame, column: str, window: int, order_by, by: list[str] | None = None, name: str = "moving_average") -> DataFrame:
    """Trailing means without the incomplete frames, n - window + 1 rows."""
    return apply(df, {name: Rolling(window).mean(column)}, order_by, by).filter(F.col(name).isNotNull())


def moving_stdev(df: DataFrame, column: str, window: int, order_by, by: list[str] | None = None, name: str = "moving_stdev") -> DataFrame:
    return apply(df, {name: Rolling(window).std(column)}, order_by, by).filter(F.col(name).isNotNull())


def weighted_moving_average(df: DataFrame, column: str, window: int, weights, order_by, by: list[str] | None = None, name: str = "weighted_moving_average") -> DataFrame:
    return apply(df, {name: Rolling(window, weights=tuple(weights)).mean(column)}, order_by, by).filter(F.col(name).isNotNull())


def smoothing(df: DataFrame, column: str, alpha: float, order_by: str, by: list[str], beta: float | None = None, name: str = "smoothed") -> DataFrame:
    """Exponential smoothing per group, or Holt's level plus trend with ``beta``: a fold over each group's ordered cells."""
    import numpy as np

    def fold(pdf):
        pdf = pdf.sort_values(order_by, kind="stable")
        x = pdf[column].to_numpy(float)
        out = np.empty(len(x))
        level, trend = x[0] if len(x) else 0.0, x[1] - x[0] if beta is not None and len(x) > 1 else 0.0
        for i, v in enumerate(x):
            if i:
                last, level = level, alpha * v + (1 - alpha) * (level + trend)
                trend = 0.0 if beta is None else beta * (level - last) + (1 - beta) * trend
            out[i] = level + (trend if beta is not None and i else 0.0)
        return pdf.assign(**{name: out})

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.groupBy(*by).applyInPandas(fold, schema)
