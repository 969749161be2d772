"""Encoders and scalers: fitted parameters are small and live at the driver, transforms are expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregate import is_numeric, missing, quantiles

#: Categories that a column may have.
MAX_CATEGORIES = 100_000


def categories(df: DataFrame, column: str, order: str = "first_seen", order_by: str | None = None) -> list:
    """Distinct values: first_seen, lexicographic or by frequency (ties by value). A missing value is None."""
    df = df if order_by else df.withColumn("__at", F.monotonically_increasing_id())
    at = F.min(order_by or "__at")
    v = F.when(~missing(df, column), F.col(column))
    counts = df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"), at.alias("at"))
    keys = {"first_seen": [F.col("at"), F.col("v")], "lexicographic": [F.col("v").cast("string").asc_nulls_last()], "frequency": [F.col("n").desc(), F.col("v").cast("string").asc_nulls_last()]}[order]
    found = [r.v for r in counts.orderBy(*keys).limit(MAX_CATEGORIES + 1).select("v").collect()]
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column!r} has more than {MAX_CATEGORIES} categories")
    return found


def _index(column: str, values: Sequence, kind):
    """Number of the value, or null where it is none of them: a lookup in a literal map."""
    known = [(v, i) for i, v in enumerate(values) if v is not None]
    table = F.create_map(*[x for v, i in known for x in (F.lit(v).cast(kind), F.lit(i))]) if known else F.create_map().cast("map<string,int>")
    own = F.when(F.col(column).isNotNull(), F.try_element_at(table, F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(list(values).index(None))).otherwise(own) if None in values else own


@dataclass
class OneHotEncoder:
    """Indicator columns ``prefix_value`` for each category; unknown values: ignore (all 0), error, or new (a column of their own)."""

    column: str
    values: list = field(default_factory=list)
    prefix: str | None = None
    separator: str = "_"
    drop_first: bool = False
    unknown: str = "ignore"
    missing_as: str = "category"
    keep_original: bool = False
    kind = "onehot"

    def fit(self, df: DataFrame, order: str = "first_seen", order_by: str | None = None) -> "OneHotEncoder":
        found = categories(df, self.column, order, order_by)
        if None in found and self.missing_as == "error":
            raise ValueError(f"{self.column!r} has missing values")
        self.values = [v for v in found if v is not None or self.missing_as == "category"]
        names = self.output_columns()
        if len(set(names)) < len(names) or set(names) & set(df.columns):
            raise ValueError("an indicator's name is taken")
        return self

    def _shown(self) -> list:
        return self.values[1:] if self.drop_first else self.values

    def output_columns(self) -> list[str]:
        return [f"{self.prefix or self.column}{self.separator}{'nil' if v is None else v}" for v in self._shown()] + ([f"{self.prefix or self.column}{self.separator}unknown"] if self.unknown == "new" else [])

    def transform(self, df: DataFrame) -> DataFrame:
        c, kind = F.col(self.column), df.schema[self.column].dataType
        known = _index(self.column, self.values, kind)
        at = F.when(known.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("unknown category "), c.cast("string"))).cast("int")).otherwise(known) if self.unknown == "error" else known
        df = df.withColumn("__at", at)
        hot = {n: F.coalesce((F.col("__at") == self.values.index(v)).cast("int"), F.lit(0)) for n, v in zip(self.output_columns(), self._shown())}
        if self.unknown == "new":
            hot[self.output_columns()[-1]] = (F.col("__at").isNull() & c.isNotNull()).cast("int")
        out = []
        for name in df.columns:
            if name == "__at":
                continue
            if name != self.column or self.keep_original:
                out.append(F.col(name))
            if name == self.column:
                out += [x.alias(n) for n, x in hot.items()]
        return df.select(*out)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """The category whose indicator is 1; the dropped first one where none is."""
        value = F.lit(self.values[0]) if self.drop_first and self.values else F.lit(None)
        for n, v in zip(self.output_columns(), self._shown()):
            value = F.when(F.col(n) == 1, F.lit(v)).otherwise(value)
        return df.withColumn(self.column, value).drop(*self.output_columns())


@dataclass
class LabelEncoder:
    """Numbers from 0 for the categories, by order of first sight, text, frequency, or as given (ordinal)."""

    column: str
    order: str = "first_seen"
    values: list = field(default_factory=list)
    unknown: str = "error"
    kind = "label"

    def fit(self, df: DataFrame, order_by: str | None = None) -> "LabelEncoder":
        self.values = [v for v in categories(df, self.column, self.order, order_by) if v is not None]
        return self

    @property
    def classes(self) -> list:
        return self.values

    def transform(self, df: DataFrame) -> DataFrame:
        """A missing cell stays null; an unknown one is an error, -1 (new), or null (ignore)."""
        c, at = F.col(self.column), _index(self.column, self.values, df.schema[self.column].dataType)
        if self.unknown == "error":
            at = F.when(at.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("unknown category "), c.cast("string"))).cast("int")).otherwise(at)
        elif self.unknown == "new":
            at = F.when(c.isNotNull(), F.coalesce(at, F.lit(-1)))
        return df.withColumn(self.column, at)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, F.try_element_at(F.array(*[F.lit(v) for v in self.values]), F.when(F.col(self.column) >= 0, F.col(self.column).cast("int") + 1)))

    def inverse(self, ids: Sequence[int]) -> list:
        return [self.values[i] for i in ids]


@dataclass
class OrdinalEncoder(LabelEncoder):
    kind = "ordinal"

    def fit(self, df: DataFrame, order_by: str | None = None) -> "OrdinalEncoder":
        if not self.values:
            raise ValueError("an ordinal encoder needs its order")
        return self


@dataclass
class Scaler:
    """y = (x - center) / scale * gain + offset for each column; missing cells stay. Kinds: standard, minmax, robust, maxabs."""

    kind: str = "standard"
    low: float = 0.0
    high: float = 1.0
    params: dict[str, tuple[float, float, float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        for c in columns:
            if not is_numeric(df, c):
                raise ValueError(f"{c!r} is no column of numbers")
        x = {c: F.when(~missing(df, c), F.col(c).cast("double")) for c in columns}
        row = df.agg(*[a for c, v in x.items() for a in (F.avg(v).alias(f"{c}\0m"), F.stddev_samp(v).alias(f"{c}\0s"), F.min(v).alias(f"{c}\0lo"), F.max(v).alias(f"{c}\0hi"))]).first()
        self.params = {}
        for c in columns:
            m, s, lo, hi = (row[f"{c}\0{k}"] for k in ("m", "s", "lo", "hi"))
            if m is None:
                raise ValueError(f"{c!r} has no numbers")
            if self.kind == "standard":
                p = (m, s or 1.0, 1.0, 0.0)
            elif self.kind == "minmax":
                p = (lo, (hi - lo) or 1.0, self.high - self.low, self.low)
            elif self.kind == "maxabs":
                p = (0.0, max(abs(lo), abs(hi)) or 1.0, 1.0, 0.0)
            else:
                q = quantiles(df, c, (0.25, 0.5, 0.75), kind=6)
                p = (q[0.5], (q[0.75] - q[0.25]) or 1.0, 1.0, 0.0)
            self.params[c] = p
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if absent := set(self.params) - set(df.columns):
            raise ValueError(f"columns are missing: {sorted(absent)}")
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) * F.lit(g) + F.lit(o) for c, (a, b, g, o) in self.params.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(o)) / F.lit(g or 1.0) * F.lit(b) + F.lit(a) for c, (a, b, g, o) in self.params.items() if c in df.columns})

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)
