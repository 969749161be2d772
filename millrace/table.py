"""``Table`` and ``Series``: the chained API over DataFrames.

A table is a DataFrame whose rows have an order: the hidden column ``__rid``,
numbered when it is first needed, by ``order_by`` or as read. Row names live in
the hidden column ``__rowname``. Columns are addressed by name, letter or
position. Methods return new tables; what needs no order never numbers rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import replace as _replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import report
from millrace.functions import formula
from millrace.operators import aggregate, clean, encode, ordering, relational, window
from millrace.operators.aggregate import Agg
from millrace.operators.ordering import RID
from millrace.sources import parquet, sql, text

NAME = "__rowname"


class Table:
    """A DataFrame with row order, optional row names, and a name."""

    def __init__(self, df: DataFrame, order_by=None, name: str = ""):
        self.df, self.order_by, self.name = df, order_by, name
        self.created = self.modified = time.time()

    # Building.

    @classmethod
    def of(cls, spark: SparkSession, columns: dict[str, Sequence], row_names: Sequence[str] | None = None, name: str = "") -> "Table":
        """From columns; short ones are padded with nulls."""
        n = max((len(v) for v in columns.values()), default=0)
        body = {k: [*v, *[None] * (n - len(v))] for k, v in columns.items()}

        def kind(values):
            seen = {type(v) for v in values if v is not None}
            return "boolean" if seen == {bool} else "bigint" if seen == {int} else "double" if seen and seen <= {int, float} else "timestamp" if seen and {t.__name__ for t in seen} == {"datetime"} else "string"

        kinds = {k: kind(v) for k, v in body.items()}
        cast = lambda v, k: None if v is None else float(v) if k == "double" else v if k in ("boolean", "bigint", "timestamp") or isinstance(v, str) else str(v)
        rows = [(i, *[cast(body[k][i], kinds[k]) for k in body], *([row_names[i] if i < len(row_names) else None] if row_names else [])) for i in range(n)]
        schema = ", ".join([f"{RID} bigint", *[f"`{k}` {t}" for k, t in kinds.items()], *([f"{NAME} string"] if row_names else [])])
        t = cls(spark.createDataFrame(rows, schema), name=name)
        return t._with(relational.unique_names(t.df)) if row_names else t

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | None = None) -> "Table":
        """From rows; the first sets the width, short ones are padded."""
        width = len(rows[0]) if rows else 0
        names = list(names or [formula.number_to_letter(i) for i in range(width)])
        return cls.of(spark, {n: [r[i] if i < len(r) else None for r in rows] for i, n in enumerate(names)})

    @classmethod
    def read_csv(cls, spark, path, header=True, row_names=False, encoding=None) -> "Table":
        return cls(text.read_csv(spark, path, header, row_names, encoding))

    @classmethod
    def read_json(cls, spark, data) -> "Table":
        return cls(text.read_json_data(spark, data) if not (isinstance(data, str) and not data.lstrip().startswith(("[", "{"))) else text.read_json(spark, data))

    @classmethod
    def read_parquet(cls, spark, path, columns=None, row_groups=None) -> "Table":
        return cls(parquet.read(spark, path, columns, row_groups))

    @classmethod
    def read_sql(cls, spark, query: sql.Query, **how) -> "Table":
        return cls(sql.read(spark, query, **how))

    def _with(self, df: DataFrame, order_by=None) -> "Table":
        t = Table(df, order_by if order_by is not None else self.order_by, self.name)
        t.created = self.created
        return t

    def ordered(self) -> DataFrame:
        """The DataFrame with ``__rid``, numbered once."""
        if RID not in self.df.columns:
            self.df = ordering.number_rows(self.df, self.order_by)
        return self.df

    # Addresses.

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (RID, NAME)]

    def resolve(self, key: str | int, letters_first: bool = False) -> str:
        """The name of a column given by name, letter or position (negative from the end)."""
        names = self.columns
        if isinstance(key, int):
            if not -len(names) <= key < len(names):
                raise ValueError(f"no column {key}")
            return names[key]
        by_letter = names[i] if key.isalpha() and (i := formula.letter_to_number(key)) < len(names) else None
        found = (by_letter or (key if key in names else None)) if letters_first else (key if key in names else by_letter)
        if found is None:
            raise ValueError(f"no column {key!r}")
        return found

    def letter_of(self, name: str) -> str:
        return formula.number_to_letter(self.columns.index(name))

    def number_of(self, name: str) -> int:
        return self.columns.index(name) if name in self.columns else -1

    def row_condition(self, row: int | str) -> Column:
        if isinstance(row, str):
            return F.col(NAME) == row
        return F.col(RID) == (row if row >= 0 else self.n_rows + row)

    @property
    def n_rows(self) -> int:
        return self.df.count()

    @property
    def n_cols(self) -> int:
        return len(self.columns)

    def size(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    # Projection and single cells.

    def col(self, key: str | int) -> "Series":
        return Series(self, self.resolve(key))

    def row(self, key: int | str) -> list | None:
        r = self.ordered().filter(self.row_condition(key)).select(*self.columns).first()
        return None if r is None else list(r)

    def at(self, row: int | str, col: str | int):
        r = self.ordered().filter(self.row_condition(row)).select(self.resolve(col)).first()
        return None if r is None else r[0]

    def set(self, row: int | str, col: str | int, value) -> "Table":
        c = self.resolve(col)
        df = self.ordered()
        return self._with(df.withColumn(c, F.when(self.row_condition(row), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c))))

    def set_row(self, row: int | str, values: Sequence) -> "Table":
        df = self.ordered()
        return self._with(df.withColumns({c: F.when(self.row_condition(row), F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in zip(self.columns, values)}))

    def select(self, *keys: str | int) -> "Table":
        hidden = [c for c in (RID, NAME) if c in self.df.columns]
        return self._with(self.df.select(*hidden, *[self.resolve(k) for k in keys]))

    def drop_cols(self, *keys: str | int) -> "Table":
        return self._with(self.df.drop(*[self.resolve(k) for k in keys]))

    def cols_between(self, first: str | int | None = None, last: str | int | None = None) -> "Table":
        """Columns from one to another, both included: the filters by column letter."""
        names = self.columns
        a = names.index(self.resolve(first)) if first is not None else 0
        b = names.index(self.resolve(last)) if last is not None else len(names) - 1
        return self.select(*names[a : b + 1])

    def cols_containing(self, part: str) -> "Table":
        return self.select(*[c for c in self.columns if part in c])

    def rename(self, old: str | int, new: str) -> "Table":
        return self._with(self.df.withColumnRenamed(self.resolve(old), self._free(new)))

    def _free(self, name: str) -> str:
        taken, out, k = set(self.columns), name, 1
        while out in taken:
            out, k = f"{name}_{k}", k + 1
        return out

    def set_names(self, names: Sequence[str]) -> "Table":
        """New names in order; surplus names add empty columns."""
        t = self
        for old, new in zip(self.columns, names):
            t = t._with(t.df.withColumnRenamed(old, new))
        for extra in list(names)[self.n_cols :]:
            t = t._with(t.df.withColumn(extra, F.lit(None).cast("string")))
        return t

    def swap_cols(self, a: str | int, b: str | int) -> "Table":
        x, y = self.resolve(a), self.resolve(b)
        return self.select(*[y if c == x else x if c == y else c for c in self.columns])

    def swap_rows(self, a: int | str, b: int | str) -> "Table":
        df = self.ordered()
        at = [r[0] for k in (a, b) for r in df.filter(self.row_condition(k)).select(RID).collect()]
        if len(at) < 2:
            raise ValueError("no such rows")
        return self._with(df.withColumn(RID, F.when(F.col(RID) == at[0], F.lit(at[1])).when(F.col(RID) == at[1], F.lit(at[0])).otherwise(F.col(RID))))

    def with_col(self, name: str, values: Column | Sequence) -> "Table":
        """A column by expression, or by values in row order (joined on the row number)."""
        if isinstance(values, Column):
            return self._with(self.df.withColumn(name, values))
        df, other = self.ordered(), Table.of(self.df.sparkSession, {name: values}).df
        return self._with(df.drop(name).join(other, RID, "full"))

    def append_rows(self, other: "Table") -> "Table":
        """Rows below, columns by name; missing ones are null."""
        top = self.ordered()
        n = top.agg(F.coalesce(F.max(RID) + 1, F.lit(0))).first()[0]
        below = other.ordered().withColumn(RID, F.col(RID) + F.lit(n))
        return self._with(top.unionByName(below, allowMissingColumns=True))

    def names_to_first_row(self) -> "Table":
        """The names become a row of text, the columns are called by letters."""
        df, head = self.ordered(), self.columns
        letters = [formula.number_to_letter(i) for i in range(len(head))]
        body = df.select((F.col(RID) + 1).alias(RID), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(head, letters)])
        first = self.df.sparkSession.range(1).select(F.lit(0).cast("long").alias(RID), *[F.lit(c).alias(n) for c, n in zip(head, letters)])
        return self._with(first.unionByName(body))

    def row_to_names(self, row: int) -> "Table":
        head = [str(v) for v in self.row(row)]
        df = self.ordered().filter(~self.row_condition(row))
        return self._with(df.withColumn(RID, F.when(F.col(RID) > row, F.col(RID) - 1).otherwise(F.col(RID)))).set_names(head)

    # Row names.

    def col_to_row_names(self, key: str | int) -> "Table":
        c = self.resolve(key)
        df = self.ordered().withColumn(NAME, F.col(c).cast("string")).drop(c)
        return self._with(relational.unique_names(df))

    def row_names_to_first_col(self, name: str = "name") -> "Table":
        hidden = [RID] if RID in self.df.columns else []
        return self._with(self.df.select(*hidden, F.col(NAME).alias(name), *self.columns))

    def drop_row_names(self) -> "Table":
        return self._with(self.df.drop(NAME))

    def row_names(self) -> list[str | None]:
        return [r[0] for r in self.ordered().orderBy(RID).select(NAME).collect()] if NAME in self.df.columns else []

    def set_row_name(self, row: int, name: str | None) -> "Table":
        df = self.ordered()
        df = df if NAME in df.columns else df.withColumn(NAME, F.lit(None).cast("string"))
        return self._with(relational.unique_names(df.withColumn(NAME, F.when(self.row_condition(row), F.lit(name)).otherwise(F.col(NAME)))))

    def set_row_names(self, names: Sequence[str]) -> "Table":
        other = Table.of(self.df.sparkSession, {NAME: list(names)}).df
        return self._with(relational.unique_names(self.ordered().drop(NAME).join(other, RID, "left")))

    def row_index_of(self, name: str) -> int | None:
        r = self.ordered().filter(F.col(NAME) == name).select(RID).first()
        return None if r is None else r[0]

    # Rows.

    def filter(self, condition: str | Column) -> "Table":
        """By a formula, or a column."""
        if isinstance(condition, Column):
            return self._with(self.df.filter(condition))
        return self._with(formula.filter_rows(self.df, condition, self.order_by, NAME if NAME in self.df.columns else None))

    def filter_rows(self, predicate) -> "Table":
        return self._with(clean.filter_rows(self.df, predicate))

    def filter_cells(self, predicate) -> "Table":
        return self._with(clean.filter_cells(self.df, predicate))

    def rows_between(self, first: int | None = None, last: int | None = None) -> "Table":
        at, ok = F.col(RID), F.lit(True)
        ok = ok if first is None else ok & (at >= first)
        return self._with(self.ordered().filter(ok if last is None else ok & (at <= last)))

    def rows_named(self, name: str | None = None, part: str | None = None) -> "Table":
        return self._with(self.df.filter(F.col(NAME) == name if part is None else F.col(NAME).contains(part)))

    def drop_rows(self, *keys: int | str) -> "Table":
        df = self.ordered()
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.coalesce(self.row_condition(k), F.lit(False))
        return self._with(df.filter(~hit))

    def drop_rows_with(self, kind: str | None = None, *values) -> "Table":
        return self._with(clean.drop_rows(self.df, kind, values))

    def drop_cols_with(self, kind: str | None = None, *values) -> "Table":
        return self._with(clean.drop_columns(self.df, kind, values))

    def find_rows(self, *values, part: str | None = None, every: bool = False) -> list[int]:
        return [r[0] for r in clean.find_rows(self.ordered(), values, part, every).orderBy(RID).collect()]

    def find_cols(self, *values, part: str | None = None, every: bool = False) -> list[str]:
        return [self.letter_of(c) for c in clean.find_columns(self.df, values, part, every)]

    def count(self, value) -> int:
        return clean.count_value(self.df, value).first()[0]

    def counter(self) -> dict:
        out: dict = {}
        for c in self.columns:
            for r in aggregate.counter(self.df, c).collect():
                out[r.value] = out.get(r.value, 0) + r["count"]
        return out

    # Replacement and imputation.

    def replace(self, old, new, cols: Sequence[str | int] | None = None, row: int | None = None) -> "Table":
        names = [self.resolve(c) for c in cols] if cols else None
        return self._with(clean.replace(self.ordered() if row is not None else self.df, old, new, names, self.row_condition(row) if row is not None else None))

    def replace_missing(self, new, nil: bool = True, nan: bool = True, cols: Sequence[str | int] | None = None, row: int | None = None) -> "Table":
        names = [self.resolve(c) for c in cols] if cols else None
        return self._with(clean.replace_missing(self.ordered() if row is not None else self.df, new, nil, nan, names, self.row_condition(row) if row is not None else None))

    def fill(self, how: str, cols: Sequence[str | int] | None = None, limit: int = 0) -> "Table":
        """forward, backward, mean, median, mode or interpolate."""
        names = [self.resolve(c) for c in cols] if cols else [c for c in self.columns if how not in ("mean", "median", "interpolate") or aggregate.is_numeric(self.df, c)]
        df = self.ordered() if how in ("forward", "backward", "interpolate", "mode") else self.df
        if how == "forward":
            return self._with(clean.fill_forward(df, names, RID, limit=limit))
        if how == "backward":
            return self._with(clean.fill_backward(df, names, RID, limit=limit))
        if how == "interpolate":
            return self._with(clean.fill_interpolated(df, names, RID))
        return self._with(clean.fill_with(df, names, how, RID if how == "mode" else None))

    # Formulas, joins, reshaping, order.

    def ccl(self, script: str) -> "Table":
        """Run a script of assignments."""
        return self._with(formula.execute(self.df, script, self.order_by or (RID if RID in self.df.columns else None), NAME if NAME in self.df.columns else None))

    def add_col(self, name: str, expression: str) -> "Table":
        return self._with(formula.with_column(self.df, name, expression, self.order_by))

    edit_col = add_col

    def merge(self, other: "Table", direction: str = "horizontal", mode: str = "inner", on: str | Sequence[str] | None = None) -> "Table":
        if direction == "vertical":
            return self._with(relational.stack(self.df.drop(RID), other.df.drop(RID), mode))
        if on is None:
            return self._with(relational.merge_on_row_names(self.df.drop(RID), other.df.drop(RID), mode))
        return self._with(relational.merge(self.df.drop(RID, NAME), other.df.drop(RID, NAME), mode, on))

    def group_by(self, *keys: str | int) -> "Grouped":
        return Grouped(self, [self.resolve(k) for k in keys])

    def pivot(self, index: Sequence[str], columns: str, values: str, agg: str | None = None, fill=None, sort_columns: bool = False) -> "Table":
        return self._with(relational.pivot(self.ordered(), index, columns, values, agg, fill, sort_columns, RID))

    def unpivot(self, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value", drop_na: bool = False) -> "Table":
        """Row-major: the values of a row stand together, in column order."""
        df = self.ordered().drop(NAME)
        values = [c for c in self.columns if c not in id_vars] if value_vars is None else list(value_vars)
        long = relational.unpivot(df, [RID, *id_vars], values, var_name, value_name, drop_na)
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(var_name)) if values else F.lit(0)
        return self._with(long.withColumn("__place", place), [RID, "__place"])._renumber()

    def _renumber(self) -> "Table":
        keys = [c for c in self.order_by if c in self.df.columns]
        df = self.df.withColumn("__old", F.col(RID)).drop(RID) if RID in self.df.columns else self.df
        keys = ["__old" if k == RID else k for k in keys]
        return Table(ordering.number_rows(df, keys).drop("__old", "__place"), None, self.name)

    def transpose(self) -> "Table":
        df = self.ordered()
        return self._with(relational.transpose(df.select(RID, *([NAME] if NAME in df.columns else []), *self.columns), RID, NAME if NAME in df.columns else None))

    def sort(self, *keys: tuple[str | int, bool]) -> "Table":
        own = [(self.resolve(k, letters_first=True), up) for k, up in keys]
        df = self.ordered()
        order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in own]
        old = df.withColumn("__old", F.col(RID)).drop(RID)
        return Table(ordering.number_rows(old, [*order, F.col("__old")]).drop("__old"), None, self.name)

    def sample(self, n: int, replace: bool = False, seed: int = 0) -> "Table":
        return _named(self._with(relational.sample(self.ordered(), n, seed, replace, [RID])), "_Sampled")

    def sample_frac(self, fraction: float, replace: bool = False, seed: int = 0) -> "Table":
        return _named(self._with(relational.sample_frac(self.ordered(), fraction, seed, replace, [RID])), "_Sampled")

    def shuffle(self, seed: int = 0) -> "Table":
        df = self.ordered().withColumn("__old", F.col(RID)).drop(RID)
        return _named(Table(ordering.number_rows(df, F.xxhash64(F.lit(seed), "__old")).drop("__old"), None, self.name), "_Shuffled")

    def train_test_split(self, fraction: float, seed: int = 0, shuffle: bool = True) -> tuple["Table", "Table"]:
        df = self.ordered().withColumn("__old", F.col(RID)).drop(RID)
        a, b = relational.train_test_split(df, fraction, seed, ["__old"], not shuffle)
        make = lambda d, suffix: _named(Table(d.withColumnRenamed("__old", RID), None, self.name), suffix)
        return make(a, "_Train"), make(b, "_Test")

    # Windows.

    def windowed(self, columns: dict[str, window.Sequence]) -> "Table":
        """Sequence functions over the row order."""
        return self._with(window.apply(self.ordered(), columns, RID))

    def cumulative(self, columns: dict[str, tuple[str, str]]) -> "Table":
        df = self.ordered()
        out = window.cumulative_all(df.withColumn("__old", F.col(RID)).drop(RID), columns, "__old")
        return self._with(out.withColumnRenamed("__old", RID))

    def expanding(self, columns: dict[str, tuple[str, str]], min_obs: int = 1) -> "Table":
        df = self.ordered()
        out = window.expanding_all(df.withColumn("__old", F.col(RID)).drop(RID), columns, "__old", min_obs)
        return self._with(out.withColumnRenamed("__old", RID))

    # Encoding, scaling, description.

    def one_hot(self, column: str | int, **how) -> tuple["Table", encode.OneHotEncoder]:
        df = self.ordered()
        e = encode.OneHotEncoder(self.resolve(column), **how).fit(df, order_by=RID)
        return self._with(e.transform(df)), e

    def label_encode(self, column: str | int, order: str = "first_seen", **how) -> tuple["Table", encode.LabelEncoder]:
        df = self.ordered()
        e = encode.LabelEncoder(self.resolve(column), order, **how).fit(df, RID)
        return self._with(e.transform(df)), e

    def ordinal_encode(self, column: str | int, values: Sequence, **how) -> tuple["Table", encode.OrdinalEncoder]:
        e = encode.OrdinalEncoder(self.resolve(column), values=list(values), **how).fit(self.df)
        return self._with(e.transform(self.df)), e

    def scale(self, kind: str, *columns: str | int, low: float = 0.0, high: float = 1.0) -> tuple["Table", encode.Scaler]:
        s = encode.Scaler(kind, low, high).fit(self.df, [self.resolve(c) for c in columns])
        return self._with(s.transform(self.df)), s

    def describe(self, percentiles=(0.25, 0.5, 0.75), include_all: bool = False) -> DataFrame:
        return aggregate.describe(self.ordered() if include_all else self.df.drop(NAME), percentiles, include_all, RID if include_all else None)

    def mean(self) -> float:
        return aggregate.table_mean(self.df.select(*self.columns)).first()[0]

    def types(self) -> dict[str, str]:
        return {c: t for c, t in self.df.dtypes if c in self.columns}

    # Out.

    def map(self, f: Callable, column: str | int, returns: str) -> "Table":
        """A Python function of the cells of a column, in Arrow batches."""
        c = self.resolve(column)
        return self._with(self.df.withColumn(c, F.pandas_udf(_mapper(f), returns)(F.col(c))))

    def collect(self, limit: int = 1_000_000) -> list[list]:
        """Rows in order, at the driver; for tables of ``limit`` rows at most."""
        got = self.ordered().orderBy(RID).select(*self.columns).limit(limit + 1).collect()
        if len(got) > limit:
            raise ValueError(f"more than {limit} rows")
        return [list(r) for r in got]

    def to_map(self, names: bool = True) -> dict[str, list]:
        rows = self.collect()
        return {(c if names else formula.number_to_letter(i)): [r[i] for r in rows] for i, c in enumerate(self.columns)}

    def to_pandas(self):
        return self.ordered().orderBy(RID).select(*self.columns).toPandas()

    def write_csv(self, path: str, **how) -> None:
        text.write_csv(self.df, path, **how)

    def write_json(self, path: str, names: bool = True) -> None:
        text.write_json(self.df, path, names)

    def to_json(self) -> str:
        return text.to_json_string(self.ordered().orderBy(RID).drop(RID))

    def write_parquet(self, path: str) -> None:
        parquet.write(self.df, path)

    def write_sql(self, table: str, **how) -> None:
        sql.write(self.df, table, **how)

    def show(self, first: int = 0, last: int | None = None) -> str:
        """A text view of a range of rows."""
        rows = self.rows_between(first, (last if last is not None else first + 20) - 1).collect()
        cells = [self.columns, *[["nil" if v is None else str(v) for v in r] for r in rows]]
        wide = [max(len(str(r[i])) for r in cells) for i in range(self.n_cols)]
        return "\n".join("  ".join(str(v).ljust(w) for v, w in zip(r, wide)).rstrip() for r in cells)

    def show_types(self, first: int = 0, last: int | None = None) -> str:
        """The type of each column, and a view of a range of rows."""
        return "\n".join(f"{c}: {t}" for c, t in self.types().items()) + "\n" + self.show(first, last)

    def clone(self) -> "Table":
        return self._with(self.df)

    def close(self) -> None:
        """Give up what the cluster holds of the table."""
        self.df.unpersist()

    def guarded(self) -> "Guarded":
        """A view whose failing steps leave the table as it is and are told by ``err``."""
        return Guarded(self)


class Guarded:
    """A table in a chain that goes on after a failing step: the step is left out, its error is kept."""

    def __init__(self, table: Table, error: Exception | None = None):
        self.table, self.error = table, error

    def err(self) -> Exception | None:
        """The last error of the chain."""
        return self.error

    def clear_err(self) -> "Guarded":
        return Guarded(self.table)

    def __getattr__(self, name: str):
        step = getattr(self.table, name)
        if not callable(step):
            return step

        def run(*args, **kw):
            try:
                out = step(*args, **kw)
            except Exception as e:  # noqa: BLE001  any fault of a step is told, none ends the chain
                report("warning", "table", name, str(e))
                return Guarded(self.table, e)
            return Guarded(out, self.error) if isinstance(out, Table) else out

        return run


def _mapper(f):
    import pandas as pd

    def run(s):
        def one(v):
            try:
                return f(v)
            except Exception as e:  # noqa: BLE001  the cell stays as it is, and the fault is told
                report("warning", "table", "map", str(e))
                return v

        return s.map(one)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return run


def _named(t: Table, suffix: str) -> Table:
    t.name += suffix
    return t


class Grouped:
    """A table with group keys."""

    def __init__(self, table: Table, keys: list[str]):
        self.table, self.keys = table, keys

    def aggregate(self, *aggs: Agg, nan_on_empty: bool = False) -> Table:
        """One row per group, in the order of first appearance."""
        df = self.table.ordered()
        own = [_replace(a, source=self.table.resolve(a.source)) if a.source else a for a in aggs]
        out = aggregate.group_aggregate(df, self.keys, [*own, Agg(RID, "min", "__first")], RID, nan_on_empty)
        return Table(ordering.number_rows(out, "__first").drop("__first"), None, self.table.name)

    def aggregate_all(self, op: str) -> Table:
        skip = (*self.keys, RID, NAME)
        return self.aggregate(*[Agg(c, op) for c in self.table.columns if c not in skip])

    def count(self) -> Table:
        return self.aggregate(Agg(None, "countall", "count"))

    def describe(self, percentiles=(0.25, 0.5, 0.75)) -> DataFrame:
        return aggregate.group_describe(self.table.df.drop(RID, NAME), self.keys, percentiles)

    def windowed(self, columns: dict[str, window.Sequence]) -> Table:
        """Sequence functions per group, in row order."""
        return self.table._with(window.apply(self.table.ordered(), columns, RID, self.keys))


class Series:
    """One column of a table, with its statistics and transforms."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name

    @classmethod
    def of(cls, spark: SparkSession, values: Sequence, name: str = "A") -> "Series":
        flat: list = []

        def add(v):
            if isinstance(v, (list, tuple)):
                for x in v:
                    add(x)
            else:
                flat.append(v)

        add(list(values))
        return cls(Table.of(spark, {name: flat}), name)

    @property
    def sample(self) -> tuple[DataFrame, str]:
        return self.table.df, self.name

    def values(self) -> list:
        return [r[0] for r in self.table.select(self.name).collect()]

    def __len__(self) -> int:
        return self.table.n_rows

    def get(self, i: int):
        return self.table.at(i, self.name)

    def _new(self, t: Table) -> "Series":
        return Series(t.select(self.name), self.name)

    def append(self, *values) -> "Series":
        return self._new(self.table.select(self.name).append_rows(Table.of(self.table.df.sparkSession, {self.name: list(values)})))

    def concat(self, other: "Series") -> "Series":
        return self._new(self.table.select(self.name).append_rows(other.table.select(other.name).set_names([self.name])))

    def update(self, i: int, value) -> "Series":
        return self._new(self.table.set(i, self.name, value))

    def drop(self, i: int) -> "Series":
        return self._new(self.table.drop_rows(i))

    def insert(self, i: int, value) -> "Series":
        df = self.table.ordered().select(RID, self.name)
        one = Table.of(self.table.df.sparkSession, {self.name: [value]}).df.withColumn(RID, F.lit(i).cast("long")).select(RID, self.name)
        return self._new(Table(df.withColumn(RID, F.when(F.col(RID) >= i, F.col(RID) + 1).otherwise(F.col(RID))).unionByName(one)))

    def reverse(self) -> "Series":
        df = self.table.ordered().select(RID, self.name)
        return self._new(Table(df.withColumn(RID, F.lit(df.count() - 1) - F.col(RID))))

    def sort(self, ascending: bool = True) -> "Series":
        return self._new(self.table.select(self.name).sort((self.name, ascending)))

    def rank(self, ascending: bool = True) -> "Series":
        df = window.rank_average(self.table.ordered().select(RID, self.name), self.name, ascending, "__rank")
        return self._new(Table(df.select(RID, F.col("__rank").alias(self.name))))

    def transform(self, c: Column) -> "Series":
        return self._new(self.table._with(self.table.df.withColumn(self.name, c)))

    def upper(self) -> "Series":
        return self.transform(F.upper(self.name))

    def lower(self) -> "Series":
        return self.transform(F.lower(self.name))

    def capitalize(self) -> "Series":
        return self.transform(F.concat(F.upper(F.substring(self.name, 1, 1)), F.lower(F.expr(f"substring(`{self.name}`, 2)"))))

    def parse_numbers(self) -> "Series":
        return self.transform(F.trim(F.col(self.name).cast("string")).try_cast("double"))

    def parse_strings(self) -> "Series":
        return self.transform(F.regexp_replace(F.col(self.name).cast("string"), r"\.0$", ""))

    def _stat(self, name: str):
        return aggregate.column_stats(self.table.df, self.name, [name]).first()[name]

    def normalize(self) -> "Series":
        r = aggregate.column_stats(self.table.df, self.name, ["min", "range"]).first()
        return self.transform((F.col(self.name) - r["min"]) / (r["range"] or 1.0))

    def standardize(self) -> "Series":
        r = aggregate.column_stats(self.table.df, self.name, ["mean", "stdev"]).first()
        return self.transform((F.col(self.name) - r["mean"]) / (r["stdev"] or 1.0))

    def count(self, value=None) -> int:
        return len(self) if value is None else clean.count_value(self.table.df.select(self.name), value).first()[0]

    def counter(self) -> dict:
        return {r.value: r["count"] for r in aggregate.counter(self.table.df, self.name).collect()}

    def percentile(self, p: float) -> float | None:
        return aggregate.quantiles(self.table.df, self.name, [p / 100])[p / 100]

    def quartile(self, q: int) -> float | None:
        return aggregate.quantiles(self.table.df, self.name, [q / 4], kind=6)[q / 4]

    def mad(self) -> float:
        return aggregate.mad_about_median(self.table.df, self.name).first()[0]

    def weighted_mean(self, weights: str) -> float:
        return aggregate.weighted_mean(self.table.df, self.name, weights).first()[0]

    def mode(self) -> list:
        return sorted(r.mode for r in aggregate.modes(self.table.df, self.name).collect())

    def _numbered(self, name: str) -> DataFrame:
        return self.table.ordered().select(F.col(RID).alias("at"), F.col(self.name).alias(name))

    def is_equal_to(self, other: "Series") -> bool:
        """Whether both hold the same values in the same order: one full join on the place."""
        met = self._numbered("x").withColumn("a", F.lit(1)).join(other._numbered("y").withColumn("b", F.lit(1)), "at", "full")
        return met.filter(F.col("a").isNull() | F.col("b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).isEmpty()

    def is_the_same_as(self, other: "Series") -> bool:
        """Whether both hold the same values as often, in any order."""
        counts = [t.table.df.groupBy(F.col(t.name).alias("v")).agg(F.count(F.lit(1)).alias("n")) for t in (self, other)]
        return counts[0].exceptAll(counts[1]).isEmpty() and counts[1].exceptAll(counts[0]).isEmpty()

    def show(self, first: int = 0, last: int | None = None) -> str:
        return self.table.select(self.name).show(first, last)

    def show_types(self, first: int = 0, last: int | None = None) -> str:
        return self.table.select(self.name).show_types(first, last)

    def find(self, value) -> list[int]:
        return [r[0] for r in self.table.ordered().filter(clean.equals(self.table.df, self.name, value)).orderBy(RID).select(RID).collect()]

    def replace(self, old, new, which: str = "all") -> "Series":
        df = self.table.ordered()
        return self._new(self.table._with(clean.replace(df, old, new, [self.name]) if which == "all" else clean.replace_at_edge(df, self.name, old, new, which == "last")))

    def clear(self, kind: str) -> "Series":
        return self._new(self.table._with(clean.clear(self.table.ordered(), self.name, kind)))

    def clear_outliers(self, k: float) -> "Series":
        return self._new(self.table._with(clean.clear_outliers(self.table.ordered(), self.name, k)))

    def replace_outliers(self, k: float, new: float) -> "Series":
        return self._new(self.table._with(clean.replace_outliers(self.table.ordered(), self.name, k, new)))

    def windowed(self, s: window.Sequence) -> "Series":
        return self._new(self.table._with(window.apply(self.table.ordered().select(RID, self.name), {"__w": s}, RID).select(RID, F.col("__w").alias(self.name))))

    def interpolate_at(self, x: float, how: str, derivatives=None) -> float:
        return clean.interpolate_at(self.values(), x, how, derivatives)


for _name in ("sum", "mean", "min", "max", "range", "median", "gmean", "var", "varp", "stdev", "stdevp", "iqr"):
    setattr(Series, _name, (lambda n: lambda self: self._stat(n))(_name))
