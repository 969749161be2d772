"""A session with a command language: named tables, one command a line, each one operator.

``Session.run`` takes a line or a script and returns what the last command gives.
``as NAME`` stores a result; without it a command that changes a table changes it
in place. Environments keep the history and, by name, the folders of saved tables.
"""

from __future__ import annotations

import json
import os
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import config
from millrace.functions import multivariate, regression
from millrace.functions import statistics as S
from millrace.operators import window
from millrace.operators.aggregate import Agg
from millrace.operators.encode import Scaler
from millrace.operators.ordering import RID
from millrace.operators.window import Expanding, Rolling
from millrace.plans import plots
from millrace.sources import parquet, sql, text, workbook
from millrace.table import Series, Table

VERSION = "0.1"
COMMANDS: dict[str, tuple[Callable, str]] = {}


class CommandError(ValueError):
    """A command that can't be read or run."""


def command(*names: str, usage: str = ""):
    def add(f):
        for n in names:
            COMMANDS[n] = (f, f"{n}: {usage}" if usage else n)
        return f

    return add


def literal(word: str):
    """A word as a number, a truth value, nothing, or text."""
    if word.lower() in ("nil", "null"):
        return None
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            continue
    return word


def index(word: str) -> int | str:
    return int(word) if word.lstrip("-").isdigit() else word


@dataclass
class Args:
    """Words of a command: positions, and options that follow a keyword."""

    words: list[str]
    target: str | None = None
    line: str = ""

    @classmethod
    def of(cls, words: list[str], line: str = "") -> "Args":
        if len(words) >= 2 and words[-2] == "as":
            return cls(words[:-2], words[-1], line)
        return cls(words, None, line)

    def formula(self, skip: int) -> str:
        """The line's text after the command and so many words, quotes and all; double quotes around the whole are taken off."""
        rest = self.line.split(None, skip + 1)[-1]
        if self.target is not None:
            rest = rest[: rest.rindex(" as ")]
        rest = rest.strip()
        return rest[1:-1] if len(rest) > 1 and rest[0] == rest[-1] == '"' else rest

    def take(self, i: int, what: str = "an argument") -> str:
        if i >= len(self.words):
            raise CommandError(f"{what} is missing")
        return self.words[i]

    def option(self, name: str, default=None):
        """The word after a keyword; the two are taken out."""
        if name in self.words[1:]:
            i = self.words.index(name, 1)
            value = self.take(i + 1, f"a value for {name}")
            del self.words[i : i + 2]
            return value
        return default

    def flag(self, name: str, default: bool = False) -> bool:
        v = self.option(name)
        return default if v is None else v.lower() in ("true", "yes", "1")


@dataclass
class Session:
    """Variables, history and environments over a Spark session."""

    spark: SparkSession
    home: str = "environments"
    env: str = "default"
    variables: dict = field(default_factory=dict)
    history: list[str] = field(default_factory=list)
    databases: dict[str, str] = field(default_factory=dict)
    done: bool = False

    def run(self, script: str):
        """Run every line; ``#`` begins a comment."""
        out = None
        for line in script.splitlines():
            line = line.strip()
            if line and not line.startswith("#") and not self.done:
                out = self.one(line)
        return out

    def one(self, line: str):
        words = shlex.split(line)
        self.history.append(line)
        name = words[0].lower()
        if name not in COMMANDS:
            raise CommandError(f"no command {name!r}")
        return COMMANDS[name][0](self, Args.of(words[1:], line))

    # Variables.

    def get(self, name: str):
        if name not in self.variables:
            raise CommandError(f"no variable {name!r}")
        return self.variables[name]

    def table(self, name: str) -> Table:
        v = self.get(name)
        return v.table.select(v.name) if isinstance(v, Series) else v if isinstance(v, Table) else self._not(name, "a table")

    def series(self, name: str) -> Series:
        v = self.get(name)
        return v if isinstance(v, Series) else v.col(0) if isinstance(v, Table) and v.n_cols == 1 else self._not(name, "a list")

    def _not(self, name, what):
        raise CommandError(f"{name!r} is not {what}")

    def put(self, a: Args, value, source: str | None = None):
        """Store under the target, else over the source."""
        if isinstance(value, DataFrame):
            value = Table(value)
        if name := a.target or source:
            self.variables[name] = value
        return value

    def grid(self, name: str) -> tuple[DataFrame, list[str]]:
        t = self.table(name)
        return t.ordered(), t.columns


# Building, reading, writing.


@command("newdl", usage="make a list of the values given")
def _newdl(s, a):
    return s.put(a, Series.of(s.spark, [literal(w) for w in a.words]))


@command("newdt", usage="make a table with a column from each list named")
def _newdt(s, a):
    return s.put(a, Table.of(s.spark, {w: s.series(w).values() for w in a.words}))


@command("load", "read", usage="read a CSV, JSON, Parquet or Excel file, told by its ending; options: headers, rownames (truth values), encoding, sheet")
def _load(s, a):
    header, names, encoding, sheet = a.flag("headers", True), a.flag("rownames"), a.option("encoding"), a.option("sheet")
    path = a.take(0, "a file")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        df = text.read_json(s.spark, path)
    elif kind == "parquet":
        df = parquet.read(s.spark, path)
    elif kind == "xlsx":
        df = workbook.read_sheet(s.spark, path, sheet or workbook.sheet_names(workbook._bytes(s.spark, path))[0], header, names)
    else:
        df = text.read_csv(s.spark, path, header, names, encoding)
    return s.put(a, Table(df), os.path.splitext(os.path.basename(path))[0] if not a.target else None)


@command("save", usage="write TABLE to PATH in the format of its ending; options for text: headers, rownames, bom (truth values)")
def _save(s, a):
    header, names, bom = a.flag("headers", True), a.flag("rownames"), a.flag("bom")
    t, path = s.table(a.take(0)), a.take(1, "a file")
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        t.write_json(path)
    elif kind == "parquet":
        t.write_parquet(path)
    elif kind == "xlsx":
        workbook.write_workbook({t.name or "Sheet1": t.ordered().orderBy(RID).select(*t.columns)}, path)
    else:
        t.write_csv(path, header=header, row_names=names, bom=bom, single=True)
    return path


@command("convert", usage="turn one file into another: CSV and Excel either way, or any readable format into any writable one")
def _convert(s, a):
    source, to = a.take(0), a.take(1)
    if source.endswith(".xlsx"):
        return workbook.workbook_to_csv(s.spark, source, to)
    if to.endswith(".xlsx"):
        workbook.csv_to_workbook(s.spark, [source], to)
        return to
    return _save(s, Args([_tmp(s, _load(s, Args([source], "__convert"))), to]))


def _tmp(s, value) -> str:
    s.variables["__convert"] = value
    return "__convert"


@command("db", usage="databases. connect NAME URL keeps an address (catalog: Spark's own tables); list shows them; read NAME QUERY gives a table; write NAME TABLE TARGET stores one, mode being fail, replace or append")
def _db(s, a):
    what = a.take(0)
    if what == "connect":
        s.databases[a.take(1)] = a.take(2)
        return a.take(1)
    if what == "list":
        return dict(s.databases)
    url = s.databases.get(a.take(1))
    if what == "read":
        q = " ".join(a.words[2:])
        return s.put(a, Table(sql.read(s.spark, sql.Query(statement=q, url=None if url == "catalog" else url))))
    mode = a.option("mode", "fail")
    s.table(a.take(2)).write_sql(a.take(3), if_exists=mode, url=None if url == "catalog" else url)
    return a.take(3)


@command("fetch", usage="ask a market service for SYMBOL's records of one KIND")
def _fetch(s, a):
    from millrace.sources import market

    return s.put(a, Table(market.Client(s.spark).table(a.take(1, "a ticker"), a.take(2, "a method"), *a.words[3:])))


# Looking.


@command("show", usage="print rows: the first 20, the first END, or those from START to END")
def _show(s, a):
    n = [int(w) for w in a.words[1:3]]
    first, last = (0, n[0]) if len(n) == 1 else (n[0], n[1]) if n else (0, 20)
    v = s.get(a.take(0))
    return (v.table.select(v.name) if isinstance(v, Series) else v).show(first, last) if isinstance(v, (Table, Series)) else str(v)


command("shape")(lambda s, a: s.table(a.take(0)).size())
command("cols")(lambda s, a: s.table(a.take(0)).columns)
command("rows")(lambda s, a: s.table(a.take(0)).row_names())
command("types")(lambda s, a: s.table(a.take(0)).types())
command("vars")(lambda s, a: {k: type(v).__name__ for k, v in s.variables.items()})
command("version")(lambda s, a: VERSION)
command("history")(lambda s, a: list(s.history))
command("help", usage="names of all commands, or what one does")(lambda s, a: COMMANDS[a.words[0]][1] if a.words else sorted(COMMANDS))
command("get", usage="the cell in a row (number or name) and a column (number or name)")(lambda s, a: s.table(a.take(0)).at(index(a.take(1)), index(a.take(2))))
command("count", usage="how many values LIST has, or how many equal VALUE")(lambda s, a: s.series(a.take(0)).count(literal(a.words[1]) if len(a.words) > 1 else None))
command("counter")(lambda s, a: s.series(a.take(0)).counter())
command("find", usage="numbers of the rows of TABLE with VALUE in any column")(lambda s, a: s.table(a.take(0)).find_rows(literal(a.take(1))))
command("summary")(lambda s, a: s.table(a.take(0)).describe(include_all=True).toPandas().to_string())


@command("describe", usage="statistics of columns; options: by (columns to group on), all (columns of text too), percentiles (a list of shares or per cents)")
def _describe(s, a):
    by, every, p = a.option("by"), a.flag("all"), a.option("percentiles")
    ps = [float(x) / (100 if float(x) > 1 else 1) for x in p.split(",")] if p else (0.25, 0.5, 0.75)
    t = s.table(a.take(0))
    return s.put(a, t.group_by(*by.split(",")).describe(ps) if by else t.describe(ps, every))


@command("config", usage="show all settings or one; with a value, change it")
def _config(s, a):
    if len(a.words) > 1:
        setattr(config, a.words[0], literal(a.words[1]))
    return getattr(config, a.words[0]) if a.words else dict(vars(config))


@command("env", usage="environments of saved tables and history: create, list, open, export, import, delete, info, rename, clear")
def _env(s, a):
    what, path = a.words[0] if a.words else "info", lambda n: os.path.join(s.home, n)
    if what == "list":
        return sorted(os.listdir(s.home)) if os.path.isdir(s.home) else []
    if what == "info":
        return {"name": s.env, "variables": sorted(s.variables), "history": len(s.history)}
    if what == "clear":
        s.variables.clear()
        return s.env
    name = a.take(1, "a name")
    if what in ("create", "export"):
        os.makedirs(path(name), exist_ok=True)
        tables = {k: v for k, v in s.variables.items() if isinstance(v, (Table, Series))} if what == "export" else {}
        for k, v in tables.items():
            (v.table.select(v.name) if isinstance(v, Series) else v).ordered().write.mode("overwrite").parquet(os.path.join(path(name), f"{k}.parquet"))
        with open(os.path.join(path(name), "manifest.json"), "w") as f:
            json.dump({"history": s.history, "tables": sorted(tables)}, f)
    elif what in ("open", "import"):
        with open(os.path.join(path(name), "manifest.json")) as f:
            m = json.load(f)
        s.env, s.history = name, m["history"]
        s.variables.update({k: Table(s.spark.read.parquet(os.path.join(path(name), f"{k}.parquet"))) for k in m["tables"]})
    elif what == "rename":
        os.rename(path(name), path(a.take(2)))
    elif what == "delete":
        import shutil

        shutil.rmtree(path(name))
    else:
        raise CommandError(f"env can't {what}")
    return name


@command("run", usage="run the commands in a file")
def _run(s, a):
    with open(a.take(0)) as f:
        return s.run(f.read())


@command("exit")
def _exit(s, a):
    s.done = True


@command("clear")
def _clear(s, a):
    return "\033[2J\033[H"


# Changing tables.


@command("drop", usage="forget a variable")
def _drop(s, a):
    s.get(a.take(0))
    return s.variables.pop(a.words[0])


@command("rename", usage="give a variable another name")
def _rename(s, a):
    s.variables[a.take(1)] = _drop(s, a)
    return s.variables[a.words[1]]


command("clone")(lambda s, a: s.put(a, s.table(a.take(0)).clone(), f"{a.words[0]}_copy"))
command("col", usage="one column as a list")(lambda s, a: s.put(a, s.table(a.take(0)).col(index(a.take(1)))))
command("row", usage="one row, by number or name")(lambda s, a: s.put(a, Series.of(s.spark, [str(v) if v is not None else None for v in s.table(a.take(0)).row(index(a.take(1)))]) if a.target else s.table(a.take(0)).row(index(a.take(1)))))
command("addcol", usage="a new last column from values, one for each row")(lambda s, a: s.put(a, (t := s.table(a.take(0))).with_col(t._free("col"), [literal(w) for w in a.words[1:]]), a.words[0]))
command("addrow", usage="a new last row from values, one for each column")(lambda s, a: s.put(a, (t := s.table(a.take(0))).append_rows(Table.of(s.spark, dict(zip(t.columns, [[literal(w)] for w in a.words[1:]])))), a.words[0]))
command("dropcol", usage="take columns out, by number or name")(lambda s, a: s.put(a, s.table(a.take(0)).drop_cols(*map(index, a.words[1:])), a.words[0]))
command("droprow", usage="take rows out, by number or name")(lambda s, a: s.put(a, s.table(a.take(0)).drop_rows(*map(index, a.words[1:])), a.words[0]))
command("set", usage="change one cell")(lambda s, a: s.put(a, s.table(a.take(0)).set(index(a.take(1)), index(a.take(2)), literal(a.take(3))), a.words[0]))
command("setcolnames")(lambda s, a: s.put(a, s.table(a.take(0)).set_names(a.words[1:]), a.words[0]))
command("setrownames")(lambda s, a: s.put(a, s.table(a.take(0)).set_row_names(a.words[1:]), a.words[0]))
command("swap", usage="exchange two columns (col) or two rows (row)")(lambda s, a: s.put(a, getattr(s.table(a.take(0)), f"swap_{a.take(1)}s")(index(a.take(2)), index(a.take(3))), a.words[0]))
command("transpose")(lambda s, a: s.put(a, s.table(a.take(0)).transpose(), a.words[0]))
command("ccl", usage="run formula statements on TABLE")(lambda s, a: s.put(a, s.table(a.take(0)).ccl(a.formula(1)), a.words[0]))
command("addcolccl", usage="a column NAME computed by a formula")(lambda s, a: s.put(a, s.table(a.take(0)).add_col(a.take(1), a.formula(2)), a.words[0]))
command("filter", usage="rows for which a formula is true")(lambda s, a: s.put(a, s.table(a.take(0)).filter(a.formula(1)), a.words[0]))


@command("replace", usage="put NEW wherever OLD stands; nan and nil name missing values")
def _replace(s, a):
    t, old, new = s.table(a.take(0)), a.take(1), literal(a.take(2))
    return s.put(a, t.replace_missing(new, nil=old == "nil", nan=old == "nan") if old in ("nan", "nil") else t.replace(literal(old), new), a.words[0])


@command("clean", usage="drop rows with nan, nil or strings; outliers K drops what lies K deviations off in the first column")
def _clean(s, a):
    t, what = s.table(a.take(0)), a.take(1)
    if what == "outliers":
        return s.put(a, Series(t, t.columns[0]).clear_outliers(float(a.take(2))), a.words[0])
    return s.put(a, t.drop_rows_with({"nan": "nan", "nil": "nil", "strings": "string"}[what]), a.words[0])


@command("fillna", usage="fill missing values by mean, median, mode, forward, backward or interpolate; options: limit (cells in a row), cols")
def _fillna(s, a):
    limit, cols = int(a.option("limit", 0)), a.option("cols")
    return s.put(a, s.table(a.take(0)).fill(a.take(1), cols.split(",") if cols else None, limit), a.words[0])


command("fillnan", usage="fill missing values by the column's mean")(lambda s, a: s.put(a, s.table(a.take(0)).fill("mean"), a.words[0]))


@command("merge", usage="join two tables: horizontal with on (columns), or vertical, mode being inner, outer, left or right")
def _merge(s, a):
    on = a.option("on")
    return s.put(a, s.table(a.take(0)).merge(s.table(a.take(1)), a.take(2), a.take(3), on.split(",") if on else None), a.words[0])


@command("groupby", usage="group TABLE by columns after the word by; after agg, terms COLUMN:OPERATION or COLUMN:OPERATION:NAME")
def _groupby(s, a):
    by = a.option("by")
    i = a.words.index("agg")
    aggs = [Agg(p[0] or None if p[1] != "countall" or p[0] not in ("", "*") else None, p[1], p[2] if len(p) > 2 else None) for p in (w.split(":") for w in a.words[i + 1 :])]
    return s.put(a, s.table(a.take(0)).group_by(*by.split(",")).aggregate(*aggs))


@command("pivot", usage="long to wide: index (columns that stay), columns (whose values become columns), values; options: agg, fillna, sortcols")
def _pivot(s, a):
    rows, cols, values, agg, fill, order = a.option("index"), a.option("columns"), a.option("values"), a.option("agg"), a.option("fillna"), a.flag("sortcols")
    return s.put(a, s.table(a.take(0)).pivot(rows.split(","), cols, values, agg, literal(fill) if fill else None, order))


@command("unpivot", usage="wide to long: idvars (columns that stay); options: valuevars, varname, valuename, dropna")
def _unpivot(s, a):
    ids, values, name, value, drop = a.option("idvars"), a.option("valuevars"), a.option("varname", "variable"), a.option("valuename", "value"), a.flag("dropna")
    return s.put(a, s.table(a.take(0)).unpivot(ids.split(","), values.split(",") if values else None, name, value, drop))


@command("sort", usage="order rows by a column, asc or desc")
def _sort(s, a):
    return s.put(a, s.table(a.take(0)).sort((index(a.take(1)), a.words[2:3] != ["desc"])), a.words[0])


@command("sample", usage="rows at random: a number, frac SHARE, or shuffle for all; options: replace, seed")
def _sample(s, a):
    seed, again = int(a.option("seed", 0)), a.flag("replace")
    t, what = s.table(a.take(0)), a.take(1)
    return s.put(a, t.shuffle(seed) if what == "shuffle" else t.sample_frac(float(a.take(2)), again, seed) if what == "frac" else t.sample(int(what), again, seed))


@command("split", usage="deal rows to two tables after as, the first with the share after train; options: shuffle, seed")
def _split(s, a):
    words = a.words
    names = []
    if "as" in words:
        i = words.index("as")
        names, words[i:] = words[i + 1 :], []
    seed, mixed, frac = int(a.option("seed", 0)), a.flag("shuffle", True), float(a.option("train"))
    both = s.table(a.take(0)).train_test_split(frac, seed, mixed)
    s.variables.update(zip(names, both))
    return both


@command("encode", usage="numbers for categories of COLUMN by onehot, label or ordinal (options: order, dropfirst); apply TABLE ENCODER uses a stored one")
def _encode(s, a):
    if a.words[0] == "apply":
        return s.put(a, Table(s.get(a.take(2)).transform(s.table(a.take(1)).ordered())), a.words[1])
    order, first = a.option("order"), a.flag("dropfirst")
    t, kind, c = s.table(a.take(0)), a.take(1), index(a.take(2))
    if kind == "onehot":
        out, e = t.one_hot(c, drop_first=first)
    elif kind == "label":
        out, e = t.label_encode(c, order or "first_seen")
    else:
        out, e = t.ordinal_encode(c, [literal(w) for w in order.split(",")])
    s.variables[f"{a.target or a.words[0]}_encoder"] = e
    return s.put(a, out, a.words[0])


@command("scale", usage="fit std, minmax, robust or maxabs on columns and store the scaler; apply or inverse uses a stored one")
def _scale(s, a):
    what = a.take(0)
    if what == "fit":
        kind = {"std": "standard"}.get(a.take(1), a.words[1])
        t = s.table(a.take(2))
        return s.put(a, Scaler(kind).fit(t.df, [t.resolve(index(w)) for w in a.words[3:]] or [c for c in t.columns if t.types()[c] != "string"]))
    scaler = s.get(a.take(2))
    return s.put(a, Table((scaler.transform if what == "apply" else scaler.inverse_transform)(s.table(a.take(1)).ordered())), a.words[1])


# Lists: statistics, transforms, sequences.

for _n in ("sum", "mean", "median", "stdev", "var", "min", "max", "range", "iqr"):
    command(_n, usage=f"the {_n} of LIST")(lambda s, a, n=_n: getattr(s.series(a.take(0)), n)())
command("mode")(lambda s, a: s.series(a.take(0)).mode())
command("quartile", usage="quartile 1, 2 or 3 of LIST")(lambda s, a: s.series(a.take(0)).quartile(int(a.take(1))))
command("percentile", usage="percentile of LIST, 0 to 100")(lambda s, a: s.series(a.take(0)).percentile(float(a.take(1))))
for _n in ("normalize", "standardize", "reverse", "upper", "lower", "capitalize"):
    command(_n, usage=f"LIST with {_n} done to every value")(lambda s, a, n=_n: s.put(a, getattr(s.series(a.take(0)), n)(), a.words[0]))
command("parsenums")(lambda s, a: s.put(a, s.series(a.take(0)).parse_numbers(), a.words[0]))
command("parsestrings")(lambda s, a: s.put(a, s.series(a.take(0)).parse_strings(), a.words[0]))
command("rank", usage="ranks of the values, ties shared, asc or desc")(lambda s, a: s.put(a, s.series(a.take(0)).rank(a.words[1:2] != ["desc"]), a.words[0]))


def _sequence(s, a, make):
    x = s.series(a.take(0))
    return s.put(a, x.windowed(make(x.name)), a.words[0])


command("shift", usage="values moved down by N places (up if negative); option: fill")(lambda s, a: _sequence(s, a, (lambda fill: lambda c: window.shift(c, int(a.take(1)), fill))(literal(a.option("fill", "nil")))))
command("diff", "diffn", usage="each value less the one N places before")(lambda s, a: _sequence(s, a, lambda c: window.diff(c, int(a.words[1]) if len(a.words) > 1 else 1)))
command("pctchange", usage="relative change against the value N places before")(lambda s, a: _sequence(s, a, lambda c: window.pct_change(c, int(a.words[1]) if len(a.words) > 1 else 1)))
command("movavg", usage="means over a moving window of N values")(lambda s, a: _sequence(s, a, lambda c: Rolling(int(a.take(1))).mean(c)))


def _cumulative(s, a, how):
    x = s.series(a.take(0))
    t = x.table.select(x.name).cumulative({"__c": (x.name, how)})
    return s.put(a, Series(Table(t.df.select(RID, F.col("__c").alias(x.name))), x.name), a.words[0])


for _n, _how in (("cumsum", "sum"), ("cumprod", "product"), ("cummax", "max"), ("cummin", "min")):
    command(_n, usage=f"running {_n[3:]} of LIST")(lambda s, a, h=_how: _cumulative(s, a, h))


@command("rolling", usage="a moving window of N values under a reducer; options: minobs, center")
def _rolling(s, a):
    least, center = int(a.option("minobs", 0)), a.flag("center")
    return _sequence(s, a, lambda c: getattr(Rolling(int(a.take(1)), least, center), a.take(2))(c))


@command("expanding", usage="all values so far under a reducer, from N values on")
def _expanding(s, a):
    x = s.series(a.take(0))
    if a.take(2) == "median":
        t = Table(window.apply(x.table.ordered().select(RID, x.name).withColumn("__k", F.lit(0)), {"__e": Expanding(int(a.take(1))).median(x.name)}, RID, ["__k"]))
    else:
        t = x.table.select(x.name).expanding({"__e": (x.name, a.take(2))}, int(a.take(1)))
    return s.put(a, Series(Table(t.df.select(RID, F.col("__e").alias(x.name))), x.name), a.words[0])


@command("expsmooth", usage="exponential smoothing with a weight between 0 and 1")
def _expsmooth(s, a):
    x = s.series(a.take(0))
    df = window.smoothing(x.table.ordered().select(RID, F.col(x.name).cast("double").alias(x.name)).withColumn("__k", F.lit(0)), x.name, float(a.take(1)), RID, ["__k"])
    return s.put(a, Series(Table(df.select(RID, F.col("smoothed").alias(x.name))), x.name), a.words[0])


# Statistics.


def _pair(s, a) -> tuple[DataFrame, str, str]:
    x, y = s.series(a.take(0)), s.series(a.take(1))
    return x.table.ordered().select(RID, F.col(x.name).alias("x")).join(y.table.ordered().select(RID, F.col(y.name).alias("y")), RID), "x", "y"


def _groups(s, names) -> DataFrame:
    out = None
    for i, n in enumerate(names):
        x = s.series(n)
        df = x.table.ordered().select(F.col(x.name).cast("double").alias("v"), F.lit(i).alias("g"), F.col(RID).alias("i"))
        out = df if out is None else out.unionByName(df)
    return out


command("corr", usage="correlation of two lists: pearson (if none is named), kendall or spearman")(lambda s, a: S.CORRELATIONS[a.words[2] if len(a.words) > 2 else "pearson"](*_pair(s, a)))
command("cov", usage="sample covariance of two lists")(lambda s, a: S.covariance(*_pair(s, a)))
command("corrmatrix", usage="correlations of all columns of TABLE with one another")(lambda s, a: S.correlation_matrix(*s.grid(a.take(0)), method=a.words[1] if len(a.words) > 1 else "pearson"))
command("skewness")(lambda s, a: S.skewness(*s.series(a.take(0)).sample))
command("kurtosis")(lambda s, a: S.kurtosis(*s.series(a.take(0)).sample))


@command("ttest", usage="t-tests: single X MEAN, two X Y (equal or welch), paired X Y")
def _ttest(s, a):
    kind = a.words.pop(0)
    if kind == "single":
        return S.t_test_single(s.series(a.take(0)).sample, float(a.take(1)))
    return S.t_test_paired(*_pair(s, a)) if kind == "paired" else S.t_test_two(s.series(a.take(0)).sample, s.series(a.take(1)).sample, a.words[2:3] == ["equal"])


@command("ztest", usage="z-tests with known deviations: single X MEAN SD, two X Y SD SD; the side may follow")
def _ztest(s, a):
    kind = a.words.pop(0)
    if kind == "single":
        return S.z_test_single(s.series(a.take(0)).sample, float(a.take(1)), float(a.take(2)), a.words[3] if len(a.words) > 3 else "two-sided")
    return S.z_test_two(s.series(a.take(0)).sample, s.series(a.take(1)).sample, float(a.take(2)), float(a.take(3)), a.words[4] if len(a.words) > 4 else "two-sided")


@command("anova", usage="analysis of variance: oneway LISTS, twoway LEVELS LEVELS CELLS, repeated LISTS")
def _anova(s, a):
    kind = a.words.pop(0)
    if kind == "oneway":
        return S.anova_one_way(_groups(s, a.words), "v", "g")
    if kind == "repeated":
        return S.anova_repeated(_groups(s, a.words), "v", "g", "i")
    levels = int(a.words[1])
    return S.anova_two_way(_groups(s, a.words[2:]).withColumns({"a": F.floor(F.col("g") / levels), "b": F.col("g") % levels}), "v", "a", "b")


@command("ftest", usage="variances: var X Y, levene LISTS, bartlett LISTS")
def _ftest(s, a):
    kind = a.words.pop(0)
    return S.f_test_variance(s.series(a.take(0)).sample, s.series(a.take(1)).sample) if kind == "var" else {"levene": S.levene, "bartlett": S.bartlett}[kind](_groups(s, a.words), "v", "g")


@command("chisq", usage="chi-square: gof X with expected shares, indep X Y")
def _chisq(s, a):
    kind = a.words.pop(0)
    if kind == "gof":
        return S.chi_square_fit(*s.series(a.take(0)).sample, [float(w) for w in a.words[1:]] or None, rescale=True)
    return S.chi_square_independence(*_pair(s, a))


@command("regression", usage="fit linear, poly, exp, log, logistic or poisson of Y on the lists after it; poly takes its degree last")
def _regression(s, a):
    kind = a.words.pop(0)
    degree = int(a.words.pop()) if kind == "poly" else 1
    df, names = None, []
    for i, n in enumerate(a.words):
        x = s.series(n)
        one = x.table.ordered().select(RID, F.col(x.name).cast("double").alias(f"v{i}"))
        df = one if df is None else df.join(one, RID)
        names.append(f"v{i}")
    y, xs = names[0], names[1:]
    return {"linear": lambda: regression.linear(df, y, xs), "poly": lambda: regression.polynomial(df, y, xs[0], degree), "exp": lambda: regression.exponential(df, y, xs[0]), "log": lambda: regression.logarithmic(df, y, xs[0]), "logistic": lambda: regression.logistic(df, y, xs), "poisson": lambda: regression.poisson(df, y, xs)}[kind]()


@command("pca", usage="the first N principal components of TABLE")
def _pca(s, a):
    return s.put(a, multivariate.pca(*s.grid(a.take(0)), int(a.take(1))))


@command("kmeans", usage="K clusters of rows by Lloyd's steps; options: nstart, itermax, seed")
def _kmeans(s, a):
    n, steps, seed = int(a.option("nstart", 1)), int(a.option("itermax", 10)), int(a.option("seed", 1))
    return s.put(a, multivariate.kmeans(*s.grid(a.take(0)), int(a.take(1)), n, steps, seed))


command("hclust", usage="a tree of clusters by single, complete, average or Ward linkage")(lambda s, a: s.put(a, multivariate.hierarchical(multivariate.rows_of(*s.grid(a.take(0)), RID), a.take(1))))
command("cutree", usage="labels from a tree: k for a number of clusters, h for a height")(lambda s, a: s.put(a, multivariate.cut_tree(s.get(a.take(0)), **({"k": int(a.take(2))} if a.take(1) == "k" else {"height": float(a.take(2))}))))
command("dbscan", usage="density clusters with a radius and a least number of neighbours")(lambda s, a: s.put(a, multivariate.dbscan(multivariate.rows_of(*s.grid(a.take(0)), RID), float(a.take(1)), int(a.take(2)))))
command("silhouette", usage="silhouette widths of rows under labels")(lambda s, a: s.put(a, multivariate.silhouette(multivariate.rows_of(*s.grid(a.take(0)), RID), s.get(a.take(1)) if isinstance(s.get(a.take(1)), list) else s.series(a.take(1)).values())))


def _vectors(s, name: str) -> DataFrame:
    df, cols = s.grid(name)
    return df.select(RID, F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))


def _knn(s, a, f, target):
    weighting = a.option("weighting", "uniform")
    a.option("algorithm")
    train, test = _vectors(s, a.take(0)), _vectors(s, a.take(2 if target else 1))
    if not target:
        return s.put(a, f(train, test, "v", int(a.take(2)), RID, RID))
    y = s.series(a.take(1))
    return s.put(a, f(train.join(y.table.ordered().select(RID, F.col(y.name).alias("y")), RID), test, "v", "y", int(a.take(3)), RID, RID, weighting))


command("knn_classify", usage="label rows by their K nearest in TRAIN; option: weighting, uniform or distance")(lambda s, a: _knn(s, a, multivariate.knn_classify, True))
command("knn_regress", usage="value rows by their K nearest in TRAIN; option: weighting, uniform or distance")(lambda s, a: _knn(s, a, multivariate.knn_regress, True))
command("knn_neighbors", usage="places and distances of the K nearest rows in TRAIN")(lambda s, a: _knn(s, a, multivariate.nearest_neighbors, False))


@command("plot", usage="a chart document: line, bar, scatter, histogram, box, pie or heatmap of columns; option: save")
def _plot(s, a):
    path = a.option("save")
    kind, t = a.take(0), s.table(a.take(1))
    c = [t.resolve(index(w)) for w in a.words[2:]] or t.columns
    df = t.ordered()
    spec = {"line": lambda: plots.line(df, RID if len(c) == 1 else c[0], c if len(c) == 1 else c[1:], t.name), "bar": lambda: plots.bar(df, RID if len(c) == 1 else c[0], c if len(c) == 1 else c[1:], t.name), "scatter": lambda: plots.scatter(df, c[0], c[1]), "histogram": lambda: plots.histogram(df, c[0]), "box": lambda: plots.box(df, c[0], c[1]), "pie": lambda: plots.parts(df, c[0], c[1]), "heatmap": lambda: plots.heatmap(df, c[0], c[1], c[2])}[kind]()
    if path:
        plots.save_html(spec, path)
    return spec


def complete(session: Session, line: str) -> list[str]:
    """Words that can follow what is typed so far: commands first, then variables."""
    words = line.split(" ")
    known = sorted(COMMANDS) if len(words) == 1 else sorted(session.variables)
    return [w for w in known if w.startswith(words[-1])]


def interact(session: Session, ask=input, tell=print) -> None:
    """Read commands until ``exit`` or the end of the input, and print what they give; a faulty one is told and left out."""
    try:
        import readline

        readline.parse_and_bind("tab: complete")
        readline.set_completer(lambda word, i: [*complete(session, readline.get_line_buffer()), None][i])
    except ImportError:  # a terminal without line editing
        pass
    while not session.done:
        try:
            out = session.run(ask("> "))
        except EOFError:
            return
        except Exception as e:  # noqa: BLE001  whatever a command does, the session goes on
            tell(f"{type(e).__name__}: {e}")
            continue
        if out is not None:
            tell(out.show() if isinstance(out, (Table, Series)) else out)
