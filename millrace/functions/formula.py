"""The spreadsheet formula language, lowered to Spark columns.

A formula is parsed into a tree, bound to a table's columns, and lowered by
static type, so numeric columns stay plain arithmetic that Catalyst can push
down and compile. Three things are not row expressions and are planned beside
them: aggregates become one row that is sent to all tasks, sequence functions
and relative row access become windows in chunks of the row order (see
ordering), and absolute row access becomes an aggregate that picks the row.

Names: a bare run of letters is a column letter; ``['name']`` is a name; a bare
name with an underscore or digit is a name too.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordering
from millrace.operators.ordering import RID


class FormulaError(ValueError):
    """A formula that can't be read or bound."""


# Reading.

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<number>\d+\.\d+|\d+) | (?P<string>'[^']*'|"[^"]*") | (?P<column>\[\s*(?:'[^']*'|"[^"]*"|[A-Za-z]+)\s*\]) |
    (?P<name>[A-Za-z_][A-Za-z0-9_]*) | (?P<op>&&|\|\||==|!=|>=|<=|[-+*/%^&<>=(),.:@\#;])
    )""",
    re.X,
)
#: How tightly operators bind.
BINDS = {"||": 1, "&&": 2, "==": 3, "!=": 3, ">": 3, "<": 3, ">=": 3, "<=": 3, "+": 4, "-": 4, "&": 4, "*": 5, "/": 5, "%": 5, "^": 6, ".": 7, ":": 8}
COMPARES = ("==", "!=", ">", "<", ">=", "<=")
CONSTANTS = {"true": True, "false": False, "nil": None, "null": None}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FormulaError(f"can't read {text[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


@dataclass(frozen=True)
class Node:
    """A tree node: what it is, a value, and its parts."""

    kind: str
    value: object = None
    parts: tuple["Node", ...] = ()

    def walk(self):
        yield self
        for p in self.parts:
            yield from p.walk()


class Parser:
    """Operator precedence parser; every operator groups to the left."""

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, op: str) -> None:
        if self.take() != ("op", op):
            raise FormulaError(f"{op!r} is missing")

    def whole(self) -> Node:
        node = self.expression(0)
        if self.at < len(self.tokens):
            raise FormulaError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def expression(self, least: int) -> Node:
        left = self.operand()
        while (op := self.peek()) in BINDS and BINDS[op] > least:
            self.take()
            if op == ".":
                left = Node("access", None, (left, self.expression(BINDS["."])))
            elif op == ":":
                left = Node("range", None, (left, self.expression(BINDS[":"])))
            elif op in COMPARES:
                # a < b < c means a < b and b < c
                chain, ops = [left, self.expression(BINDS[op])], [op]
                while self.peek() in COMPARES:
                    ops.append(self.take()[1])
                    chain.append(self.expression(BINDS["=="]))
                left = Node("compare", tuple(ops), tuple(chain))
            else:
                left = Node("binary", op, (left, self.expression(BINDS[op])))
        return left

    def operand(self) -> Node:
        kind, text = self.take()
        if kind == "number":
            # "A.1" reads as a row of A: a column has no fraction
            return Node("number", float(text))
        if kind == "string":
            return Node("string", text[1:-1])
        if kind == "column":
            inner = text[1:-1].strip()
            return Node("name", inner[1:-1]) if inner[0] in "'\"" else Node("letter", inner.upper())
        if kind == "name":
            if self.peek() == "(":
                self.take()
                parts = []
                while self.peek() != ")":
                    parts.append(self.expression(0))
                    if self.peek() != ")":
                        self.expect(",")
                self.take()
                return Node("call", text.upper(), tuple(parts))
            if text in CONSTANTS:
                return Node("constant", CONSTANTS[text])
            return Node("letter", text.upper()) if text.isalpha() else Node("name", text)
        if text == "(":
            node = self.expression(0)
            self.expect(")")
            return node
        if text in "+-":
            return Node("unary", text, (self.expression(BINDS["*"]),))
        if text == "@":
            return Node("row")
        if text == "#":
            return Node("index")
        raise FormulaError(f"unexpected {text!r}")


def parse(text: str) -> Node:
    return Parser(text).whole()


def statements(script: str) -> list[tuple[str, bool, Node]]:
    """(target, new, expression) of each line or ``;`` part of a script."""
    out = []
    for part in re.findall(r"""(?:'[^']*'|"[^"]*"|[^;\n'"])+""", script):
        if not part.strip():
            continue
        if m := re.match(r"""\s*NEW\(\s*(?:'([^']*)'|"([^"]*)")\s*\)\s*=(?!=)(.*)$""", part, re.S | re.I):
            out.append((m[1] if m[1] is not None else m[2], True, parse(m[3])))
        elif m := re.match(r"""\s*(?:\[\s*(?:'([^']*)'|"([^"]*)"|([A-Za-z]+))\s*\]|([A-Za-z_]\w*))\s*=(?!=)(.*)$""", part, re.S):
            quoted = m[1] if m[1] is not None else m[2]
            out.append((quoted if quoted is not None else "\0" + (m[3] or m[4]), False, parse(m[5])))
        else:
            raise FormulaError(f"no assignment: {part.strip()!r}")
    return out


def letter_to_number(letter: str) -> int:
    n = 0
    for c in letter.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def number_to_letter(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


# Lowering.


@dataclass
class Value:
    """A lowered expression: a column with its kind (number, text, bool, date, duration, null), or several columns."""

    column: Column | None
    kind: str
    several: list["Value"] | None = None
    literal: object = None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    return "bool" if isinstance(t, T.BooleanType) else "date" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "null" if isinstance(t, T.NullType) else "text"


def zero() -> Column:
    return F.lit(0.0)


_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?$")


def text_number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def number(v: Value, null: float | None = 0.0) -> Column:
    """To a number: null as ``null``, true 1, trimmed text by its number (or null)."""
    if v.kind == "null":
        return F.lit(null).cast("double")
    c = {"number": lambda: v.column.cast("double"), "bool": lambda: v.column.cast("double"), "duration": lambda: v.column, "text": lambda: text_number(v.column), "date": lambda: F.lit(None).cast("double")}[v.kind]()
    return c if null is None or v.literal is not None else F.when(v.column.isNull(), F.lit(null)).otherwise(c)


def boolean(v: Value) -> Column:
    """To a truth value: numbers by zero, the usual words, anything else null."""
    if v.kind == "bool":
        return v.column
    if v.kind == "number":
        return v.column != 0
    if v.kind == "text":
        low = F.lower(F.trim(v.column))
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0", ""), False)
    return F.lit(None).cast("boolean")


def shown(v: Value) -> Column:
    """As text: whole numbers without a fraction, null as <nil>."""
    if v.kind == "null":
        return F.lit("<nil>")
    if v.kind == "number":
        x = v.column.cast("double")
        whole = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string"))
        return F.coalesce(whole, v.column.cast("double").cast("string"), F.lit("<nil>"))
    return F.coalesce(v.column.cast("string"), F.lit("<nil>"))


def text(v: Value) -> Column:
    """As text, null as empty."""
    return F.lit("") if v.kind == "null" else F.when(v.column.isNull(), F.lit("")).otherwise(shown(v))


def moment(v: Value) -> Column:
    return v.column.cast("timestamp") if v.kind == "date" else v.column.try_cast("timestamp") if v.kind == "text" else F.lit(None).cast("timestamp")


def seconds(a: Column) -> Column:
    return F.unix_micros(a).cast("double") / 1e6


def plus_seconds(at: Column, s: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(at) + F.round(s * 1e6)).cast("long"))


def num(c: Column) -> Value:
    return Value(c, "number")


def half_away(x: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def divide(a: Column, b: Column) -> Column:
    """Division as floats do it: by zero it gives an infinity or NaN."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def guarded(x: Column, ok: Column, said: str) -> Column:
    return F.when(ok, x).otherwise(F.raise_error(F.lit(said)).cast("double"))


def same(a: Value, b: Value) -> Column:
    """Equal as numbers where both are numbers, else as text, else as truth; null equals null."""
    if "null" in (a.kind, b.kind):
        v = b if a.kind == "null" else a
        return F.lit(True) if v.kind == "null" else v.column.isNull()
    if "date" in (a.kind, b.kind):
        return moment(a).eqNullSafe(moment(b))
    if a.kind == b.kind == "text":
        x, y = text_number(a.column), text_number(b.column)
        return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.column.eqNullSafe(b.column)) if a.literal is None or b.literal is None and text_is_number(a.literal) else a.column.eqNullSafe(b.column)
    x, y = number(a, None), number(b, None)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.column.isNull() & b.column.isNull())


def text_is_number(t) -> bool:
    try:
        float(t)
        return True
    except (TypeError, ValueError):
        return False


def compare(op: str, a: Value, b: Value) -> Column:
    if op in ("==", "!="):
        return same(a, b) if op == "==" else ~same(a, b)
    return F.coalesce(raw_compare(op, a, b), F.lit(False))


def raw_compare(op: str, a: Value, b: Value) -> Column:
    """An order comparison as it is, null where a side is missing."""
    x, y = (moment(a), moment(b)) if "date" in (a.kind, b.kind) or all(v.kind == "text" and isinstance(v.literal, str) and _ISO.match(v.literal) for v in (a, b)) else (number(a, None), number(b, None))
    return {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "&":
        return Value(F.concat(shown(a), shown(b)), "text")
    if op in "+-" and "date" in (a.kind, b.kind):
        if op == "-" and (a.kind, b.kind) != ("date", "number") and b.kind != "duration":
            return Value(seconds(moment(a)) - seconds(moment(b)), "duration")
        at, days = (a, b) if a.kind == "date" else (b, a)
        hours = number(days) / 3600 if days.kind == "duration" else number(days) * 24
        whole = F.when(hours < 0, F.ceil(hours)).otherwise(F.floor(hours)) * 3600
        return Value(plus_seconds(moment(at), whole if op == "+" else -whole), "date")
    x, y = number(a), number(b)
    if op in "*/":
        x, y = number(a, None), number(b, None)
    return num({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "%": lambda: guarded(x % y, y != 0, "modulo by zero"), "^": lambda: F.pow(x, y)}[op]())


# Functions. Each takes values and gives a value.


def _case(*v: Value) -> Value:
    if len(v) < 3 or len(v) % 2 == 0:
        raise FormulaError("CASE takes pairs of condition and value, and a default")
    return choose([(boolean(v[i]), v[i + 1]) for i in range(0, len(v) - 1, 2)], v[-1])


def choose(pairs: list[tuple[Column, Value]], default: Value) -> Value:
    """The first value whose condition holds; of one kind, or as text where the kinds differ."""
    values = [v for _, v in pairs] + [default]
    kinds = {v.kind for v in values} - {"null"}
    kind = kinds.pop() if len(kinds) == 1 else "text" if kinds else "null"
    cast = (lambda v: F.lit(None).cast({"number": "double", "duration": "double", "text": "string", "bool": "boolean", "date": "timestamp", "null": "string"}[kind]) if v.kind == "null" else v.column.cast("double") if kind == "number" else v.column if v.kind == kind else F.when(v.column.isNotNull(), shown(v)))
    out = cast(default)
    for c, v in reversed(pairs):
        out = F.when(F.coalesce(c, F.lit(False)), cast(v)).otherwise(out)
    return Value(out, kind)


def _is_na(v: Value) -> Column:
    return F.coalesce(F.isnan(v.column), F.lit(False)) if v.kind == "number" else F.coalesce(v.column == "#N/A", F.lit(False)) if v.kind == "text" else F.lit(False)


def _logic(values, f) -> Value:
    return Value(reduce(f, [F.coalesce(boolean(v), F.lit(False)) for v in values]), "bool")


def _log(x: Value, base: Value | None = None) -> Value:
    a = number(x)
    return num(guarded(F.log10(a) if base is None else F.ln(a) / F.ln(number(base)), a > 0, "logarithm of no positive number"))


def _mid(s: Value, start: Value, length: Value) -> Value:
    return Value(F.substring(text(s), F.greatest(number(start).cast("int"), F.lit(1)), F.greatest(number(length).cast("int"), F.lit(0))), "text")


def _date_add(d: Value, n: Value, unit: Value) -> Value:
    u, at, k = str(unit.literal or "").lower().rstrip("s"), moment(d), number(n)
    if u in ("month", "year"):
        months = F.floor(k).cast("int") * (12 if u == "year" else 1)
        first = F.add_months(F.trunc(at, "month"), months)
        # Days beyond the month's end roll over into the next.
        day = F.date_add(first, F.dayofmonth(at) - 1).cast("timestamp")
        return Value(plus_seconds(day, seconds(at) - seconds(F.date_trunc("day", at))), "date")
    size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(u)
    if size is None:
        raise FormulaError(f"unknown unit {unit.literal!r}")
    return Value(plus_seconds(at, k * size), "date")


def _date_diff(a: Value, b: Value, unit: Value | None = None) -> Value:
    u = str(unit.literal if unit else "day").lower().rstrip("s")
    size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(u)
    if size is None:
        raise FormulaError(f"unknown unit {u!r}")
    return num((seconds(moment(a)) - seconds(moment(b))) / size)


#: Parts of reference-time layouts and their patterns here.
LAYOUT = [("2006", "yyyy"), ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("PM", "a"), ("06", "yy"), ("MST", "z")]


def layout(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        for part, to in LAYOUT:
            if pattern.startswith(part, i):
                out, i = out + to, i + len(part)
                break
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return out


def _to_text(v: Value, pattern: Value | None = None) -> Value:
    if pattern is None:
        return Value(text(v), "text")
    f = str(pattern.literal)
    return Value(F.format_string(f.replace("%v", "%s"), number(v).cast("long") if re.search(r"%[-+0 ]*\d*d", f) else number(v) if re.search(r"%[-+0 ]*\d*\.?\d*[efg]", f) else shown(v)), "text")


def _duration(size: int) -> Callable[[Value], Value]:
    return lambda v: num((v.column if v.kind == "duration" else number(v)) / size)


def _text(f: Callable[..., Column], kind: str = "text") -> Callable[..., Value]:
    return lambda s, *rest: Value(f(text(s), *rest), kind)


SCALAR: dict[str, Callable[..., Value]] = {
    "IF": lambda c, a, b: choose([(boolean(c), a)], b), "CASE": _case, "AND": lambda *v: _logic(v, lambda a, b: a & b), "OR": lambda *v: _logic(v, lambda a, b: a | b),
    "NOT": lambda v: Value(~boolean(v), "bool"),
    "CONCAT": lambda *v: Value(F.concat(*[shown(x) for x in v]), "text"), "ISNA": lambda v: Value(_is_na(v), "bool"), "IFNA": lambda v, d: choose([(_is_na(v), d)], v),
    "DAY": _duration(86400), "HOUR": _duration(3600), "MINUTE": _duration(60), "SECOND": _duration(1),
    "YEAR": lambda d: num(F.year(moment(d)).cast("double")), "MONTH": lambda d: num(F.month(moment(d)).cast("double")), "DAYOFMONTH": lambda d: num(F.dayofmonth(moment(d)).cast("double")),
    "WEEKDAY": lambda d: num((F.dayofweek(moment(d)) - 1).cast("double")), "DATEDIFF": _date_diff, "DATEADD": _date_add, "FORMAT_DATE": lambda d, f: Value(F.date_format(moment(d), layout(str(f.literal))), "text"),
    "ABS": lambda x: num(F.abs(number(x))), "ROUND": lambda x, d=None: num(half_away(number(x), number(d) if d else zero())), "FLOOR": lambda x: num(F.floor(number(x)).cast("double")), "CEIL": lambda x: num(F.ceil(number(x)).cast("double")),
    "TRUNC": lambda x: num(F.when(number(x) < 0, F.ceil(number(x))).otherwise(F.floor(number(x))).cast("double")), "MOD": lambda x, y: num(guarded(number(x) % number(y), number(y) != 0, "modulo by zero")),
    "POW": lambda x, y: num(F.pow(number(x), number(y))), "SQRT": lambda x: num(guarded(F.sqrt(number(x)), number(x) >= 0, "root of a negative number")), "LN": lambda x: num(guarded(F.ln(number(x)), number(x) > 0, "logarithm of no positive number")),
    "LOG": _log, "LOG10": _log, "EXP": lambda x: num(F.exp(number(x))), "SIGN": lambda x: num(F.signum(number(x))),
    "LEN": lambda s: num(F.char_length(text(s)).cast("double")), "UPPER": _text(F.upper), "LOWER": _text(F.lower), "TRIM": _text(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), "LTRIM": _text(lambda s: F.ltrim(s, F.lit(" \t\r\n"))), "RTRIM": _text(lambda s: F.rtrim(s, F.lit(" \t\r\n"))),
    "LEFT": lambda s, n: Value(F.when(number(n) > 0, F.left(text(s), number(n).cast("int"))).otherwise(""), "text"), "RIGHT": lambda s, n: Value(F.when(number(n) > 0, F.right(text(s), number(n).cast("int"))).otherwise(""), "text"),
    "MID": _mid, "SUBSTR": _mid, "REPLACE": lambda s, a, b: Value(F.replace(text(s), text(a), text(b)), "text"), "FIND": lambda n, s: num(F.locate(n.literal, text(s)).cast("double") if isinstance(n.literal, str) else F.position(text(n), text(s)).cast("double")),
    "CONTAINS": lambda s, p: Value(F.contains(text(s), text(p)), "bool"), "STARTSWITH": lambda s, p: Value(F.startswith(text(s), text(p)), "bool"), "ENDSWITH": lambda s, p: Value(F.endswith(text(s), text(p)), "bool"),
    "REGEX_MATCH": lambda s, p: Value(F.regexp_like(text(s), text(p)), "bool"), "REPEAT": lambda s, n: Value(F.when(number(n) >= 0, F.repeat(text(s), number(n).cast("int"))).otherwise(F.raise_error(F.lit("repeat a negative number of times"))), "text"),
    "TONUM": lambda v: num(number(v, None)), "VALUE": lambda v: num(number(v, None)), "TOSTR": _to_text, "TEXT": _to_text, "TOBOOL": lambda v: Value(boolean(v), "bool"),
    "COALESCE": lambda *v: choose([(x.column.isNotNull() & ~_nan(x), x) for x in v[:-1] if x.kind != "null"], v[-1]), "IFNULL": lambda v, d: d if v.kind == "null" else choose([(v.column.isNotNull(), v)], d),
}


def _nan(v: Value) -> Column:
    return F.coalesce(F.isnan(v.column), F.lit(False)) if v.kind == "number" else F.lit(False)


#: Aggregates by (sum of counts, sums ...): each takes a list of number columns, all cells of which count.
AGGREGATE = {"SUM", "AVG", "COUNT", "MAX", "MIN", "MEDIAN", "VAR", "VARP", "STDEV", "STDEVP"}
SEQUENCE = {"LAG", "LEAD", "DIFF", "PCT_CHANGE", "CUMSUM", "CUMPROD", "CUMMAX", "CUMMIN", "ROLLING_SUM", "ROLLING_MEAN", "ROLLING_MIN", "ROLLING_MAX", "ROLLING_STD"}
USER_SCALAR: dict[str, Callable] = {}
USER_AGGREGATE: dict[str, Callable] = {}


def register_function(name: str, f: Callable[..., Value] | Callable, returns: str | None = None) -> None:
    """A scalar function of the language: from values to a value, or with ``returns`` a Python function that becomes a UDF."""
    if returns is None:
        USER_SCALAR[name.upper()] = f
        return
    udf = F.udf(f, returns)
    USER_SCALAR[name.upper()] = lambda *v: Value(udf(*[x.column for x in v]), {"double": "number", "string": "text", "boolean": "bool"}.get(returns, "text"))


def register_aggregate(name: str, f: Callable[[Column], Column]) -> None:
    """An aggregate of the language: from a number column to an aggregate expression."""
    USER_AGGREGATE[name.upper()] = f


def _aggregate(name: str, cells: list[tuple[Column, Value]]) -> Column:
    """One aggregate expression over all cells of several columns; each comes with the condition under which it counts."""
    if name == "COUNT":
        return reduce(lambda a, b: a + b, [F.count(F.when(ok, v.column)) for ok, v in cells]).cast("double")
    xs = [F.when(ok, number(v, None)) for ok, v in cells]
    if name in USER_AGGREGATE:
        return USER_AGGREGATE[name](xs[0])
    one = len(xs) == 1
    add = lambda cs: reduce(lambda a, b: a + b, cs)
    if name == "SUM":
        return add([F.coalesce(F.sum(x), zero()) for x in xs])
    if name in ("MAX", "MIN"):
        each = [(F.max if name == "MAX" else F.min)(x) for x in xs]
        return each[0] if one else (F.greatest if name == "MAX" else F.least)(*each)
    n = add([F.count(x) for x in xs])
    if name == "AVG":
        return F.coalesce(F.avg(xs[0]) if one else F.try_divide(add([F.coalesce(F.sum(x), zero()) for x in xs]), n), zero())
    if name == "MEDIAN":
        if one:
            return F.percentile(xs[0], F.lit(0.5))
        s = F.array_sort(F.filter(F.flatten(F.array(*[F.collect_list(x) for x in xs])), lambda x: x.isNotNull()))
        return F.when(F.size(s) > 0, (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    if one:
        return {"VAR": F.var_samp, "VARP": F.var_pop, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop}[name](xs[0])
    # Merged moments: what each column has about its mean, and its mean about that of all.
    mean = F.try_divide(add([F.coalesce(F.sum(x), zero()) for x in xs]), n)
    about = add([F.coalesce(F.var_pop(x) * F.count(x) + F.count(x) * (F.avg(x) - mean) * (F.avg(x) - mean), zero()) for x in xs])
    v = F.try_divide(about, F.when(n > 0, n) if name.endswith("P") else F.when(n > 1, n - 1))
    return F.sqrt(v) if name.startswith("ST") else v


class Lowering:
    """Lowers one formula over a table: ``plan`` gives the table with the helper columns, and the column."""

    def __init__(self, df: DataFrame, order_by=None, names: list[str] | None = None, row_name: str | None = None):
        self.df, self.order_by, self.row_name = df, order_by, row_name
        self.names = names or [c for c in df.columns if c not in (RID, "__rowname")]
        self.steps: list[tuple[str, str, object]] = []  # kind, name, what
        self.known: dict[tuple, Value] = {}
        self.numbered = RID in df.columns

    def column(self, name: str) -> Value:
        if name not in self.names:
            raise FormulaError(f"no column {name!r}")
        return Value(F.col(f"`{name}`"), kind_of(self.df.schema[name].dataType))

    def by_letter(self, letter: str) -> Value:
        i = letter_to_number(letter)
        return self.column(self.names[i]) if i < len(self.names) else Value(F.lit(None).cast("string"), "null")

    def position(self, node: Node) -> int:
        if node.kind == "letter":
            i = letter_to_number(node.value)
            if i >= len(self.names):
                raise FormulaError(f"no column {node.value}")
            return i
        if node.kind == "name" and node.value in self.names:
            return self.names.index(node.value)
        raise FormulaError("a column range needs columns")

    def helper(self, kind: str, what) -> str:
        for k, name, other in self.steps:
            if k == kind and other is what:
                return name
        name = f"__f{len(self.steps)}_{id(self) % 9973}"
        self.steps.append((kind, name, what))
        return name

    # Cells that an aggregate or a list takes: each with the condition on its row.

    def cells(self, node: Node) -> list[tuple[Column, Value]]:
        true = F.lit(True)
        if node.kind == "row":
            return [(true, self.column(n)) for n in self.names]
        if node.kind == "range":
            a, b = (self.position(p) for p in node.parts)
            return [(true, self.column(n)) for n in self.names[a : b + 1]]
        if node.kind == "access" and node.parts[1].kind == "range":
            rows = self.row_range(node.parts[1])
            return [(rows, v) for _, v in self.cells(node.parts[0])]
        if node.kind == "access" and node.parts[0].kind in ("range", "row"):
            at = self.row_at(node.parts[1])
            return [(at, v) for _, v in self.cells(node.parts[0])]
        return [(true, self.lower(node))]

    def rid(self) -> Column:
        self.numbered = True
        return F.col(RID)

    def row_at(self, node: Node) -> Column:
        if node.kind == "string":
            if not self.row_name:
                raise FormulaError("the table has no row names")
            return F.col(self.row_name) == node.value
        return self.rid() == number(self.lower(node)).cast("long")

    def row_range(self, node: Node) -> Column:
        ends = []
        for p in node.parts:
            if p.kind == "string":
                v = self.helper("aggregate", F.min(F.when(self.row_at(p), self.rid())))
                ends.append(F.col(v))
            else:
                ends.append(number(self.lower(p)).cast("long"))
        return self.rid().between(*ends)

    def lower(self, node: Node, depth: int = 0) -> Value:
        """The value of a node; the same node again gives the same value, and no helper twice."""
        if depth > 100:
            raise FormulaError("the formula is nested too deeply")
        if (node,) not in self.known:
            self.known[(node,)] = self._lower(node, depth)
        return self.known[(node,)]

    def _lower(self, node: Node, depth: int) -> Value:
        low = lambda n: self.lower(n, depth + 1)
        k, v = node.kind, node.value
        if k == "number":
            return Value(F.lit(v), "number", literal=v)
        if k == "string":
            return Value(F.lit(v), "text", literal=v)
        if k == "constant":
            return Value(F.lit(None).cast("string"), "null") if v is None else Value(F.lit(v), "bool", literal=v)
        if k == "letter":
            return self.by_letter(v)
        if k == "name":
            return self.column(v)
        if k == "index":
            return num(self.rid().cast("double"))
        if k == "unary":
            x = low(node.parts[0])
            return num(-number(x)) if v == "-" else num(number(x))
        if k == "binary":
            a, b = (low(p) for p in node.parts)
            if v in ("&&", "||"):
                return _logic((a, b), (lambda x, y: x & y) if v == "&&" else (lambda x, y: x | y))
            return arithmetic(v, a, b)
        if k == "compare":
            vs = [low(p) for p in node.parts]
            return Value(reduce(lambda a, b: a & b, [compare(op, a, b) for op, a, b in zip(v, vs, vs[1:])]), "bool")
        if k == "access":
            return self.access(node)
        if k in ("row", "range"):
            vs = [c for _, c in self.cells(node)]
            return Value(F.array(*[c.column.cast("string") for c in vs]), "text", several=vs)
        return self.call(node, depth)

    def predicate(self, node: Node) -> Column:
        """The formula as a filter, where null and false are the same: comparisons stay bare, so that a scan can take them."""
        if node.kind == "binary" and node.value in ("&&", "||"):
            a, b = (self.predicate(p) for p in node.parts)
            return a & b if node.value == "&&" else a | b
        if node.kind == "compare" and not set(node.value) & {"==", "!="} and not any(n.kind in ("call", "access", "index") for n in node.walk()):
            vs = [self.lower(p) for p in node.parts]
            return reduce(lambda a, b: a & b, [raw_compare(op, a, b) for op, a, b in zip(node.value, vs, vs[1:])])
        return F.coalesce(boolean(self.lower(node)), F.lit(False))

    def access(self, node: Node) -> Value:
        base, at = self.lower(node.parts[0]), node.parts[1]
        # A row at a fixed distance is a shift; any other row is picked by an aggregate.
        if at.kind == "index":
            return base
        if at.kind == "binary" and at.value in "+-" and at.parts[0].kind == "index" and at.parts[1].kind == "number":
            k = int(at.parts[1].value) * (1 if at.value == "-" else -1)
            return Value(F.col(self.shifted(base, k)), base.kind)
        if any(n.kind in ("index", "letter", "name") for n in at.walk()):
            raise FormulaError("a row is given by a constant, a row name, or # plus or minus a constant")
        return Value(F.col(self.helper("aggregate", F.max_by(base.column, F.when(self.row_at(at), F.lit(1))))), base.kind)

    def shifted(self, v: Value, k: int) -> str:
        arg = self.helper("column", v.column)
        self.rid()
        return self.helper("bounded", (lambda w: F.lag(arg, k).over(w) if k >= 0 else F.lead(arg, -k).over(w), max(k, 0), max(-k, 0)))

    def call(self, node: Node, depth: int) -> Value:
        name, parts = node.value, node.parts
        if name in AGGREGATE or name in USER_AGGREGATE:
            cells = [c for p in parts for c in self.cells(p)]
            if any(n.kind == "index" for p in parts for n in p.walk() if not any(m.kind == "access" for m in p.walk())):
                return self.row_wise(name, [v for _, v in cells])
            if not cells:
                raise FormulaError(f"{name} needs a column")
            return num(F.col(self.helper("aggregate", _aggregate(name, cells))))
        if name in SEQUENCE:
            return self.sequence(name, [self.lower(p, depth + 1) for p in parts])
        f = USER_SCALAR.get(name) or SCALAR.get(name)
        if f is None:
            raise FormulaError(f"no function {name}")
        args = [self.lower(p, depth + 1) for p in parts]
        args = [x for a in args for x in (a.several if a.several is not None else [a])]
        try:
            return f(*args)
        except TypeError as e:
            raise FormulaError(f"{name} doesn't take {len(args)} arguments") from e

    def row_wise(self, name: str, values: list[Value]) -> Value:
        """An aggregate with # in it is taken over the row's own cells."""
        xs = F.filter(F.array(*[number(v, None) for v in values]), lambda x: x.isNotNull())
        total = F.aggregate(xs, zero(), lambda a, x: a + x)
        simple = {"SUM": total, "AVG": F.coalesce(F.try_divide(total, F.size(xs)), zero()), "COUNT": F.size(xs).cast("double"), "MAX": F.array_max(xs), "MIN": F.array_min(xs)}
        if name not in simple:
            raise FormulaError(f"{name} of single rows isn't defined")
        return num(simple[name])

    def sequence(self, name: str, args: list[Value]) -> Value:
        if not args:
            raise FormulaError(f"{name} needs a column")
        x, k = args[0], int(args[1].literal) if len(args) > 1 and isinstance(args[1].literal, float) else 1
        if name in ("LAG", "LEAD"):
            return Value(F.col(self.shifted(x, k if name == "LAG" else -k)), x.kind)
        # Here a missing cell counts as zero, as everywhere in formulas.
        arg = self.helper("column", number(x))
        self.rid()
        c = F.col(arg)
        if name in ("DIFF", "PCT_CHANGE"):
            before = lambda w: F.lag(arg, k).over(w) if k >= 0 else F.lead(arg, -k).over(w)
            change = (lambda w: c - before(w)) if name == "DIFF" else (lambda w: F.try_divide(c - before(w), F.when(before(w) != 0, before(w))))
            return num(F.col(self.helper("bounded", (change, max(k, 0), max(-k, 0)))))
        if name.startswith("CUM"):
            return num(F.col(self.helper("running", (arg, {"CUMSUM": "sum", "CUMPROD": "product", "CUMMAX": "max", "CUMMIN": "min"}[name]))))
        if len(args) < 2 or k < 1:
            raise FormulaError(f"{name} needs a window of a row at least")
        f = {"ROLLING_SUM": F.sum, "ROLLING_MEAN": F.avg, "ROLLING_MIN": F.min, "ROLLING_MAX": F.max, "ROLLING_STD": F.stddev_samp}[name]

        def rolling(w, frame=(1 - k, 0)):
            over = w.rowsBetween(*frame)
            return F.when(F.count(F.lit(1)).over(over) == k, f(c).over(over))

        return num(F.col(self.helper("bounded", (rolling, k - 1, 0))))

    def plan(self, node: Node) -> tuple[DataFrame, Value]:
        """The table with helper columns (``__f...``), and the value over it."""
        df, (value,) = self.plan_all([node])
        return df, value

    def plan_all(self, nodes: list[Node]) -> tuple[DataFrame, list[Value]]:
        """The table with the helper columns of several formulas, and their values. Frames of bounded rows are computed together, and so are running values."""
        values, df = [self.lower(n) for n in nodes], self.df
        if self.numbered and RID not in df.columns:
            if self.order_by is None:
                raise FormulaError("rows have no order; give order_by")
            df = ordering.number_rows(df, self.order_by)
        aggregates: list[tuple[str, Column]] = []
        bounded: dict[str, tuple] = {}
        running: dict[str, tuple] = {}

        def flush():
            nonlocal df, aggregates
            if aggregates:
                df = df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggregates])))  # one row
                aggregates = []

        def flush_sequences():
            nonlocal df, bounded, running
            if bounded:
                df = ordering.bounded_frame(df, {n: w[0] for n, w in bounded.items()}, max(w[1] for w in bounded.values()), max(w[2] for w in bounded.values()))
            if running:
                df = ordering.running(df, {n: (F.col(w[0]), w[1]) for n, w in running.items()})
            bounded, running = {}, {}

        for kind, name, what in self.steps:
            if kind in ("aggregate", "column"):
                if self.refers(what, [*bounded, *running]):
                    flush_sequences()
                if self.refers(what, [n for n, _ in aggregates]):
                    flush()
            if kind == "aggregate":
                aggregates.append((name, what))
            elif kind == "column":
                df = df.withColumn(name, what)
            else:
                # Their arguments are columns that stand by now.
                (bounded if kind == "bounded" else running)[name] = what
        flush_sequences()
        flush()
        return df, values

    @staticmethod
    def refers(c: Column, names: list[str]) -> bool:
        said = str(c)
        return any(n in said for n in names)


def _finish(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__f")])


def with_column(df: DataFrame, name: str, formula: str | Node, order_by=None, row_name: str | None = None) -> DataFrame:
    """``df`` with a formula's value as a column, new or replaced."""
    return with_columns(df, {name: parse(formula) if isinstance(formula, str) else formula}, order_by, row_name)


def with_columns(df: DataFrame, formulas: dict[str, Node], order_by=None, row_name: str | None = None) -> DataFrame:
    """``df`` with the values of formulas that all read ``df`` as it is."""
    planned, values = Lowering(df, order_by, row_name=row_name).plan_all(list(formulas.values()))
    out = _finish(planned.withColumns({n: v.column for n, v in zip(formulas, values)}))
    return out.select(*df.columns, *[n for n in formulas if n not in df.columns])


def filter_rows(df: DataFrame, formula: str, order_by=None, row_name: str | None = None) -> DataFrame:
    """Rows for which a formula is true."""
    lowering = Lowering(df, order_by, row_name=row_name)
    node = parse(formula)
    planned, _ = lowering.plan(node)
    return planned.filter(lowering.predicate(node)).select(*df.columns)


def execute(df: DataFrame, script: str, order_by=None, row_name: str | None = None) -> DataFrame:
    """Run a script's assignments in turn, each seeing what came before. Rows are numbered once, if any statement needs their order."""
    script_of = statements(script)
    added = order_by is not None and RID not in df.columns and any(needs_order(node) for _, _, node in script_of)
    if added:
        df = ordering.number_rows(df, order_by)
    together: dict[str, Node] = {}
    for target, new, node in script_of:
        names = [c for c in df.columns if c not in (RID, "__rowname")]
        names += [n for n in together if n not in names]
        if target.startswith("\0"):
            bare = target[1:]
            i = letter_to_number(bare) if bare.isalpha() else -1
            target = names[i] if 0 <= i < len(names) else bare
        if not new and target not in names:
            raise FormulaError(f"no column {target!r} to assign to")
        if together and not _independent(node, target, names, together):
            df, together = with_columns(df, together, order_by, row_name), {}
        together[target] = node
    if together:
        df = with_columns(df, together, order_by, row_name)
    return df.drop(RID) if added else df


#: Kinds of nodes that name each column they read.
_PLAIN = {"number", "string", "constant", "name", "letter", "call", "binary", "unary", "compare"}


def _independent(node: Node, target: str, names: list[str], made: dict[str, Node]) -> bool:
    """Whether a statement reads nothing that those before it make, so that it can be computed with them."""
    if target in made or any(n.kind not in _PLAIN for n in node.walk()):
        return False
    for n in node.walk():
        if n.kind == "name" and n.value in made:
            return False
        if n.kind == "letter" and ((i := letter_to_number(n.value)) >= len(names) - len(made) or names[i] in made):
            return False
    return True


def needs_order(node: Node) -> bool:
    """Whether the value depends on the order of the rows."""
    return any(n.kind in ("index", "access") or n.kind == "call" and n.value in SEQUENCE for n in node.walk())


def is_row_dependent(node: Node) -> bool:
    """Whether the value can differ from row to row."""
    if node.kind == "call" and node.value in AGGREGATE | set(USER_AGGREGATE):
        return any(n.kind == "index" for n in node.walk())
    if node.kind in ("letter", "name", "row", "index") or node.kind == "call" and node.value in SEQUENCE:
        return True
    if node.kind == "access" and not any(n.kind == "index" for n in node.parts[1].walk()):
        return False
    return any(is_row_dependent(p) for p in node.parts)


class MapContext:
    """Formulas over lists in memory, one for each name: evaluated as the columns of a small table."""

    def __init__(self, spark, columns: dict[str, list]):
        self.spark, self.columns = spark, {k: list(v) for k, v in columns.items()}

    def bind(self, name: str, values: list) -> None:
        self.columns[name] = list(values)

    def _table(self) -> DataFrame:
        from millrace.table import Table

        return Table.of(self.spark, self.columns).df

    def evaluate(self, expression: str) -> list:
        """The value of a formula in each row."""
        return [r["\0value"] for r in with_column(self._table(), "\0value", expression, RID).orderBy(RID).select("`\0value`").collect()]

    def execute(self, script: str) -> None:
        """Run assignments; their columns are bound afterwards."""
        out = execute(self._table(), script, RID)
        names = [c for c in out.columns if c != RID]
        rows = out.orderBy(RID).select(*[F.col(f"`{c}`") for c in names]).collect()
        self.columns = {c: [r[i] for r in rows] for i, c in enumerate(names)}
