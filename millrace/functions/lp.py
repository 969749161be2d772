"""Linear and mixed-integer programmes: models, CPLEX-LP text, LINGO text, and a solver.

A programme is bounded driver-side data. The solver is a two-phase dense simplex
with Bland's rule, and branch and bound over it for integer variables.
"""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass, field

import numpy as np

_TERM = re.compile(r"([+-]?)\s*(\d+\.?\d*(?:[eE][+-]?\d+)?)?\s*\*?\s*([A-Za-z_][\w.]*)")


def terms(text: str) -> dict[str, float]:
    """Coefficients of a linear expression."""
    out: dict[str, float] = {}
    for sign, number, name in _TERM.findall(text):
        out[name] = out.get(name, 0.0) + (-1 if sign == "-" else 1) * (float(number) if number else 1.0)
    return out


@dataclass
class Model:
    """An objective, constraints, bounds, and integer and binary variables, as text."""

    sense: str = "Maximize"
    objective: str = ""
    constraints: list[str] = field(default_factory=list)
    bounds: list[str] = field(default_factory=list)
    binaries: list[str] = field(default_factory=list)
    integers: list[str] = field(default_factory=list)

    def set_objective(self, sense: str, objective: str) -> "Model":
        self.sense, self.objective = sense.capitalize(), objective
        return self

    def add_constraint(self, text: str) -> "Model":
        self.constraints.append(text)
        return self

    def add_bound(self, text: str) -> "Model":
        self.bounds.append(text)
        return self

    def add_binary(self, name: str) -> "Model":
        self.binaries.append(name)
        return self

    def add_integer(self, name: str) -> "Model":
        self.integers.append(name)
        return self

    def to_lp(self) -> str:
        """The model in CPLEX-LP format."""
        lines = [self.sense, f"  obj: {self.objective}", "Subject To", *[f"  c{i}: {c}" for i, c in enumerate(self.constraints, 1)]]
        for head, body in (("Bounds", self.bounds), ("Binary", self.binaries), ("General", self.integers)):
            if body:
                lines += [head, *[f"  {b}" for b in body]]
        return "\n".join([*lines, "End", ""])

    def write_lp(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_lp())


def parse_lp(text: str) -> Model:
    """A model from CPLEX-LP text."""
    m, section = Model(), ""
    heads = {"maximize": "obj", "minimize": "obj", "max": "obj", "min": "obj", "subject to": "st", "such that": "st", "st": "st", "s.t.": "st", "bounds": "bounds", "binary": "bin", "binaries": "bin", "general": "int", "generals": "int", "integer": "int", "end": "end"}
    for line in text.splitlines():
        line = line.split("\\")[0].strip()
        if not line:
            continue
        if (key := line.lower().rstrip(":")) in heads:
            section = heads[key]
            if section == "obj":
                m.sense = "Maximize" if key.startswith("max") else "Minimize"
            continue
        body = line.split(":", 1)[-1].strip()
        if section == "obj":
            m.objective = f"{m.objective} {body}".strip()
        elif section in ("bin", "int"):
            (m.binaries if section == "bin" else m.integers).extend(line.split())
        elif section in ("st", "bounds"):
            (m.constraints if section == "st" else m.bounds).append(body)
    return m


def parse_lingo(text: str) -> Model:
    """A model from LINGO text: MAX=...; constraints; @BIN(x); @GIN(x); @BND(low, x, high)."""
    m = Model()
    for part in re.sub(r"![^;]*;", "", text).split(";"):
        s = re.sub(r"^\s*\[\w+\]", "", part.strip())
        if not s or s.upper() in ("MODEL:", "END"):
            continue
        s = re.sub(r"^MODEL:\s*", "", s, flags=re.I)
        if g := re.match(r"(MAX|MIN)\s*=\s*(.*)$", s, re.I | re.S):
            m.set_objective("Maximize" if g[1].upper() == "MAX" else "Minimize", g[2].replace("*", " ").strip())
        elif g := re.match(r"@(BIN|GIN|FREE)\s*\(\s*(\w+)\s*\)", s, re.I):
            {"BIN": m.add_binary, "GIN": m.add_integer, "FREE": lambda v: m.add_bound(f"{v} free")}[g[1].upper()](g[2])
        elif g := re.match(r"@BND\s*\(\s*([^,]+),\s*(\w+),\s*([^)]+)\)", s, re.I):
            m.add_bound(f"{g[1].strip()} <= {g[2]} <= {g[3].strip()}")
        else:
            m.add_constraint(s.replace("*", " ").replace("=<", "<=").replace("=>", ">="))
    return m


@dataclass(frozen=True)
class Solution:
    status: str
    objective: float | None
    values: dict[str, float]
    seconds: float
    nodes: int = 1


def _simplex(c, a, b, eps=1e-9):
    """Maximise c x, a x = b, x >= 0 with b >= 0: (status, x)."""
    m, n = a.shape
    t = np.zeros((m + 1, n + m + 1))
    t[:m, :n], t[:m, n : n + m], t[:m, -1] = a, np.eye(m), b
    basis = list(range(n, n + m))

    def run(cost, allowed):
        t[-1] = 0
        t[-1, : len(cost)] = -cost
        for i, j in enumerate(basis):
            if j < len(cost) and cost[j]:
                t[-1] += cost[j] * t[i]
        while True:
            enter = next((j for j in range(allowed) if t[-1, j] < -eps), None)
            if enter is None:
                return True
            rows = [(t[i, -1] / t[i, enter], basis[i], i) for i in range(m) if t[i, enter] > eps]
            if not rows:
                return False
            i = min(rows)[2]
            t[i] /= t[i, enter]
            for k in range(m + 1):
                if k != i and t[k, enter]:
                    t[k] -= t[k, enter] * t[i]
            basis[i] = enter

    run(np.r_[np.zeros(n), -np.ones(m)], n + m)
    if any(basis[i] >= n and t[i, -1] > 1e-7 for i in range(m)):
        return "infeasible", None
    for i in range(m):
        if basis[i] >= n and (j := next((j for j in range(n) if abs(t[i, j]) > eps), None)) is not None:
            t[i] /= t[i, j]
            for k in range(m + 1):
                if k != i and t[k, j]:
                    t[k] -= t[k, j] * t[i]
            basis[i] = j
    if not run(np.r_[c, np.zeros(m)], n):
        return "unbounded", None
    x = np.zeros(n)
    for i, j in enumerate(basis):
        if j < n:
            x[j] = t[i, -1]
    return "optimal", x


_NUMBER = r"[+-]?\s*(?:\d+\.?\d*(?:[eE][+-]?\d+)?|inf(?:inity)?)"


def solve(model: Model, timeout: float | None = None) -> Solution:
    """Best values of the variables; integer ones by branch and bound, best bound first."""
    import heapq

    began = time.time()
    rows, goal = [], terms(model.objective)
    for c in model.constraints:
        left, op, right = re.match(r"(.*?)(<=|>=|=|<|>)(.*)$", c, re.S).groups()
        lt, rt = terms(left), terms(right)
        const = lambda s, t: float(re.sub(r"\s", "", s)) if not t and s.strip() else 0.0
        coefficient = {v: lt.get(v, 0) - rt.get(v, 0) for v in {*lt, *rt}}
        rows.append((coefficient, op[0] if op != "=" else "=", const(right, rt) - const(left, lt)))
    names = sorted({*goal, *(v for r in rows for v in r[0]), *model.binaries, *model.integers})
    low, high = dict.fromkeys(names, 0.0), dict.fromkeys(names, math.inf)
    num = lambda s: float(re.sub(r"\s", "", s).lower().replace("infinity", "inf"))
    for b in model.bounds:
        if g := re.match(rf"({_NUMBER})\s*<=?\s*(\w+)\s*<=?\s*({_NUMBER})$", b, re.I):
            low[g[2]], high[g[2]] = num(g[1]), num(g[3])
        elif g := re.match(r"(\w+)\s+free$", b, re.I):
            low[g[1]] = -math.inf
        elif g := re.match(rf"([A-Za-z_]\w*)\s*(<=?|>=?|=)\s*({_NUMBER})$", b, re.I):
            if g[2][0] in "<=":
                high[g[1]] = num(g[3])
            if g[2][0] in ">=" and g[2] != "<=":
                low[g[1]] = num(g[3])
    for v in model.binaries:
        low[v], high[v] = 0.0, 1.0
    whole, sign = {*model.binaries, *model.integers}, 1.0 if model.sense.lower().startswith("max") else -1.0

    def relax(lo, hi):
        # x = low + u, or u - w for free variables
        cols, shift = [], {}
        for v in names:
            shift[v] = 0.0 if lo[v] == -math.inf else lo[v]
            cols.append((v, 1.0))
            if lo[v] == -math.inf:
                cols.append((v, -1.0))
        body = [*rows, *[({v: 1.0}, "<", hi[v]) for v in names if hi[v] < math.inf]]
        slack = [i for i, r in enumerate(body) if r[1] != "="]
        a, b = np.zeros((len(body), len(cols) + len(slack))), np.zeros(len(body))
        for i, (co, op, r) in enumerate(body):
            a[i, : len(cols)] = [co.get(v, 0.0) * s for v, s in cols]
            if op != "=":
                a[i, len(cols) + slack.index(i)] = 1.0 if op == "<" else -1.0
            b[i] = r - sum(co.get(v, 0.0) * shift[v] for v in names)
            if b[i] < 0:
                a[i], b[i] = -a[i], -b[i]
        c = np.r_[[sign * goal.get(v, 0.0) * s for v, s in cols], np.zeros(len(slack))]
        status, x = _simplex(c, a, b)
        if status != "optimal":
            return status, None, None
        out = {v: shift[v] for v in names}
        for (v, s), value in zip(cols, x):
            out[v] += s * value
        return status, out, sum(goal.get(v, 0.0) * out[v] for v in names)

    status, x, z = relax(low, high)
    if status != "optimal":
        return Solution(status, None, {}, time.time() - began)
    heap, best, nodes = [(-sign * z, 0, low, high, x)], None, 1
    while heap:
        bound, _, lo, hi, x = heapq.heappop(heap)
        if best and bound >= -sign * best[0] - 1e-9:
            continue
        if timeout and time.time() - began > timeout:
            return Solution("timeout", best[0] if best else None, best[1] if best else {}, time.time() - began, nodes)
        v = next((v for v in names if v in whole and abs(x[v] - round(x[v])) > 1e-6), None)
        if v is None:
            best = (float(-sign * bound), {k: (float(round(y)) if k in whole else float(y)) for k, y in x.items()})
            continue
        for lo2, hi2 in (({**lo, v: float(math.ceil(x[v]))}, hi), (lo, {**hi, v: float(math.floor(x[v]))})):
            if lo2[v] <= hi2[v]:
                status, x2, z2 = relax(lo2, hi2)
                nodes += 1
                if status == "optimal":
                    heapq.heappush(heap, (-sign * z2, nodes, lo2, hi2, x2))
    return Solution("optimal", best[0], best[1], time.time() - began, nodes) if best else Solution("infeasible", None, {}, time.time() - began, nodes)


def solve_file(path: str, timeout: float | None = None) -> Solution:
    with open(path) as f:
        return solve(parse_lp(f.read()), timeout)


def tables(spark, s: Solution):
    """(variables with their values, what is known of the run)."""
    return spark.createDataFrame(sorted(s.values.items()), "variable string, value double"), spark.createDataFrame([("status", s.status), ("objective", str(s.objective)), ("seconds", f"{s.seconds:.3f}"), ("nodes", str(s.nodes))], "name string, value string")
