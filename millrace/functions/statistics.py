"""Descriptive measures and hypothesis tests.

The data stay distributed: every test is a few aggregates (counts, sums, ranks
by running counts), from which the driver computes the statistic and its
p-value. Cells that are no numbers, or NaN, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.ordering import checkpointed
from millrace.operators.window import number, rank_average

Sample = tuple[DataFrame, str]


@dataclass(frozen=True)
class Test:
    """A test's outcome; fields that a test doesn't have are None."""

    statistic: float
    p: float
    df: float | None = None
    df2: float | None = None
    interval: tuple[float, float] | None = None
    effect: float | None = None
    detail: dict | None = None

    def show(self) -> str:
        """The outcome as lines of names and values; fields without a value are left out."""
        rows = [("statistic", self.statistic), ("p", self.p), ("df", self.df), ("df2", self.df2), ("interval", self.interval), ("effect", self.effect), *(self.detail or {}).items()]
        shown = lambda v: ", ".join(f"{x:.6g}" for x in v) if isinstance(v, tuple) else f"{v:.6g}" if isinstance(v, float) else str(v)
        return "\n".join(f"{k}: {shown(v)}" for k, v in rows if v is not None)


def moments(s: Sample) -> tuple[int, float, float]:
    """(n, mean, sample variance)."""
    df, c = s
    x = number(c)
    r = df.agg(F.count(x), F.avg(x), F.var_samp(x)).first()
    return r[0], r[1] if r[1] is not None else math.nan, r[2] if r[2] is not None else math.nan


def exact_mean(c: str | Column) -> Column:
    """Mean as an aggregate that is the same however rows are split or ordered.

    Each number is a whole multiple of 2**-20 and a rest of 2**-52s, both summed as integers, which is exact
    while magnitudes sum to less than 8e9; larger sums round as usual.
    """
    scaled = number(c) * F.lit(2.0**20)
    whole = F.rint(scaled)
    rest = F.nanvl(F.rint((scaled - whole) * F.lit(2.0**32)), F.lit(0.0)).cast("long")
    return F.try_divide((F.sum(whole) + F.sum(rest) / F.lit(2.0**32)) / F.lit(2.0**20), F.count(scaled))


def central_moments(df: DataFrame, c: str, orders: Sequence[int]) -> list[float]:
    """Central moments, in two passes: the mean is sent to all tasks."""
    x = number(c)
    mean = df.agg(F.avg(x)).first()[0]
    if mean is None:
        return [math.nan] * len(orders)
    r = df.agg(*[F.avg(F.pow(x - F.lit(mean), F.lit(float(k)))) for k in orders]).first()
    return [float(v) for v in r]


def moment(df: DataFrame, c: str, n: int, central: bool = True) -> float:
    return central_moments(df, c, [n])[0] if central else df.agg(F.avg(F.pow(number(c), F.lit(float(n))))).first()[0]


def skewness(df: DataFrame, c: str, method: str = "g1") -> float:
    """g1, the adjusted G1, or b1."""
    n, _, var = moments((df, c))
    m2, m3 = central_moments(df, c, [2, 3])
    g1 = m3 / m2**1.5 if m2 else math.nan
    return {"g1": g1, "G1": g1 * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else math.nan, "b1": m3 / var**1.5 if var else math.nan}[method]


def kurtosis(df: DataFrame, c: str, method: str = "g2") -> float:
    """Excess g2, the adjusted G2, or b2."""
    n, _, var = moments((df, c))
    m2, m4 = central_moments(df, c, [2, 4])
    g2 = m4 / m2**2 - 3 if m2 else math.nan
    return {"g2": g2, "G2": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else math.nan, "b2": m4 / var**2 - 3 if var else math.nan}[method]


def covariance(df: DataFrame, x: str, y: str) -> float:
    return df.agg(F.covar_samp(number(x), number(y))).first()[0]


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as doubles, rows without a gap only."""
    return df.select(*[number(c).alias(c) for c in columns]).na.drop()


def _correlation_test(r: float, n: int, level: float) -> Test:
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.copysign(math.inf, r)
    ci = None
    if n > 3 and abs(r) < 1:
        half = D.normal_ppf((1 + level) / 2) / math.sqrt(n - 3)
        ci = (math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half))
    return Test(r, D.two_sided(lambda v: D.t_sf(v, n - 2), t), n - 2, interval=ci)


def pearson(df: DataFrame, x: str, y: str, level: float = 0.95) -> Test:
    r = complete(df, x, y).agg(F.corr(x, y), F.count(F.lit(1))).first()
    return _correlation_test(r[0] if r[0] is not None else math.nan, r[1], level)


def spearman(df: DataFrame, x: str, y: str, level: float = 0.95) -> Test:
    """Pearson of the average ranks; exact by enumeration up to 9 pairs without ties."""
    d = complete(df, x, y)
    ranked = rank_average(rank_average(d, x, name="__rx"), y, name="__ry")
    r = ranked.agg(F.corr("__rx", "__ry"), F.count(F.lit(1)), F.count_distinct(x), F.count_distinct(y)).first()
    test = _correlation_test(r[0], r[1], level)
    if r[1] <= 9 and r[2] == r[1] == r[3]:
        from itertools import permutations

        base = np.arange(r[1]) - (r[1] - 1) / 2
        top = abs(r[0]) * (base @ base) - 1e-9
        all_ = [abs(base @ base[list(p)]) >= top for p in permutations(range(r[1]))]
        return Test(test.statistic, sum(all_) / len(all_), interval=test.interval)
    return test


def kendall(df: DataFrame, x: str, y: str) -> Test:
    """tau-b, with discordant pairs counted in blocks of bounded rows.

    Distinct pairs with their counts are the input, so repeated pairs cost
    nothing. Both axes are cut at quantiles; a value at a cut is a block of its
    own, in which nothing can be discordant, so frequent values cost nothing
    either. Two points are discordant within a block of x, or within a block of y
    over different blocks of x, which tasks count, or over different blocks of
    both, which the table of blocks tells.
    """
    pairs = complete(df, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    ties = lambda c: pairs.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)), F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)), F.sum(F.col("t"))).first()
    tx, ty = ties(x), ties(y)
    n = int(tx[3] or 0)
    both = pairs.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    total = n * (n - 1) / 2
    s = total - tx[0] - ty[0] + both - 2 * _discordant(pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("n").cast("double").alias("n")))
    tau = s / math.sqrt((total - tx[0]) * (total - ty[0]))
    v = (n * (n - 1) * (2 * n + 5) - tx[1] - ty[1]) / 18 + (4 * tx[0] * ty[0]) / (2 * n * (n - 1)) + (tx[2] * ty[2]) / (9 * n * (n - 1) * (n - 2) if n > 2 else 1)
    return Test(tau, D.two_sided(D.normal_sf, s / math.sqrt(v)), detail={"s": s})


#: Distinct pairs of a block, and cuts of an axis at most (the table of blocks is at the driver).
KENDALL_ROWS, KENDALL_CUTS = 100_000, 200


def _discordant(pairs: DataFrame, rows: int = KENDALL_ROWS) -> float:
    """Weight of the discordant pairs among points (x, y, n)."""
    pairs = checkpointed(pairs)
    cuts = min(KENDALL_CUTS, pairs.count() // rows)
    at = [i / (cuts + 1) for i in range(1, cuts + 1)]
    block = {}
    for c, bounds in zip("xy", pairs.approxQuantile(["x", "y"], at, 0.25 / (cuts + 1)) if cuts else ([], [])):
        edges, own = F.array(*[F.lit(v) for v in sorted(set(bounds))]).cast("array<double>"), F.col(c)
        # Even numbers are the stretches between cuts, odd ones the values at them.
        block[f"b{c}"] = 2 * F.size(F.filter(edges, lambda e: e < own)) + F.array_contains(edges, own).cast("int")  # noqa: B023
    placed = pairs.withColumns(block)

    def count(data):
        import pyarrow as pa

        x, y, w = (data.column(c).to_numpy().astype(float) for c in ("at", "y", "n"))
        order = np.lexsort((y, x))
        return pa.table({"w": [inversions(y[order], w[order])]})

    parts = [placed.filter("bx % 2 = 0").select(F.col("bx").alias("b"), F.col("x").alias("at"), "y", "n"), placed.filter("by % 2 = 0").select(F.col("by").alias("b"), F.col("bx").cast("double").alias("at"), "y", "n")]
    inside = sum(p.groupBy("b").applyInArrow(count, "w double").agg(F.sum("w")).first()[0] or 0.0 for p in parts)
    size = 2 * cuts + 1
    table = np.zeros((size, size))
    for r in placed.groupBy("bx", "by").agg(F.sum("n")).collect():
        table[r[0], r[1]] = r[2]
    # Of each block: all that stand in earlier blocks of x and later ones of y.
    ahead = np.zeros((size + 1, size + 1))
    ahead[1:, :-1] = table[:, ::-1].cumsum(axis=1)[:, ::-1].cumsum(axis=0)
    return inside + float((table * ahead[:-1, 1:]).sum())


def inversions(y: np.ndarray, w: np.ndarray, base: int = 64) -> float:
    """Sum of products of weights of places i < j with y_i > y_j: small pieces by comparison of all, then halves merged."""
    n, total = len(y), 0.0
    pad = -n % base
    y, w = np.r_[y, np.full(pad, np.inf)], np.r_[w, np.zeros(pad)]
    a, b = y.reshape(-1, base), w.reshape(-1, base)
    upper = np.triu(np.ones((base, base), bool), 1)
    for at in range(0, len(a), 256):
        more = (a[at : at + 256, :, None] > a[at : at + 256, None, :]) & upper
        total += float(np.einsum("ki,kij,kj->", b[at : at + 256], more, b[at : at + 256]))
    size = base
    while size < len(y):
        for at in range(0, len(y), 2 * size):
            left, right = slice(at, at + size), slice(at + size, min(at + 2 * size, len(y)))
            if size == base:
                for part in (left, right):
                    o = np.argsort(y[part], kind="stable")
                    y[part], w[part] = y[part][o], w[part][o]
            upto = np.r_[0.0, np.cumsum(w[left])]
            total += float((w[right] * (upto[-1] - upto[np.searchsorted(y[left], y[right], side="right")])).sum())
            both = slice(left.start, right.stop)
            o = np.argsort(y[both], kind="stable")
            y[both], w[both] = y[both][o], w[both][o]
        size *= 2
    return total


CORRELATIONS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> tuple[np.ndarray, np.ndarray]:
    """(correlations, p-values); Pearson needs one pass for all pairs."""
    k = len(columns)
    r, p = np.eye(k), np.zeros((k, k))
    pairs = list(combinations(range(k), 2))
    if method == "pearson":
        row = df.agg(*[f(F.when(number(columns[j]).isNotNull(), number(columns[i])), F.when(number(columns[i]).isNotNull(), number(columns[j]))) for i, j in pairs for f in (F.corr, lambda a, b: F.count(F.when(a.isNotNull() & b.isNotNull(), 1)))]).first() if pairs else []
        tests = [_correlation_test(row[2 * m], row[2 * m + 1], 0.95) for m in range(len(pairs))]
    else:
        tests = [CORRELATIONS[method](df, columns[i], columns[j]) for i, j in pairs]
    for (i, j), t in zip(pairs, tests):
        r[i, j] = r[j, i] = t.statistic
        p[i, j] = p[j, i] = t.p
    return r, p


def bartlett_sphericity(df: DataFrame, columns: Sequence[str]) -> Test:
    d = complete(df, *columns)
    r, _ = correlation_matrix(d, columns)
    n, k = d.count(), len(columns)
    chi = -(n - 1 - (2 * k + 5) / 6) * math.log(np.linalg.det(r))
    f = k * (k - 1) / 2
    return Test(chi, D.chi2_sf(chi, f), f)


# t, z and F tests.


def _interval(mid: float, half: float) -> tuple[float, float]:
    return mid - half, mid + half


def t_test_single(s: Sample, mu: float, level: float = 0.95) -> Test:
    n, m, v = moments(s)
    se = math.sqrt(v / n)
    t = (m - mu) / se
    return Test(t, D.two_sided(lambda x: D.t_sf(x, n - 1), t), n - 1, interval=_interval(m, D.t_ppf((1 + level) / 2, n - 1) * se), effect=(m - mu) / math.sqrt(v))


def t_test_two(a: Sample, b: Sample, equal_variance: bool = False, level: float = 0.95) -> Test:
    (n1, m1, v1), (n2, m2, v2) = moments(a), moments(b)
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    if equal_variance:
        se, df = math.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2
    else:
        q1, q2 = v1 / n1, v2 / n2
        se, df = math.sqrt(q1 + q2), (q1 + q2) ** 2 / (q1**2 / (n1 - 1) + q2**2 / (n2 - 1))
    t = (m1 - m2) / se
    return Test(t, D.two_sided(lambda x: D.t_sf(x, df), t), df, interval=_interval(m1 - m2, D.t_ppf((1 + level) / 2, df) * se), effect=(m1 - m2) / math.sqrt(pooled))


def t_test_paired(df: DataFrame, x: str, y: str, level: float = 0.95) -> Test:
    return t_test_single((df.select((number(x) - number(y)).alias("d")), "d"), 0.0, level)


def z_test_single(s: Sample, mu: float, sigma: float, alternative: str = "two-sided", level: float = 0.95) -> Test:
    n, m, _ = moments(s)
    se = sigma / math.sqrt(n)
    return Test((m - mu) / se, D.tail(D.normal_sf, (m - mu) / se, alternative), interval=_interval(m, D.normal_ppf((1 + level) / 2) * se), effect=(m - mu) / sigma)


def z_test_two(a: Sample, b: Sample, sigma1: float, sigma2: float, alternative: str = "two-sided", level: float = 0.95) -> Test:
    (n1, m1, _), (n2, m2, _) = moments(a), moments(b)
    se = math.sqrt(sigma1**2 / n1 + sigma2**2 / n2)
    return Test((m1 - m2) / se, D.tail(D.normal_sf, (m1 - m2) / se, alternative), interval=_interval(m1 - m2, D.normal_ppf((1 + level) / 2) * se))


def f_test_variance(a: Sample, b: Sample) -> Test:
    (n1, _, v1), (n2, _, v2) = moments(a), moments(b)
    f = v1 / v2
    upper = D.f_sf(f, n1 - 1, n2 - 1)
    return Test(f, min(1.0, 2 * min(upper, 1 - upper)), n1 - 1, n2 - 1)


def f_test_regression(ssr: float, sse: float, df1: int, df2: int) -> Test:
    f = (ssr / df1) / (sse / df2)
    return Test(f, D.f_sf(f, df1, df2), df1, df2)


def f_test_nested(rss_reduced: float, rss_full: float, df_reduced: int, df_full: int) -> Test:
    f = ((rss_reduced - rss_full) / (df_reduced - df_full)) / (rss_full / df_full)
    return Test(f, D.f_sf(f, df_reduced - df_full, df_full), df_reduced - df_full, df_full)


def group_sums(df: DataFrame, value: str, group: str):
    """Sums over the groups, added up in Spark: k groups, n rows, between and within sums of squares, and those of Bartlett's test."""
    x = number(value)
    each = df.filter(x.isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    grand = df.agg(F.avg(x)).first()[0]
    far = F.col("m") - F.lit(grand)
    free = F.col("n") - 1
    return each.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * far * far).alias("between"), F.sum(free * F.col("v")).alias("within"), F.sum(F.when(free > 0, free * F.log("v"))).alias("logs"), F.sum(F.when(free > 0, 1 / free)).alias("inverse"), F.count_if((free > 0) & (F.col("v") <= 0)).alias("flat")).first()


def anova_one_way(df: DataFrame, value: str, group: str) -> Test:
    g = group_sums(df, value, group)
    d1, d2 = g.k - 1, g.n - g.k
    f = (g.between / d1) / (g.within / d2)
    return Test(f, D.f_sf(f, d1, d2), d1, d2, effect=g.between / (g.between + g.within), detail={"ss_between": g.between, "ss_within": g.within})


def anova_two_way(df: DataFrame, value: str, a: str, b: str) -> dict[str, Test]:
    """Effects of two factors and their interaction over balanced or unweighted cells."""
    x = number(value)
    cells = {(r[0], r[1]): (r[2], r[3], r[4] or 0.0) for r in df.filter(x.isNotNull()).groupBy(a, b).agg(F.count(x), F.avg(x), F.var_samp(x)).collect()}
    las, lbs = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    if len(cells) < len(las) * len(lbs):
        raise ValueError("a cell is empty")
    n = sum(c[0] for c in cells.values())
    grand = sum(c[0] * c[1] for c in cells.values()) / n
    mean = lambda keys: (sum(cells[k][0] * cells[k][1] for k in keys) / sum(cells[k][0] for k in keys), sum(cells[k][0] for k in keys))
    ss_a = sum(w * (m - grand) ** 2 for m, w in (mean([(i, j) for j in lbs]) for i in las))
    ss_b = sum(w * (m - grand) ** 2 for m, w in (mean([(i, j) for i in las]) for j in lbs))
    ss_cells = sum(c[0] * (c[1] - grand) ** 2 for c in cells.values())
    within, d_w = sum((c[0] - 1) * c[2] for c in cells.values()), n - len(cells)
    out = {}
    for name, ss, d in (("a", ss_a, len(las) - 1), ("b", ss_b, len(lbs) - 1), ("interaction", ss_cells - ss_a - ss_b, (len(las) - 1) * (len(lbs) - 1))):
        f = (ss / d) / (within / d_w)
        out[name] = Test(f, D.f_sf(f, d, d_w), d, d_w, effect=ss / (ss_cells + within), detail={"ss": ss})
    return out


def anova_repeated(df: DataFrame, value: str, subject: str, condition: str) -> Test:
    x = number(value)
    r = df.agg(F.avg(x), F.var_pop(x) * F.count(x), F.count(x)).first()
    ss = lambda key: df.groupBy(key).agg(F.avg(x).alias("m"), F.count(x).alias("n")).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.lit(r[0]), F.lit(2.0))), F.count(F.lit(1))).first()
    c, s = ss(condition), ss(subject)
    d1, d2 = c[1] - 1, (c[1] - 1) * (s[1] - 1)
    error = r[1] - c[0] - s[0]
    f = (c[0] / d1) / (error / d2)
    return Test(f, D.f_sf(f, d1, d2), d1, d2, effect=c[0] / (c[0] + error), detail={"ss_conditions": c[0], "ss_subjects": s[0], "ss_error": error})


def levene(df: DataFrame, value: str, group: str) -> Test:
    """Spread about the group medians."""
    x = number(value)
    medians = df.groupBy(F.col(group).alias("__g")).agg(F.percentile(x, F.lit(0.5)).alias("__m"))
    return anova_one_way(df.join(medians, F.col(group).eqNullSafe(F.col("__g"))).select(group, F.abs(x - F.col("__m")).alias("d")), "d", group)


def bartlett(df: DataFrame, value: str, group: str) -> Test:
    g = group_sums(df, value, group)
    if g.flat:
        raise ValueError("a group has no spread")
    pooled = g.within / (g.n - g.k)
    t = (g.n - g.k) * math.log(pooled) - g.logs
    t /= 1 + (g.inverse - 1 / (g.n - g.k)) / (3 * (g.k - 1))
    return Test(t, D.chi2_sf(t, g.k - 1), g.k - 1)


def chi_square_fit(df: DataFrame, column: str, probabilities: Sequence[float] | None = None, rescale: bool = False) -> Test:
    """Counts of the values, in order, against probabilities (equal ones, if None)."""
    counts = [r[1] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(column).collect()]
    p = [1 / len(counts)] * len(counts) if probabilities is None else list(probabilities)
    if len(p) != len(counts):
        raise ValueError("as many probabilities as values are needed")
    total = sum(p)
    if not rescale and abs(total - 1) > 1e-9:
        raise ValueError("probabilities must sum to 1")
    n = sum(counts)
    chi = sum((c - n * q / total) ** 2 / (n * q / total) for c, q in zip(counts, p))
    return Test(chi, D.chi2_sf(chi, len(counts) - 1), len(counts) - 1)


def chi_square_independence(df: DataFrame, a: str, b: str) -> Test:
    """Over the contingency table of two columns: chi-squared = n (sum of n_ij^2 / (n_i n_j) - 1), as joins of counts."""
    d = df.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop()
    cells = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    r = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") * F.col("n") / F.col("ra") / F.col("cb")), F.sum("n")).first()
    i, j = rows.count(), cols.count()
    chi = r[1] * (r[0] - 1)
    f = (i - 1) * (j - 1)
    return Test(chi, D.chi2_sf(chi, f), f, effect=math.sqrt(chi / (r[1] * min(i - 1, j - 1))) if min(i, j) > 1 else None)


# Rank tests.


def _signed_rank_p(n: int, w: float, alternative: str) -> float:
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k]
    return _exact(counts, w, alternative)


def _exact(counts: np.ndarray, w: float, alternative: str) -> float:
    p = counts / counts.sum()
    low, high = p[: int(math.floor(w)) + 1].sum(), p[int(math.ceil(w)) :].sum()
    return float(high if alternative == "greater" else low if alternative == "less" else min(1.0, 2 * min(low, high)))


def _normal_p(u: float, mean: float, var: float, alternative: str) -> float:
    d = u - mean
    shift = {"two-sided": math.copysign(0.5, d) if d else 0.0, "greater": 0.5, "less": -0.5}[alternative]
    return D.tail(D.normal_sf, (d - shift) / math.sqrt(var), alternative) if var > 0 else 1.0


def wilcoxon_single(s: Sample, mu: float = 0.0, alternative: str = "two-sided") -> Test:
    """Signed ranks of the differences without zeros; exact up to 50 without ties."""
    df, c = s
    d = checkpointed(df.select((number(c) - F.lit(mu)).alias("d")).filter("d is not null and d <> 0").select("d", F.abs("d").alias("a")))
    ranked = rank_average(d, "a")
    v, n = ranked.agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.count(F.lit(1))).first()
    ties = d.groupBy("a").count().agg(F.sum(F.col("count") * (F.col("count") * F.col("count") - 1)), F.max("count")).first()
    if n and n <= 50 and ties[1] == 1:
        return Test(v, _signed_rank_p(n, v, alternative), detail={"exact": True, "n": n})
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties[0] or 0) / 48
    return Test(v or 0.0, _normal_p(v or 0.0, n * (n + 1) / 4, var, alternative), detail={"exact": False, "n": n})


def wilcoxon_paired(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> Test:
    return wilcoxon_single((df.select((number(x) - number(y)).alias("d")), "d"), 0.0, alternative)


def _ranked_groups(df: DataFrame, value: str, group: str) -> tuple[list, float]:
    """([(group, n, rank sum)], sum of t^3 - t over ties)."""
    d = df.select(number(value).alias("v"), F.col(group).alias("g")).filter("v is not null")
    rows = rank_average(d, "v").groupBy("g").agg(F.count(F.lit(1)), F.sum("rank")).orderBy("g").collect()
    ties = d.groupBy("v").count().agg(F.sum(F.pow("count", F.lit(3.0)) - F.col("count"))).first()[0] or 0.0
    return [tuple(r) for r in rows], ties


def mann_whitney(a: Sample, b: Sample, alternative: str = "two-sided") -> Test:
    both = a[0].select(number(a[1]).alias("v"), F.lit(0).alias("g")).unionByName(b[0].select(number(b[1]).alias("v"), F.lit(1).alias("g")))
    rows, ties = _ranked_groups(both, "v", "g")
    (_, n1, r1), (_, n2, _) = rows
    u, n = r1 - n1 * (n1 + 1) / 2, n1 + n2
    if n1 < 50 and n2 < 50 and not ties:
        # Number of ways to reach each sum: partitions of u into at most n1 parts of n2 at most.
        counts = np.zeros((n1 + 1, n1 * n2 + 1))
        counts[0, 0] = 1
        for value in range(1, n + 1):
            for k in range(min(value, n1), 0, -1):
                step = value - k
                counts[k, step:] += counts[k - 1, : n1 * n2 + 1 - step] if step else counts[k - 1]
        return Test(u, _exact(counts[n1], u, alternative), detail={"exact": True})
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    return Test(u, _normal_p(u, n1 * n2 / 2, var, alternative), detail={"exact": False})


def kruskal_wallis(df: DataFrame, value: str, group: str) -> Test:
    rows, ties = _ranked_groups(df, value, group)
    n = sum(r[1] for r in rows)
    h = 12 / (n * (n + 1)) * sum(r[2] ** 2 / r[1] for r in rows) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return Test(h, D.chi2_sf(h, len(rows) - 1), len(rows) - 1)


def friedman(df: DataFrame, value: str, subject: str, condition: str) -> Test:
    """Ranks within each subject, by windows over the subject's few rows."""
    from pyspark.sql import Window as W

    d = df.select(number(value).alias("v"), F.col(subject).alias("s"), F.col(condition).alias("c")).na.drop()
    same, w = W.partitionBy("s", "v"), W.partitionBy("s").orderBy("v")
    ranked = d.withColumns({"r": F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2, "t": F.count(F.lit(1)).over(same)})
    sums = ranked.groupBy("c").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    ties = ranked.agg(F.sum(F.col("t") * F.col("t") - 1)).first()[0]
    k, n = len(sums), sums[0].n
    top = 12 * sum((x.r - n * (k + 1) / 2) ** 2 for x in sums)
    q = top / (n * k * (k + 1) - ties / (k - 1))
    return Test(q, D.chi2_sf(q, k - 1), k - 1)


def diag(x, rows: int | None = None, cols: int | None = None):
    """Diagonal of a matrix, matrix with a diagonal, or an identity matrix of a size."""
    if isinstance(x, int):
        return np.eye(x, cols or rows or x)
    a = np.asarray(x, float)
    if a.ndim == 2:
        return np.diagonal(a).copy()
    out = np.zeros((rows or len(a), cols or rows or len(a)))
    k = min(out.shape)
    out[range(k), range(k)] = np.resize(a, k)
    return out


