"""Linear, polynomial and generalised linear models.

A fit is one aggregate per step: the entries of X'WX and X'Wz are sums over the
rows, computed where the rows are; the driver solves a k by k system.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import distributions as D
from millrace.operators.window import number


@dataclass(frozen=True)
class Fit:
    """A fitted model: coefficients (intercept first) with their inference, and measures of fit."""

    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    statistics: np.ndarray
    p_values: np.ndarray
    intervals: np.ndarray
    n: int
    measures: dict[str, float] = field(default_factory=dict)
    family: str = "gaussian"
    link: str = "identity"

    def predictor(self, offset: Column | None = None) -> Column:
        eta = F.lit(float(self.coefficients[0]))
        for name, b in zip(self.names[1:], self.coefficients[1:]):
            eta = eta + F.lit(float(b)) * F.col(name).cast("double")
        return eta + offset if offset is not None else eta

    def predict(self, df: DataFrame, kind: str = "response", offset: str | None = None, name: str = "prediction", threshold: float = 0.5) -> DataFrame:
        """``df`` with the linear predictor (link), the mean (response), or a class by threshold."""
        eta = self.predictor(F.col(offset) if offset else None)
        mu = LINKS[self.link][0](eta)
        return df.withColumn(name, eta if kind == "link" else mu if kind == "response" else (mu >= threshold).cast("int"))


def _sums(df: DataFrame, x: list[Column], w: Column, z: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'WX, X'Wz, z'Wz, n) of the design with an intercept."""
    design = [F.lit(1.0), *x]
    k = len(design)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = df.agg(*[F.sum(w * design[i] * design[j]) for i, j in pairs], *[F.sum(w * c * z) for c in design], F.sum(w * z * z), F.count(F.lit(1))).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, r):
        a[i, j] = a[j, i] = v if v is not None else math.nan
    m = len(pairs)
    return a, np.array(r[m : m + k], float), float(r[m + k] or 0.0), int(r[m + k + 1])


def _inference(names, b, cov, df_resid, level, normal, n, measures, family="gaussian", link="identity") -> Fit:
    se = np.sqrt(np.maximum(np.diagonal(cov), 0))
    t = b / np.where(se > 0, se, np.nan)
    p = np.array([D.two_sided(D.normal_sf if normal else (lambda x: D.t_sf(x, df_resid)), v) if np.isfinite(v) else math.nan for v in t])
    q = D.normal_ppf((1 + level) / 2) if normal else D.t_ppf((1 + level) / 2, df_resid)
    return Fit(names, b, se, t, p, np.stack([b - q * se, b + q * se], axis=1), n, measures, family, link)


def linear(df: DataFrame, y: str | Column, xs: Sequence[str | Column], names: Sequence[str] | None = None, level: float = 0.95) -> Fit:
    """Ordinary least squares of complete rows. The design is centred first, which keeps the normal equations well scaled."""
    cols = [number(c) for c in xs]
    d = df.select(number(y).alias("__y"), *[c.alias(f"__x{i}") for i, c in enumerate(cols)]).na.drop()
    x = [f"__x{i}" for i in range(len(cols))]
    means = d.agg(F.avg("__y"), *[F.avg(c) for c in x]).first()
    if means[0] is None:
        raise ValueError("no complete rows")
    a, b, yy, n = _sums(d, [F.col(c) - F.lit(m) for c, m in zip(x, means[1:])], F.lit(1.0), F.col("__y") - F.lit(means[0]))
    k = len(x) + 1
    if n <= k:
        raise ValueError("too few rows")
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = max(yy - beta @ b, 0.0)
    shift = np.array([1.0, *(-np.array(means[1:], float))])
    # Back to the design that isn't centred: only the intercept changes.
    to = np.eye(k)
    to[0] = shift
    coefficients = to @ beta
    coefficients[0] += means[0]
    cov = to @ inverse @ to.T * rss / (n - k)
    r2 = 1 - rss / yy if yy else math.nan
    measures = {"r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - k), "rss": rss, "sigma": math.sqrt(rss / (n - k))}
    if k > 1 and rss > 0:
        f = ((yy - rss) / (k - 1)) / (rss / (n - k))
        measures |= {"f": f, "f_p": D.f_sf(f, k - 1, n - k)}
    return _inference(["intercept", *(names or [c if isinstance(c, str) else f"x{i}" for i, c in enumerate(xs)])], coefficients, cov, n - k, level, False, n, measures)


def polynomial(df: DataFrame, y: str, x: str, degree: int, level: float = 0.95) -> Fit:
    return linear(df, y, [F.pow(F.col(x).cast("double"), F.lit(float(k))) for k in range(1, degree + 1)], [f"{x}^{k}" for k in range(1, degree + 1)], level)


def exponential(df: DataFrame, y: str, x: str, level: float = 0.95) -> Fit:
    """y = a exp(b x), by ln y; rows with y <= 0 can't take part. ``measures`` has a and b."""
    fit = linear(df.filter(F.col(y) > 0), F.ln(F.col(y).cast("double")), [x], level=level)
    fit.measures.update(a=math.exp(fit.coefficients[0]), b=float(fit.coefficients[1]))
    return fit


def logarithmic(df: DataFrame, y: str, x: str, level: float = 0.95) -> Fit:
    """y = a + b ln x; rows with x <= 0 can't take part."""
    return linear(df.filter(F.col(x) > 0), y, [F.ln(F.col(x).cast("double"))], [f"ln({x})"], level)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function as an expression: Abramowitz and Stegun 7.1.26 refined by its asymptotic form in the tails."""
    t = 1 / (1 + F.lit(0.3275911) * F.abs(x) / F.lit(math.sqrt(2)))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x / 2)
    return F.when(x >= 0, 1 - half).otherwise(half)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


#: Links: (mean of eta, derivative of the mean, eta of a mean).
LINKS = {
    "identity": (lambda e: e, lambda e: F.lit(1.0), lambda m: m),
    "log": (lambda e: F.exp(e), lambda e: F.exp(e), lambda m: F.ln(m)),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-F.abs(e)) / F.pow(1 + F.exp(-F.abs(e)), F.lit(2.0)), lambda m: F.ln(m / (1 - m))),
    "probit": (normal_cdf, normal_pdf, None),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(F.least(e, F.lit(30.0)))), lambda e: F.exp(F.least(e, F.lit(30.0)) - F.exp(F.least(e, F.lit(30.0)))), lambda m: F.ln(-F.ln(1 - m))),
}
CANONICAL = {"gaussian": "identity", "binomial": "logit", "poisson": "log"}


def _variance(family: str, mu: Column) -> Column:
    return {"gaussian": lambda: F.lit(1.0), "binomial": lambda: mu * (1 - mu), "poisson": lambda: mu}[family]()


def _deviance(family: str, y: Column, mu: Column) -> Column:
    xlog = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return {"gaussian": lambda: (y - mu) * (y - mu), "binomial": lambda: 2 * (xlog(y, mu) + xlog(1 - y, 1 - mu)), "poisson": lambda: 2 * (xlog(y, mu) - (y - mu))}[family]()


def glm(df: DataFrame, y: str, xs: Sequence[str], family: str = "binomial", link: str | None = None, weights: str | None = None, offset: str | None = None, max_iter: int = 50, tol: float = 1e-9, level: float = 0.95) -> Fit:
    """Iteratively reweighted least squares; one aggregate over the rows per step."""
    link = link or CANONICAL[family]
    inverse, derivative, _ = LINKS[link]
    d = df.select(number(y).alias("y"), *[number(c).alias(f"x{i}") for i, c in enumerate(xs)], (number(weights) if weights else F.lit(1.0)).alias("w"), (number(offset) if offset else F.lit(0.0)).alias("o")).na.drop()
    x = [F.col(f"x{i}") for i in range(len(xs))]
    yc, w0, off = F.col("y"), F.col("w"), F.col("o")
    mean, n = d.agg(F.sum(w0 * yc) / F.sum(w0), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no complete rows")
    if family == "binomial" and d.filter("y < 0 or y > 1").limit(1).count():
        raise ValueError("a binomial response lies in 0 to 1")
    eps = 1e-10
    bound = (lambda m: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), m))) if family == "binomial" else (lambda m: F.greatest(F.lit(eps), m)) if family == "poisson" else (lambda m: m)
    start = {"identity": mean, "log": math.log(max(mean, eps)), "logit": math.log(max(mean, eps) / max(1 - mean, eps)) if family == "binomial" else 0.0, "probit": D.normal_ppf(min(max(mean, 1e-6), 1 - 1e-6)) if 0 < mean < 1 else 0.0, "cloglog": math.log(-math.log(max(1 - mean, eps))) if family == "binomial" else 0.0}[link]
    beta, last, steps, converged = np.array([start, *[0.0] * len(xs)]), math.inf, 0, False

    def parts(b):
        eta = F.lit(float(b[0]))
        for c, v in zip(x, b[1:]):
            eta = eta + F.lit(float(v)) * c
        eta = eta + off
        return eta, bound(inverse(eta)), F.greatest(derivative(eta), F.lit(1e-12))

    for steps in range(1, max_iter + 1):
        eta, mu, slope = parts(beta)
        w = w0 * slope * slope / F.greatest(_variance(family, mu), F.lit(1e-12))
        z = eta - off + (yc - mu) / slope
        a, b, _, _ = _sums(d, x, w, z)
        beta = np.linalg.solve(a, b)
        deviance = d.agg(F.sum(w0 * _deviance(family, yc, parts(beta)[1]))).first()[0]
        if abs(last - deviance) < tol * (abs(deviance) + 0.1):
            converged = True
            break
        last = deviance
    eta, mu, slope = parts(beta)
    a, _, _, _ = _sums(d, x, w0 * slope * slope / F.greatest(_variance(family, mu), F.lit(1e-12)), F.lit(0.0))
    r = d.agg(F.sum(w0 * _deviance(family, yc, mu)), F.sum(w0 * _deviance(family, yc, F.lit(float(mean)))), F.sum(w0 * (yc - mu) * (yc - mu) / F.greatest(_variance(family, mu), F.lit(1e-12)))).first()
    k = len(beta)
    dispersion = r[0] / (n - k) if family == "gaussian" else 1.0
    measures = {"deviance": r[0], "null_deviance": r[1], "pearson": r[2], "iterations": steps, "converged": float(converged), "dispersion": dispersion}
    if family == "binomial":
        measures |= {"log_likelihood": -r[0] / 2, "aic": r[0] + 2 * k, "pseudo_r2": 1 - r[0] / r[1] if r[1] else math.nan}
    return _inference(["intercept", *xs], beta, np.linalg.inv(a) * dispersion, n - k, level, family != "gaussian", n, measures, family, link)


def logistic(df: DataFrame, y: str, xs: Sequence[str], **how) -> Fit:
    return glm(df, y, xs, "binomial", **how)


def poisson(df: DataFrame, y: str, xs: Sequence[str], **how) -> Fit:
    return glm(df, y, xs, "poisson", **how)
