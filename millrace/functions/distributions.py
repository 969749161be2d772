"""Distribution functions by series and continued fractions: normal, t, F, chi-squared, studentised sums."""

from __future__ import annotations

import math


def _fraction(first, step, limit=400, tiny=1e-300, eps=1e-15):
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) by Lentz's method; ``step(i)`` gives (a_i, b_i)."""
    f = first or tiny
    c, d = f, 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < eps:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)

    def step(i):
        m = i // 2
        if i == 1:
            return 1.0, 1.0
        i -= 1
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(0.0, step)


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    return 1 - front * _fraction(0.0, lambda i: (1.0, x + 1 - a) if i == 1 else (-(i - 1) * (i - 1 - a), x + 2 * i - 1 - a))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_cdf(t: float, df: float) -> float:
    return 1 - t_sf(t, df)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


def quantile(cdf, p: float, low: float = -1e3, high: float = 1e3) -> float:
    """Where a continuous distribution function reaches p, by bisection."""
    while cdf(low) > p:
        low *= 2
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-13 * max(1, abs(mid)):
            break
    return (low + high) / 2


def normal_ppf(p: float) -> float:
    return quantile(normal_cdf, p, -40, 40)


def t_ppf(p: float, df: float) -> float:
    return quantile(lambda x: t_cdf(x, df), p)


def two_sided(sf, x: float) -> float:
    return min(1.0, 2 * sf(abs(x)))


def tail(sf, x: float, alternative: str) -> float:
    """p-value of a statistic that is symmetric about zero: two-sided, greater or less."""
    if alternative == "two-sided":
        return two_sided(sf, x)
    return sf(x) if alternative == "greater" else sf(-x) if alternative == "less" else _unknown(alternative)


def _unknown(name):
    raise ValueError(f"unknown alternative {name!r}")
