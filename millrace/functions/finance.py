"""Financial functions in decimal arithmetic, with the spreadsheet sign convention.

Scalars are Python decimals with guard digits; results are rounded to ``scale``
(10, half up, by default). ``per_row`` applies a function to columns in Arrow
batches; ``sln``, ``npv`` and ``pmt`` also exist as plain column expressions for
large tables of doubles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, BEGIN = 0, 1
SCALE, GUARD, LIMIT = 10, 40, 200


def dec(x) -> Decimal:
    """A decimal from text, a whole number, a float (by its printed form) or a decimal."""
    return x if isinstance(x, Decimal) else Decimal(repr(x)) if isinstance(x, float) else Decimal(str(x))


def _money(f: Callable) -> Callable:
    """Compute with guard digits and round the result; plain numbers become decimals."""

    @wraps(f)
    def run(*args, scale: int = SCALE, rounding: str = ROUND_HALF_UP, **kw):
        with localcontext() as c:
            c.prec = scale + GUARD
            out = f(*[dec(a) if isinstance(a, (int, float, str)) and not isinstance(a, bool) else a for a in args], **{k: dec(v) if isinstance(v, (int, float, str)) and not isinstance(v, bool) else v for k, v in kw.items()})
            q = Decimal(1).scaleb(-scale)
            return out.quantize(q, rounding=rounding) if isinstance(out, Decimal) else out

    run.exact = f
    return run


# Time value of money.


def _growth(rate, n):
    return (1 + rate) ** int(n)


def _annuity(rate, n):
    return n if rate == 0 else (_growth(rate, n) - 1) / rate


@_money
def pmt(rate, nper, pv, fv=Decimal(0), timing=END):
    if nper == 0:
        raise ValueError("no periods")
    return -(pv * _growth(rate, nper) + fv) / (_annuity(rate, nper) * (1 + rate * timing))


@_money
def pv(rate, nper, pmt, fv=Decimal(0), timing=END):
    return -(fv + pmt * (1 + rate * timing) * _annuity(rate, nper)) / _growth(rate, nper)


@_money
def fv(rate, nper, pmt, pv=Decimal(0), timing=END):
    return -(pv * _growth(rate, nper) + pmt * (1 + rate * timing) * _annuity(rate, nper))


@_money
def nper(rate, pmt, pv, fv=Decimal(0), timing=END):
    if rate == 0:
        return -(pv + fv) / pmt
    p = pmt * (1 + rate * timing) / rate
    return ((p - fv) / (p + pv)).ln() / (1 + rate).ln()


def _solve(f: Callable[[Decimal], Decimal], guess: Decimal) -> Decimal:
    """A root by the secant method, then by bisection where that leaves the domain."""
    a, b, tol = guess, guess + Decimal("0.0001"), Decimal(1).scaleb(-25)
    fa, fb = f(a), f(b)
    for _ in range(LIMIT):
        if abs(fb) < tol or fa == fb:
            break
        a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
        if b <= -1:
            b = (a - 1) / 2
        fb = f(b)
    if abs(fb) > Decimal("1e-12"):
        raise ValueError("no rate was found")
    return b


@_money
def rate(nper, pmt, pv, fv=Decimal(0), timing=END, guess=Decimal("0.1")):
    return _solve(lambda r: pv * _growth(r, nper) + pmt * (1 + r * timing) * _annuity(r, nper) + fv, guess)


def _balance(rate, per, payment, pv, timing):
    """What is owed after ``per`` periods, as a signed future value."""
    return -(pv * _growth(rate, per) + payment * (1 + rate * timing) * _annuity(rate, per))


@_money
def ipmt(rate, per, nper, pv, fv=Decimal(0), timing=END):
    if not 1 <= per <= nper:
        raise ValueError("the period lies outside the loan")
    payment = pmt.exact(rate, nper, pv, fv, timing)
    if timing and per == 1:
        return Decimal(0)
    interest = _balance(rate, per - 1, payment, pv, timing) * rate
    return (_balance(rate, per - 2, payment, pv, timing) - payment) * rate if timing else interest


@_money
def ppmt(rate, per, nper, pv, fv=Decimal(0), timing=END):
    return pmt.exact(rate, nper, pv, fv, timing) - ipmt.exact(rate, per, nper, pv, fv, timing)


@_money
def cum_ipmt(rate, nper, pv, start, end, timing=END):
    return sum((ipmt.exact(rate, Decimal(k), nper, pv, Decimal(0), timing) for k in range(int(start), int(end) + 1)), Decimal(0))


@_money
def cum_ppmt(rate, nper, pv, start, end, timing=END):
    return sum((ppmt.exact(rate, Decimal(k), nper, pv, Decimal(0), timing) for k in range(int(start), int(end) + 1)), Decimal(0))


def amortization_schedule(rate_, nper_, pv_, fv_=0, timing=END, scale: int = SCALE) -> list[tuple[int, Decimal, Decimal, Decimal, Decimal]]:
    """(period, payment, interest, principal, balance) of each period."""
    out, payment = [], pmt(rate_, nper_, pv_, fv_, timing, scale=scale + 20)
    balance = dec(pv_)
    q = Decimal(1).scaleb(-scale)
    with localcontext() as c:
        c.prec = scale + GUARD
        for k in range(1, int(nper_) + 1):
            interest = Decimal(0) if timing and k == 1 else -balance * dec(rate_)
            principal = payment - interest
            balance = balance + principal
            out.append((k, *(v.quantize(q, rounding=ROUND_HALF_UP) for v in (payment, interest, principal, balance))))
    return out


def schedule_table(spark, *args, **kw) -> DataFrame:
    return spark.createDataFrame(amortization_schedule(*args, **kw), "period int, payment decimal(38,10), interest decimal(38,10), principal decimal(38,10), balance decimal(38,10)")


# Cash flows.


def _npv(rate, flows, first=1):
    return sum((dec(v) / (1 + rate) ** (i + first) for i, v in enumerate(flows)), Decimal(0))


@_money
def npv(rate, flows):
    """The first flow is now."""
    return _npv(rate, flows, 0)


@_money
def npv_excel(rate, flows):
    """The first flow is a period away."""
    return _npv(rate, flows, 1)


@_money
def irr(flows, guess=Decimal("0.1")):
    if not (any(dec(v) > 0 for v in flows) and any(dec(v) < 0 for v in flows)):
        raise ValueError("flows of both signs are needed")
    return _solve(lambda r: _npv(r, flows, 0), guess)


@_money
def mirr(flows, finance_rate, reinvest_rate):
    n = len(flows)
    gains = sum((dec(v) * (1 + reinvest_rate) ** (n - 1 - i) for i, v in enumerate(flows) if dec(v) > 0), Decimal(0))
    costs = sum((dec(v) / (1 + finance_rate) ** i for i, v in enumerate(flows) if dec(v) < 0), Decimal(0))
    return (gains / -costs) ** (Decimal(1) / (n - 1)) - 1


def _xnpv(rate, values, dates):
    return sum((dec(v) / (1 + rate) ** (Decimal((d - dates[0]).days) / 365) for v, d in zip(values, dates)), Decimal(0))


@_money
def xnpv(rate, values, dates):
    return _xnpv(rate, values, dates)


@_money
def xirr(values, dates, guess=Decimal("0.1")):
    return _solve(lambda r: _xnpv(r, values, dates), guess)


# Rates and depreciation.


@_money
def effective_rate(nominal, periods):
    return (1 + nominal / periods) ** int(periods) - 1


@_money
def nominal_rate(effective, periods):
    return ((1 + effective) ** (1 / periods) - 1) * periods


@_money
def continuous_from_annual(effective):
    return (1 + effective).ln()


@_money
def annual_from_continuous(continuous):
    return continuous.exp() - 1


@_money
def sln(cost, salvage, life):
    return (cost - salvage) / life


@_money
def syd(cost, salvage, life, per):
    return (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1))


def _declining(cost, salvage, life, factor, start, end):
    """Double-declining depreciation between two points in time, whole periods pro rata."""
    book, total, k = cost, Decimal(0), 0
    while k < end:
        d = max(Decimal(0), min(book * factor / life, book - salvage))
        total += d * max(Decimal(0), min(end, Decimal(k + 1)) - max(start, Decimal(k)))
        book -= d
        k += 1
    return total


@_money
def ddb(cost, salvage, life, per, factor=Decimal(2)):
    return _declining(cost, salvage, life, factor, per - 1, per)


@_money
def vdb(cost, salvage, life, start, end, factor=Decimal(2), no_switch=False):
    """Declining balance that changes to straight line once that is more, unless told not to."""
    if no_switch:
        return _declining(cost, salvage, life, factor, start, end)
    book, total, k = cost, Decimal(0), 0
    while k < end:
        left = life - k
        d = max(min(book * factor / life, book - salvage), (book - salvage) / left if left > 0 else Decimal(0))
        total += d * max(Decimal(0), min(end, Decimal(k + 1)) - max(start, Decimal(k)))
        book -= d
        k += 1
    return total


# Bonds and bills. Bases: 0 30/360 US, 1 actual/actual, 2 actual/360, 3 actual/365, 4 30/360 European.


def days_360(a: dt.date, b: dt.date, european: bool = False) -> int:
    d1, d2 = a.day, b.day
    if european:
        d1, d2 = min(d1, 30), min(d2, 30)
    else:
        end = lambda d: (d + dt.timedelta(days=1)).month != d.month and d.month == 2
        if end(a) and end(b):
            d2 = 30
        if end(a):
            d1 = 30
        if d2 == 31 and d1 >= 30:
            d2 = 30
        d1 = min(d1, 30)
    return (b.year - a.year) * 360 + (b.month - a.month) * 30 + d2 - d1


def days_between(a: dt.date, b: dt.date, basis: int) -> int:
    return days_360(a, b, basis == 4) if basis in (0, 4) else (b - a).days


def _months(d: dt.date, k: int, anchor: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + k, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(anchor, last))


def coupon_dates(settlement: dt.date, maturity: dt.date, freq: int) -> tuple[dt.date, dt.date, int]:
    """(last coupon up to settlement, next one, coupons still to come)."""
    step, k = 12 // freq, 0
    while _months(maturity, -step * k, maturity.day) > settlement:
        k += 1
    return _months(maturity, -step * k, maturity.day), _months(maturity, -step * (k - 1), maturity.day), k


def _coupon_period(settlement, maturity, freq, basis):
    before, after, n = coupon_dates(settlement, maturity, freq)
    e = Decimal((after - before).days) if basis == 1 else Decimal(365) / freq if basis == 3 else Decimal(360) / freq
    a = Decimal(days_between(before, settlement, basis))
    dsc = e - a if basis in (0, 4) else Decimal((after - settlement).days)
    return e, a, dsc, n


def _price(settlement, maturity, coupon, yld, redemption, freq, basis):
    e, a, dsc, n = _coupon_period(settlement, maturity, freq, basis)
    c, y = 100 * coupon / freq, yld / freq
    if n == 1:
        return (redemption + c) / (1 + dsc / e * y) - c * a / e
    first = dsc / e
    return redemption / (1 + y) ** (n - 1 + first) + sum((c / (1 + y) ** (k + first) for k in range(n)), Decimal(0)) - c * a / e


@_money
def price(settlement, maturity, coupon, yld, redemption, freq, basis=0):
    return _price(settlement, maturity, coupon, yld, redemption, int(freq), int(basis))


@_money
def bond_yield(settlement, maturity, coupon, pr, redemption, freq, basis=0, guess=Decimal("0.05")):
    return _solve(lambda y: _price(settlement, maturity, coupon, y, redemption, int(freq), int(basis)) - pr, guess)


def _duration(settlement, maturity, coupon, yld, freq, basis):
    e, _, dsc, n = _coupon_period(settlement, maturity, freq, basis)
    c, y, first = 100 * coupon / freq, yld / freq, dsc / e
    parts = [((k + first) / freq, (c + (100 if k == n - 1 else 0)) / (1 + y) ** (k + first)) for k in range(n)]
    return sum((t * v for t, v in parts), Decimal(0)) / sum((v for _, v in parts), Decimal(0))


@_money
def duration(settlement, maturity, coupon, yld, freq, basis=0):
    return _duration(settlement, maturity, coupon, yld, int(freq), int(basis))


@_money
def modified_duration(settlement, maturity, coupon, yld, freq, basis=0):
    return _duration(settlement, maturity, coupon, yld, int(freq), int(basis)) / (1 + yld / freq)


@_money
def accrued_interest(issue, first_interest, settlement, rate, par, freq, basis=0, from_issue=True):
    start = issue if from_issue or settlement <= first_interest else first_interest
    year = Decimal({0: 360, 1: 0, 2: 360, 3: 365, 4: 360}[int(basis)]) or Decimal((dt.date(start.year + 1, start.month, min(start.day, 28)) - dt.date(start.year, start.month, min(start.day, 28))).days)
    return par * rate * Decimal(days_between(start, settlement, int(basis))) / year


def _bill_days(settlement, maturity):
    days = (maturity - settlement).days
    if not 0 < days <= 366:
        raise ValueError("a bill runs for a year at most")
    return Decimal(days)


@_money
def tbill_eq(settlement, maturity, discount):
    d = _bill_days(settlement, maturity)
    if d <= 182:
        return 365 * discount / (360 - discount * d)
    p, t = 1 - discount * d / 360, d / Decimal(366 if d == 366 else 365)
    return (-2 * t + 2 * (t * t - (2 * t - 1) * (1 - 1 / p)).sqrt()) / (2 * t - 1)


@_money
def tbill_price(settlement, maturity, discount):
    return 100 * (1 - discount * _bill_days(settlement, maturity) / 360)


@_money
def tbill_yield(settlement, maturity, pr):
    return (100 - pr) / pr * 360 / _bill_days(settlement, maturity)


# Over tables.


def per_row(df: DataFrame, name: str, f: Callable, columns: Sequence[str], *rest, **kw) -> DataFrame:
    """A decimal column of ``f`` over the given columns, then constants; null where a cell is missing or the function fails."""

    @F.pandas_udf("decimal(38,10)")
    def run(frame):
        import pandas as pd

        def one(values):
            try:
                return None if any(v is None or v != v for v in values) else f(*values, *rest, **kw)
            except (ArithmeticError, ValueError):
                return None

        return pd.Series([one(v) for v in frame.itertuples(index=False)], dtype=object)

    return df.withColumn(name, run(F.struct(*columns)))


# The closed forms as plain column expressions over doubles: they stay in generated code and need no Python worker.


def sln_column(cost: Column, salvage: Column, life: Column) -> Column:
    return (cost - salvage) / life


def syd_column(cost: Column, salvage: Column, life: Column, per: Column) -> Column:
    return (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1))


def _annuity_column(rate: Column, nper: Column) -> Column:
    return F.when(rate == 0, nper.cast("double")).otherwise((F.pow(1 + rate, nper) - 1) / rate)


def pmt_column(rate: Column, nper: Column, pv: Column, fv: Column | float = 0.0, timing: int = END) -> Column:
    return -(pv * F.pow(1 + rate, nper) + fv) / ((1 + rate * timing) * _annuity_column(rate, nper))


def pv_column(rate: Column, nper: Column, pmt: Column, fv: Column | float = 0.0, timing: int = END) -> Column:
    return -(pmt * (1 + rate * timing) * _annuity_column(rate, nper) + fv) / F.pow(1 + rate, nper)


def fv_column(rate: Column, nper: Column, pmt: Column, pv: Column | float = 0.0, timing: int = END) -> Column:
    return -(pmt * (1 + rate * timing) * _annuity_column(rate, nper) + F.pow(1 + rate, nper) * pv)


def nper_column(rate: Column, pmt: Column, pv: Column, fv: Column | float = 0.0, timing: int = END) -> Column:
    p = pmt * (1 + rate * timing) / rate
    return F.when(rate == 0, -(pv + fv) / pmt).otherwise(F.log((p - fv) / (p + pv)) / F.log1p(rate))


def ipmt_column(rate: Column, per: Column, nper: Column, pv: Column) -> Column:
    """Interest of a period of a loan paid at the ends of periods."""
    payment = pmt_column(rate, nper, pv)
    return -(pv * F.pow(1 + rate, per - 1) + payment * _annuity_column(rate, per - 1)) * rate


def ppmt_column(rate: Column, per: Column, nper: Column, pv: Column) -> Column:
    return pmt_column(rate, nper, pv) - ipmt_column(rate, per, nper, pv)


def effective_rate_column(nominal: Column, periods: Column) -> Column:
    return F.pow(1 + nominal / periods, periods) - 1


def nominal_rate_column(effective: Column, periods: Column) -> Column:
    return (F.pow(1 + effective, 1 / periods) - 1) * periods


def tbill_price_column(days: Column, discount: Column) -> Column:
    return 100 * (1 - discount * days / 360)


def tbill_yield_column(days: Column, price: Column) -> Column:
    return (100 - price) / price * 360 / days


def npv_by_group(df: DataFrame, rate: float, group: str, flow: str, period: str) -> DataFrame:
    """Present value of each group's flows, discounted by their period: a plain aggregate."""
    return df.groupBy(group).agg(F.sum(F.col(flow) / F.pow(F.lit(1.0 + rate), F.col(period))).alias("npv"))
