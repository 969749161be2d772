import datetime as dt
from decimal import Decimal as Dc

import pytest

from millrace.functions import finance as f
from millrace.operators import marketing


def near(value, want, digits=6):
    return abs(Dc(str(value)) - Dc(str(want))) < Dc(10) ** -digits


def test_time_value():
    p = f.pmt("0.005", 360, 100000)
    assert near(p, "-599.5505251527") and f.pmt("0.005", 360, 100000, scale=20).as_tuple().exponent == -20
    assert near(f.pv("0.005", 360, p), 100000) and near(f.fv("0.005", 360, p, 100000), 0, 4) and near(f.nper("0.005", p, 100000), 360) and near(f.rate(360, p, 100000), "0.005", 9)
    assert near(f.pmt(0, 10, 1000), -100) and near(f.pmt("0.01", 12, 1000, 0, f.BEGIN), Dc("-87.9690"), 3)
    assert near(f.ipmt("0.005", 1, 360, 100000), -500) and near(f.ppmt("0.005", 1, 360, 100000), "-99.5505251527")
    assert near(f.cum_ipmt("0.005", 360, 100000, 1, 12) + f.cum_ppmt("0.005", 360, 100000, 1, 12), p * 12, 4)
    rows = f.amortization_schedule("0.01", 12, 1000)
    assert len(rows) == 12 and near(rows[-1][4], 0, 6) and near(sum(r[3] for r in rows), -1000, 6)
    for k in (1, 2, 5):
        for t in (f.END, f.BEGIN):
            assert near(f.ipmt("0.02", k, 6, 500, 0, t) + f.ppmt("0.02", k, 6, 500, 0, t), f.pmt("0.02", 6, 500, 0, t), 8)


def test_cash_flows():
    flows = [-100, 39, 59, 55, 20]
    assert near(f.irr(flows), "0.2809484211", 8) and near(f.npv(f.irr(flows, scale=20), flows), 0, 6)
    assert near(f.npv_excel("0.1", [-10000, 3000, 4200, 6800]), "1188.4434123352")
    assert near(f.mirr([-120000, 39000, 30000, 21000, 37000, 46000], "0.10", "0.12"), "0.1260941303", 8)
    days = [dt.date(2008, 1, 1), dt.date(2008, 3, 1), dt.date(2008, 10, 30), dt.date(2009, 2, 15), dt.date(2009, 4, 1)]
    values = [-10000, 2750, 4250, 3250, 2750]
    assert near(f.xirr(values, days), "0.3733625335", 6) and near(f.xnpv("0.09", values, days), "2086.6476020315", 5)
    with pytest.raises(ValueError):
        f.irr([1, 2])


def test_rates_and_depreciation():
    assert near(f.effective_rate("0.0525", 4), "0.0535426673") and near(f.nominal_rate("0.053543", 4), "0.0525003199", 8)
    assert near(f.annual_from_continuous(f.continuous_from_annual("0.07", scale=20)), "0.07", 9)
    assert f.sln(30000, 7500, 10) == 2250 and near(f.syd(30000, 7500, 10, 1), "4090.9090909091") and near(f.ddb(2400, 300, 10, 1), 480) and near(f.ddb(2400, 300, 10, 10), "22.1225472", 6)
    assert near(f.vdb(2400, 300, 10, 0, 1), 480) and near(f.vdb(2400, 300, 10, 0, 10), 2100)


def test_bonds_and_bills():
    s, m = dt.date(2008, 2, 15), dt.date(2017, 11, 15)
    assert near(f.price(s, m, "0.0575", "0.065", 100, 2, 0), "94.6343616", 5)
    assert near(f.bond_yield(s, dt.date(2016, 11, 15), "0.0575", "95.04287", 100, 2, 0), "0.065", 5)
    assert near(f.duration(dt.date(2018, 7, 1), dt.date(2048, 1, 1), "0.08", "0.09", 2, 1), "10.9191453", 5)
    assert near(f.modified_duration(dt.date(2008, 1, 1), dt.date(2016, 1, 1), "0.08", "0.09", 2, 1), "5.7356698", 5)
    assert near(f.accrued_interest(dt.date(2008, 3, 1), dt.date(2008, 8, 31), dt.date(2008, 5, 1), "0.1", 1000, 2, 0), "16.666667", 5)
    a, b = dt.date(2008, 3, 31), dt.date(2008, 6, 1)
    assert near(f.tbill_eq(a, b, "0.0914"), "0.0941514935", 8) and near(f.tbill_price(a, b, "0.09"), "98.45", 8) and near(f.tbill_yield(a, b, "98.45"), "0.0914169629", 8)
    assert f.days_360(dt.date(2024, 1, 31), dt.date(2024, 3, 31)) == 60 and f.days_360(dt.date(2024, 2, 29), dt.date(2024, 3, 31)) == 30


def test_over_columns(spark):
    df = spark.createDataFrame([(0.005, 360, 100000.0), (0.0, 0, 1.0), (None, 1, 1.0)], "r double, n int, v double")
    got = [r.p for r in f.per_row(df, "p", f.pmt, ["r", "n", "v"]).collect()]
    assert near(got[0], "-599.5505251527") and got[1] is None and got[2] is None


def test_rfm(spark):
    df = spark.createDataFrame([("C1", "2023-01-01", 10.0), ("C1", "2023-01-05", 20.0), ("C2", "2023-01-10", 30.0), ("C2", "2023-01-15", 40.0), ("C2", "2023-01-20", 50.0), ("C3", "not a day", 1.0)], "c string, d string, a double")
    got = {r.customer: r for r in marketing.rfm(df, "c", "d", "a", "2023-02-01", 2).collect()}
    assert set(got) == {"C1", "C2"} and got["C2"].rfm_score == 6 and got["C1"].rfm_score == 3
    with pytest.raises(ValueError):
        marketing.rfm(df, "c", "d", "a", "2023-02-01", 1)


def test_basket(spark):
    df = spark.createDataFrame([(o, p) for o, ps in (("O1", "ABC"), ("O2", "AB"), ("O3", "AC"), ("O4", "BC"), ("O5", "A")) for p in ps] + [("O1", "A"), (None, "A"), ("O9", "")], "o string, p string")
    got = {(r.item_a, r.item_b): r for r in marketing.basket(df, "o", "p").collect()}
    assert got["A", "B"].support == pytest.approx(0.4) and got["A", "B"].confidence == pytest.approx(0.5) and got["A", "B"].lift == pytest.approx(0.4 / (0.8 * 0.6)) and len(got) == 9
    with pytest.raises(ValueError):
        marketing.basket(df, "o", "p", max_items=2)


def test_activity_index(spark):
    df = spark.createDataFrame([("a", f"2024-01-{d:02d}") for d in (1, 3, 6, 10)] + [("b", "2024-01-20"), ("b", "2024-01-21"), ("b", "2024-01-30"), ("c", "2024-03-01")], "c string, d string")
    got = {r.customer: r for r in marketing.customer_activity_index(df, "c", "d").collect()}
    gaps = [2, 3, 4, 20]
    assert set(got) == {"a", "b"} and got["a"].mle == sum(gaps) / 4 and got["a"].wmle == sum(g * (i + 1) for i, g in enumerate(gaps)) / 10
