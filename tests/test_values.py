import datetime as dt
from fractions import Fraction

from millrace.functions import values as v


def test_values():
    assert v.sort_mixed(["b", 2, None, True, float("nan"), 1.5, dt.date(2024, 1, 1), "a"])[:4] == [None, True, 1.5, 2]
    assert [str(x) for x in v.sort_mixed([1, None, 2], ascending=False)] == ["2", "1", "None"]
    assert v.floats([1, "2", None, True, 2.5]) == [1, 0, 0, 0, 2.5] and v.to_float("1") is None
    assert v.column_number("ab") == 27 and v.column_number("1") is None and v.column_letters(27) == "AB" and v.column_letters(-1) is None
    assert v.power("1/2", 3) == Fraction(1, 8) and abs(v.square_root(2, 30) ** 2 - 2) < Fraction(1, 10**28)
