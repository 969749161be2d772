"""Helpers on single values: what is a number, order across kinds, exact powers and roots."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable
from fractions import Fraction
from functools import cmp_to_key

from millrace.functions.formula import letter_to_number, number_to_letter


def is_numeric(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def to_float(v) -> float | None:
    return float(v) if is_numeric(v) else None


def floats(values: Iterable) -> list[float]:
    """As floats; what is no number counts as 0."""
    return [float(v) if is_numeric(v) else 0.0 for v in values]


def column_number(letters: str) -> int | None:
    return letter_to_number(letters) if letters.isalpha() and letters.isascii() else None


def column_letters(number: int) -> str | None:
    return number_to_letter(number) if number >= 0 else None


def rank_of_kind(v) -> int:
    """Nothing, truth values, numbers, text, times, anything else."""
    return 0 if v is None else 1 if isinstance(v, bool) else 2 if is_numeric(v) else 3 if isinstance(v, str) else 4 if isinstance(v, (dt.date, dt.datetime)) else 5


def compare(a, b) -> int:
    """Order of two cells: by kind, then by value; NaN above all numbers."""
    x, y = rank_of_kind(a), rank_of_kind(b)
    if x != y:
        return -1 if x < y else 1
    if x == 0:
        return 0
    if x == 2:
        na, nb = math.isnan(a), math.isnan(b)
        if na or nb:
            return na - nb
    a, b = (str(a), str(b)) if x in (1, 5) else (a, b)
    return (a > b) - (a < b)


def sort_mixed(values: Iterable, ascending: bool = True) -> list:
    """A stable sort of cells of any kind."""
    return sorted(values, key=cmp_to_key(compare if ascending else lambda a, b: compare(b, a)))


def power(base: Fraction | int | str, n: int) -> Fraction:
    return Fraction(base) ** n


def square_root(x: Fraction | int | str, digits: int = 50) -> Fraction:
    """The root as a fraction, right to so many digits."""
    f = Fraction(x)
    if f < 0:
        raise ValueError("root of a negative number")
    scale = 10 ** (2 * digits)
    return Fraction(math.isqrt(f.numerator * scale // f.denominator), 10**digits)


class BiIndex:
    """Names and places, looked up either way; a name that is taken again moves to the new place."""

    def __init__(self, names: Iterable[str] = ()):
        self.place_of: dict[str, int] = {}
        self.name_of: dict[int, str] = {}
        for i, n in enumerate(names):
            self.set(i, n)

    def set(self, place: int, name: str) -> None:
        self.name_of.pop(self.place_of.get(name, -1), None)
        self.place_of.pop(self.name_of.get(place, ""), None)
        self.place_of[name], self.name_of[place] = place, name

    def place(self, name: str) -> int | None:
        return self.place_of.get(name)

    def name(self, place: int) -> str | None:
        return self.name_of.get(place)

    def __len__(self) -> int:
        return len(self.place_of)
