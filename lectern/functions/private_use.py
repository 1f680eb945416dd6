"""Circled numbers that a typesetting system spells with private-use characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Private planes; places in a plane of the leading mark and of the digits; most digits; layout leftovers (a pair, then fillers).
PLANES = (0xF0000, 0x100000)
MARK, DIGITS, BY_LENGTH, BY_PLACE, MOST = 0xCA, 0x48, 0x46, 0x0A, 4
LEFTOVERS, FILLER = ((0xB64, 0xB65), (0xB60, 0xB61)), 0xA81
_OPEN, _SHUT = "\u0001", "\u0002"


def _digit(n: int, place: int, digit: int) -> int:
    """The place of a digit in a number of n digits; it tells length, place and digit."""
    return DIGITS + (n - 2) * BY_LENGTH + place * BY_PLACE + digit


def _any(*places: int) -> str:
    return "[" + "".join(chr(plane + p) for p in places for plane in PLANES) + "]"


def _shown(number: Column, bracket: bool) -> Column:
    """A circled character up to 50, else the number in brackets."""
    n = number.cast("int")
    circled = F.get(F.array(*(F.lit(chr(c)) for c in (*range(0x2460, 0x2474), *range(0x3251, 0x3260), *range(0x32B1, 0x32C0)))), n - 1)
    bracketed = F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    return bracketed if bracket else F.when(n <= 50, circled).otherwise(bracketed)


def decoded(text: Column, bracket: bool = False) -> Column:
    """The text with its private-use numbers as circled characters or in brackets, and without layout leftovers. No number starts with 0."""
    text = F.regexp_replace(text, "(?:" + "|".join(_any(a) + _any(b) for a, b in LEFTOVERS) + f"){_any(FILLER)}+", "")
    for n in range(MOST, 0, -1):
        digits = "".join(_any(*(_digit(n, p, d) for d in range(1 if p == 0 else 0, 10))) for p in range(n))
        text = F.regexp_replace(text, f"{_any(MARK)}({digits})", f"{_OPEN}$1{_SHUT}")
    coded = [(chr(plane + _digit(n, p, d)), str(d)) for plane in PLANES for n in range(1, MOST + 1) for p in range(n) for d in range(10)]
    plain = lambda x: F.translate(x, "".join(a for a, _ in coded), "".join(b for _, b in coded))
    piece = lambda x: F.concat(_shown(plain(F.substring_index(x, _SHUT, 1)), bracket), F.substring_index(x, _SHUT, -1))
    return bound(F.split(text, _OPEN), lambda xs: F.array_join(F.transform(xs, lambda x, i: F.when(i == 0, x).otherwise(piece(x))), ""))


def encoded(number: Column, plane: int = PLANES[1]) -> Column:
    """The private-use spelling of 1 to 9999; null for other numbers."""
    digits = number.cast("int").cast("string")
    of = lambda n, p: F.translate(F.substring(digits, p + 1, 1), "0123456789", "".join(chr(plane + _digit(n, p, d)) for d in range(10)))
    spelled = F.coalesce(*(F.when(F.length(digits) == n, F.concat(F.lit(chr(plane + MARK)), *(of(n, p) for p in range(n)))) for n in range(1, MOST + 1)))
    return F.when(number.between(1, 9999), spelled)
