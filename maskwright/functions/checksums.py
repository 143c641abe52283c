"""Checksum and format gates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    d = digits(text)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _dihedral() -> list[list[int]]:
    """Multiplication in the dihedral group of order ten: 0-4 are rotations, 5-9 reflections."""
    return [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]


def _permutations() -> list[list[int]]:
    """Powers of the position permutation."""
    one = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([one[v] for v in rows[-1]])
    return rows


def verhoeff(text: Column) -> Column:
    """Twelve digits, the first not 0 or 1, with a valid Verhoeff check digit."""
    d = digits(text)
    table = F.array(*[F.lit(v) for row in _dihedral() for v in row])
    turn = F.array(*[F.lit(v) for row in _permutations() for v in row])
    digit = lambda i: F.coalesce(F.substring(d, F.lit(12) - i, F.lit(1)).try_cast("int"), F.lit(0))
    check = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: F.get(table, c * 10 + F.get(turn, (i % 8) * 10 + digit(i))))
    return d.rlike("^[2-9][0-9]{11}$") & (check == 0)


#: Holder types, the fourth letter of a PAN.
PAN_HOLDERS = "ABCFGHLJPTK"


def pan_valid(text: Column) -> Column:
    return text.rlike(f"^[A-Z]{{3}}[{PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$")


def ifsc_valid(text: Column) -> Column:
    return text.rlike("^[A-Z]{4}0[A-Z0-9]{6}$")


def indian_mobile(text: Column) -> Column:
    d = digits(text)
    return F.when((F.length(d) > 10) & F.startswith(d, F.lit("91")), F.substring(d, 3, 40)).otherwise(d).rlike("^[6-9][0-9]{9}$")
