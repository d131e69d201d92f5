"""Check digits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """Luhn over decimal digits of any script; false for an empty or other string, null for null."""
    return F.call_function("luhn_check", digits)


def mod97(text: Column) -> Column:
    """Whether an upper-case account number of 15 characters or more leaves 1 modulo 97; null where it is not of that shape.

    Folded character by character: up to 68 digits do not fit any number type.
    """
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    rest = F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step)
    return F.when(text.rlike("^[A-Z0-9]{15,}$"), rest == 1)


def check_digits(country: Column, account: Column) -> Column:
    """The two check digits that make country + digits + account valid."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), "(?!^)(?!$)"), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, "(?!^)(?!$)"), lambda c: F.ascii(c) - 48)


def _weighted(digits: Column, weights: tuple[int, ...], term=lambda x: x) -> Column:
    return F.aggregate(F.zip_with(digits, F.array(*map(F.lit, weights)), lambda d, w: term(d * w)), F.lit(0), lambda s, x: s + x)


def nhs(digits: Column) -> Column:
    """British health service number: ten digits, the last one makes the sum weighted 10 to 1 divisible by 11."""
    return digits.rlike("^[0-9]{10}$") & (_weighted(_digits(digits), tuple(range(10, 0, -1))) % 11 == 0)


def pension(number: Column) -> Column:
    """German pension insurance number: area, date of birth, letter as its number in two digits, serial, and the sum of the weighted digits' own digits modulo 10."""
    letter = F.lpad((F.ascii(F.substring(number, 9, 1)) - 64).cast("string"), 2, "0")
    body = F.concat(F.substring(number, 1, 8), letter, F.substring(number, 10, 2))
    total = _weighted(_digits(body), (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1), lambda x: F.floor(x / 10).cast("int") + x % 10)
    return F.when(number.rlike("^[0-9]{8}[A-Z][0-9]{3}$"), total % 10 == F.ascii(F.substring(number, 12, 1)) - 48).otherwise(False)


def mod11_10(digits: Column) -> Column:
    """ISO 7064 MOD 11,10 over 11 digits (German tax id): also some digit of the first ten repeats, not more than three times."""

    def step(p: Column, c: Column) -> Column:
        s = (F.ascii(c) - 48 + p) % 10
        return (F.when(s == 0, 10).otherwise(s) * 2) % 11

    body = F.split(F.substring(digits, 1, 10), "(?!^)(?!$)")
    check = (11 - F.aggregate(body, F.lit(10), step)) % 10
    counts = F.transform(F.array_distinct(body), lambda d: F.size(F.filter(body, lambda x: x == d)))
    fine = (F.array_max(counts) >= 2) & (F.array_max(counts) <= 3)
    return F.coalesce(F.when(digits.rlike("^[1-9][0-9]{10}$"), fine & (check == F.ascii(F.substring(digits, 11, 1)) - 48)), F.lit(False))
