"""Check digit of nine-character security identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shares(factor: int) -> list[int | None]:
    """What a character adds to the total, by its ASCII code: a digit counts as itself, A..Z as
    10..35, times the factor of its position; the decimal digits of that are added up."""
    values = {ord(c): i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    return [
        sum(divmod(values[code] * factor, 10)) if code in values else None
        for code in range(max(values) + 1)
    ]


def check_digit(body: Column) -> Column:
    """Digit (as text) that completes an upper-case body of eight letters and digits.

    One table lookup per position; every second character is doubled. Written out per position,
    so that it stays in generated code (a higher-order function would be interpreted).
    """
    tables = [F.lit(_shares(1)), F.lit(_shares(2))]
    total = reduce(lambda a, b: a + b, [
        F.get(tables[p % 2], F.ascii(F.substring(body, p + 1, 1))) for p in range(8)])
    return ((10 - total % 10) % 10).cast("string")
