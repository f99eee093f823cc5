"""Numbers in text: parsing on entry, printing in messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Spark's cast alone takes "5d" and "0x1p3" and refuses "1_000", so the text is matched first.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (
    rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"
)
_NOT_A_NUMBER = r"^[+-]?[nN][aA][nN]$"


def number_text(value: Column, symbols: str) -> Column:
    """Value with the given currency or percent symbols taken out."""
    return strip(F.translate(value, symbols, ""))


def parse_number(text: Column) -> Column:
    """Double, or null where the text is no number. NaN is null too: no bound applies to it."""
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def is_not_number(text: Column, parsed: Column) -> Column:
    """True where the text failed to parse; the text "nan" did parse."""
    return parsed.isNull() & ~text.rlike(_NOT_A_NUMBER)


def float_text(value: Column) -> Column:
    """Shortest decimal form, plain from 1e-4 up to 1e16 and with an exponent outside."""
    java = value.cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.regexp_replace(F.substring_index(java, "E", 1), r"[-.]|\.?0+$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    rest = F.substring(digits, exponent + 2, F.length(digits))
    tail = F.substring(digits, F.lit(2), F.length(digits))
    return (
        F.when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf")))
        .when(~F.contains(java, F.lit("E")), java)
        .when(exponent.between(0, 15),
              F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest)))
        .when(exponent == -4, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.concat(
            sign, F.substring(digits, 1, 1),
            F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)),
            F.when(exponent < 0, "e-").otherwise("e+"),
            F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"),
        ))
    )


def two_decimals(value: Column) -> Column:
    """Rounded to two decimals by the exact binary value, ties to even.

    ``bround`` goes by the shortest decimal text, in which 2.675 looks like a tie though it lies
    below one. Here the value is split into two parts whose products with 100 are exact, so the
    distance from the tie has the right sign.
    """
    size = F.abs(value)
    scaled = size * float((1 << 27) + 1)
    high = scaled - (scaled - size)
    whole = F.floor(size * 100).cast("double")
    over = (high * 100 - (whole + 0.5)) + (size - high) * 100
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    rounded = F.signum(value) * (whole + F.when(up, 1.0).otherwise(0.0)) / 100
    # from here on, neighbouring values lie further apart than 0.01
    return F.when(size < float(1 << 46), rounded).otherwise(F.bround(value, 2))


def money_text(value: Column) -> Column:
    """Two decimals with thousands separators."""
    infinite = F.abs(value) == float("inf")
    return (
        F.when(infinite & (value < 0), "-inf").when(infinite, "inf")
        .otherwise(F.format_string("%,.2f", two_decimals(value)))
    )


def percent_text(ratio: Column) -> Column:
    """Whole percent, ties to even."""
    return F.format_string("%d%%", F.bround(ratio * 100).cast("long"))
