"""Text helpers: stripping, blanks, quoting and message templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fields of a CSV file that stand for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(value: Column) -> Column:
    """Value without white space at both ends (``trim`` alone removes only U+0020).

    A value that starts and ends with a printable ASCII character is taken as it is; the search
    for the whole set of spaces costs about ten times as much.
    """
    plain = F.ascii(value).between(33, 126) & F.ascii(F.substring(value, -1, 1)).between(33, 126)
    return F.when(plain, value).otherwise(F.btrim(value, F.lit(WHITESPACE)))


def blank_tokens_to_null(value: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~value.isin(*tokens), value)


def quoted(value: Column) -> Column:
    """Value in quotes, with double quotes where it holds a single one.

    White space other than U+0020 is written as an escape.
    """
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    body = plain
    for raw in WHITESPACE.replace(" ", ""):
        body = F.replace(body, F.lit(raw), F.lit(ascii(raw)[1:-1]))
    body = F.when(F.rlike(value, F.lit(f"[{WHITESPACE.replace(' ', '')}]")), body).otherwise(plain)
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    return (
        F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )


def fill(template: str, **fields: Column) -> Column:
    """A message: the template with each ``{name}`` replaced by that column."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)
