"""Dates in free text.

A value is matched against an ordered list of shapes and rewritten as year-month-day, which
Spark's own cast then checks. All of it is column expressions. The first test takes the ISO
form, so that ordinary data needs one match and one cast; nothing relies on caught exceptions
(a list of ``to_timestamp`` formats raises one inside the JVM for each format that fails).

Results are TIMESTAMP_NTZ: the session time zone has no say in them.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prepared import Prepared

# The texts that mean "no date" and "the time of the run".
NO_DATE = ("NaT", "nat", "NAT", "nan", "NaN", "NAN")
RUN_TIME = ("now", "today")

# First and last moment a date may name.
EARLIEST = "1677-09-21 00:12:43.145225"
LATEST = "2262-04-11 23:47:16.854775"

_ISO = r"^\d{4}-\d{2}-\d{2}$"
_SEP = r"(?: ?[/.] ?|-| )"
_M, _D2, _Y4 = r"(0?[1-9]|1[0-2])", r"(\d{1,2})", r"(\d{4})"
_DAY_OVER_12 = r"(1[3-9]|2\d|3[01])"
_YEAR_OVER_31 = r"(3[2-9]|[4-9]\d)"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
_TH = r"(?:st|nd|rd|th)?"
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)(?:day|s|sday|nesday|rs|rsday|urday)?[,.]? +"

# Shape -> year-month-day. A short year, a month name or a quarter is resolved afterwards. The
# mark in front keeps what one shape has rewritten from every later one.
_SHAPES = (
    (r"^(\d{2})(\d{2})(\d{2})$", "$1-$2-$3"),
    (rf"^{_M}{_SEP}{_D2}{_SEP}(\d{{4}}|\d{{1,2}})$", "=$3-$1-$2"),
    (rf"^{_DAY_OVER_12}{_SEP}{_M}{_SEP}(\d{{4}}|\d{{1,2}})$", "=$3-$2-$1"),
    (rf"^{_YEAR_OVER_31}{_SEP}{_M}{_SEP}{_D2}$", "=$1-$2-$3"),
    (rf"^{_Y4}{_SEP}{_D2}{_SEP}{_D2}$", "=$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "=$1-$2-$3"),
    (rf"^{_D2}{_TH}[-/ .,]*{_MONTH}[-/ .,]*(\d{{4}}|\d{{2}})$", "=$3-$2-$1"),
    (rf"^{_MONTH}[-/ ]*{_D2}{_TH}(?:,? +|,|[-/])(\d{{4}}|\d{{2}})$", "=$3-$1-$2"),
    (rf"^{_Y4}[-/ .]+{_MONTH}(?:[-/ .]+{_D2})?$", "=$1-$2-$3"),
    (rf"^{_MONTH}[-/ .]*{_Y4}$", "=$2-$1-"),
    (r"^(\d{4})(?:[-/.](\d{1,2}))?$", "=$1-$2-"),
    (rf"^{_D2}[-/]{_Y4}$", "=$2-$1-"),
    (r"^(\d{4})-?(q[1-4])$", "=$1-$2-"),
    (r"^(\d{2})(q[1-4])$", "=20$1-$2-"),
    (r"^([1-4])q-?(\d{4})$", "=$2-q$1-"),
    (r"^([1-4])q(\d{2})$", "=20$2-q$1-"),
)

# Times written without a colon get one first.
_BARE_TIMES = (
    (r"^(\d{8})[t ](\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4"),
    (r"^(\d{8})[t ](\d{2})(\d{2})$", "$1 $2:$3"),
    (r"^(\d{4}-\d{2}-\d{2})[t ](\d{2})$", "$1 $2:00"),
    (r"(\d)[t ] *(\d{1,2}) ?([ap]m)$", "$1 $2:00$3"),
)
# Groups: time of day, am or pm, zone. Digits past the microsecond are left out.
_CLOCK = (
    r"(?<=\d)(?:t|\s+)(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?)\d{0,3}"
    r"\s*([ap]m)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?$"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"




def _century(written: Column, year: Column, as_of: datetime) -> Column:
    """What to add to a year of one or two digits: the century that puts it within 50 years of the run."""
    now = as_of.year // 100 * 100
    return (
        F.when(F.length(written) > 3, 0)
        .when(year + now >= as_of.year + 50, now - 100)
        .when(year + now < as_of.year - 50, now + 100)
        .otherwise(now)
    )


def _month_number(month: Column) -> Column:
    named = (F.instr(F.lit(_MONTHS), F.substring(month, 1, 3)) + 2) / 3
    return (
        F.when(month == "", 1)
        .when(month.rlike(r"^\d"), month.try_cast("int"))
        .when(month.startswith("q"), F.substring(month, 2, 1).try_cast("int") * 3 - 2)
        .otherwise(named.cast("int"))
    )


def _in_order(text: Column) -> Column:
    """Year-month-day of a lower-case date in any listed shape, else the text as it is.

    Shapes with a month name or a quarter fit only texts with a letter, the others only texts without one, and neither
    leaves what the other kind would rewrite. So a text is matched against the shapes of its kind.
    """
    lettered = [s for s in _SHAPES if _MONTH in s[0] or "q" in s[0]]
    kinds = [reduce(lambda out, s: F.regexp_replace(out, *s), shapes, text) for shapes in (lettered, [s for s in _SHAPES if s not in lettered])]
    return F.when(text.rlike("[a-z]"), kinds[0]).otherwise(kinds[1])


def _with_colons(text: Column) -> Column:
    for bare, order in _BARE_TIMES:
        text = F.regexp_replace(text, bare, order)
    return text


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC, 0 for text without digits."""
    digits = F.regexp_replace(zone, "[+:-]", "").try_cast("int")
    minutes = F.floor(digits / 100) * 60 + digits % 100
    return F.when(zone.startswith("-"), -minutes).otherwise(F.coalesce(minutes, F.lit(0))).cast("int")


def date_steps(
    source: str, clean: str, as_of: datetime, earliest: str = EARLIEST, latest: str = LATEST,
) -> tuple[Prepared, ...]:
    """Steps from a stripped value (column ``clean``) to ``_moment_*`` and ``_zone_*``.

    ``_moment_*`` is the parsed date and time (shifted to UTC where the text gave an offset) or
    null, ``_zone_*`` the offset's text. Each step is one projection, so a text is matched once
    however many rules use the date. For ISO dates the steps in between are null.
    """
    text, parts, clock, half, zone, year, written, moment = (
        f"_{part}_{source}" for part in ("text", "parts", "clock", "half", "zone", "year", "written", "moment"))
    c = F.col

    def of_clock(group: int) -> Column:
        # no time of day is without a colon
        return F.when(F.contains(c(text), F.lit(":")), F.regexp_extract(c(text), _CLOCK, group)).when(c(text).isNotNull(), "")

    def without_clock() -> Column:
        return F.when(F.contains(c(text), F.lit(":")), F.regexp_replace(c(text), _CLOCK, "")).otherwise(c(text))

    def day_of() -> Column:
        short, month, number = (F.get(c(parts), F.lit(i)) for i in range(3))
        return F.concat_ws(
            "-", c(year) + _century(short, c(year), as_of), _month_number(month), F.when(number == "", "1").otherwise(number))

    def moment_of() -> Column:
        hour = F.hour(written)
        hours = (
            F.when(c(half) == "", 0).when(hour > 12, None)
            .when((c(half) == "pm") & (hour < 12), 12).when((c(half) == "am") & (hour == 12), -12).otherwise(0))
        shift = F.make_dt_interval(hours=hours, mins=-_offset_minutes(c(zone)))
        low, high = (F.lit(b).cast("timestamp_ntz") for b in (earliest, latest))
        # ISO dates sort as text, so theirs are compared before the cast
        return (
            F.when(c(text).isNull(), F.when(
                (c(clean) >= earliest) & (c(clean) <= latest), c(clean).try_cast("timestamp_ntz")))
            .when(c(clean).isin(*RUN_TIME), F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
            .when(c(written).between(low, high), c(written) + shift)
        )

    return (
        Prepared(text, (clean,), lambda: F.when(~c(clean).rlike(_ISO), _with_colons(F.lower(c(clean))))),
        Prepared(parts, (text,), lambda: F.split(_in_order(
            F.regexp_replace(without_clock(), _WEEKDAY, "")), "-")),
        Prepared(clock, (text,), lambda: of_clock(1)),
        Prepared(half, (text,), lambda: of_clock(2)),
        # "gmt" is read as no zone at all
        Prepared(zone, (text,), lambda: F.nullif(F.replace(
            of_clock(3), F.lit("gmt"), F.lit("")), F.lit(""))),
        Prepared(year, (parts,), lambda: F.regexp_extract(F.get(c(parts), F.lit(0)), r"^=(\d+)$", 1).try_cast("int")),
        Prepared(written, (parts, clock, year), lambda: F.when(
            c(year).isNotNull(), F.concat_ws(" ", day_of(), F.nullif(c(clock), F.lit("")))).try_cast("timestamp_ntz")),
        Prepared(moment, (clean, text, written, half, zone), moment_of),
    )


def is_undated(clean: Column, moment: Column) -> Column:
    """True for text that is no date. Blanks and the texts for "no date" are no failure."""
    return moment.isNull() & (clean != "") & ~clean.isin(*NO_DATE)
