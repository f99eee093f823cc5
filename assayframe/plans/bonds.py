"""The rule pack for tables of municipal and similar bonds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import EARLIEST, LATEST, date_steps, is_undated
from ..functions.identifiers import check_digit
from ..functions.numbers import float_text, is_not_number, money_text, number_text, parse_number
from ..functions.prepared import Prepared
from ..functions.text import fill, quoted, strip
from ..operators import table_rules
from .pack import ERROR, INFO, WARNING, RowRule, RulePack, TableRule

# Columns, checks in reporting order, code lists, limits per type, state names,
# patterns and message texts. Results depend on them to the letter.

REQUIRED_COLUMNS = (
    "cusip", "issuer_name", "state", "issue_date", "maturity_date", "par_value", "coupon_rate", "bond_type",
)

CHECKS = (
    "required_columns", "missing_values", "cusip_format", "duplicate_cusips", "date_validity",
    "numeric_ranges", "state_codes", "bond_type", "issuer_name_quality", "cusip_check_digit",
    "cusip_issuer_structure", "coupon_bond_type_consistency", "maturity_term_limits",
    "par_value_by_bond_type", "data_patterns", "copy_paste_errors", "issuer_state_consistency",
)

STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS",
    "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY",
    "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV",
    "WI", "WY", "DC", "PR", "GU", "VI", "AS",
)

BOND_TYPES = ("GO", "REV", "CD", "BAB", "IDR", "TAN", "BAN", "RAN", "TRAN", "COPS", "HFA", "OTHER")

COUPON_RANGES = {
    "GO": (0.0, 7.0), "REV": (0.0, 8.0), "BAB": (3.0, 10.0), "CD": (0.0, 6.0),
    "TAN": (0.0, 5.0), "BAN": (0.0, 5.0), "RAN": (0.0, 5.0), "TRAN": (0.0, 5.0),
}

# The key COPs never matches, because types are compared in upper case. That is kept.
MAX_TERM_YEARS = {
    "GO": 30, "REV": 40, "BAB": 35, "CD": 5, "TAN": 2, "BAN": 3, "RAN": 2, "TRAN": 2,
    "COPs": 30, "HFA": 40, "IDR": 35,
}

PAR_RANGES = {
    "GO": (1_000, 500_000_000), "REV": (1_000, 1_000_000_000), "TAN": (1_000, 100_000_000),
    "BAN": (1_000, 100_000_000), "RAN": (1_000, 100_000_000), "CD": (1_000, 50_000_000),
}

STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

MAX_PAR, MAX_COUPON, MAX_TERM, DAYS_PER_YEAR = 1e9, 15.0, 50.0, 365.25
MIN_NAME_LENGTH = 3
WHITESPACE_COLUMNS = ("issuer_name", "state", "bond_type", "cusip")
CONCENTRATION_COLUMNS = ("issuer_name", "par_value", "coupon_rate")

ID_FORMAT = r"^[A-Za-z0-9]{9}$"
ID_ALPHA_ISSUER = r"^[A-Z]{6}[A-Z0-9]{3}$"
ID_ZERO_ISSUE = r"^[A-Z0-9]{6}00[A-Z0-9]$"
ALL_DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]+$"
SPECIAL_CHARACTERS = r"[<>{}\\|~`\[\]^]"

MESSAGES = {
    "MISSING_COLUMN": "Required column '{column}' is missing from the dataset.",
    "MISSING_VALUE": "Required field '{column}' is empty.",
    "CUSIP_FORMAT": "Invalid CUSIP format: '{value}'. Expected 9 alphanumeric characters.",
    "CUSIP_CHECK_DIGIT": "CUSIP '{value}' has an invalid check digit. Expected '{expected}', got '{got}'. "
                         "Possible transposition or fabricated identifier.",
    "CUSIP_ISSUER_ANOMALY": "CUSIP '{value}': issuer code '{issuer}' is all-alphabetic. Public-sector CUSIPs "
                            "typically have numeric issuer codes. Verify the instrument classification.",
    "CUSIP_PLACEHOLDER": "CUSIP '{value}': issue ID '00' may indicate placeholder data.",
    "DUPLICATE_CUSIP": "Duplicate CUSIP '{value}' found.",
    "INVALID_DATE": "Cannot parse date value: '{value}'.",
    "FUTURE_ISSUE_DATE": "Issue date '{value}' is in the future.",
    "MATURITY_BEFORE_ISSUE": "Maturity date ({maturity}) is on or before issue date ({issue}).",
    "NEGATIVE_PAR_VALUE": "Par value must be positive, got {number}.",
    "UNUSUAL_PAR_VALUE": "Par value of {money} is unusually large — verify.",
    "NON_NUMERIC_PAR": "Par value '{value}' is not a valid number.",
    "NEGATIVE_COUPON": "Coupon rate cannot be negative: {number}%.",
    "HIGH_COUPON": "Coupon rate of {number}% seems unusually high — verify.",
    "NON_NUMERIC_COUPON": "Coupon rate '{value}' is not a valid number.",
    "INVALID_STATE": "'{value}' is not a valid US state/territory code.",
    "UNKNOWN_BOND_TYPE": "Instrument type '{value}' is not a recognized classification. Expected one of: {known}.",
    "SHORT_ISSUER_NAME": "Issuer name '{value}' is suspiciously short.",
    "NUMERIC_ISSUER_NAME": "Issuer name '{value}' appears to be purely numeric.",
    "COUPON_TYPE_MISMATCH high": "Coupon rate {number}% is unusually high for {type} instruments "
                                 "(expected {low}–{high}%). Verify rate or classification.",
    "COUPON_TYPE_MISMATCH low": "Coupon rate {number}% is below typical range for {type} instruments"
                                "(expected {low}–{high}%).",
    "EXCESSIVE_MATURITY_TERM": "{type} instrument has a {term}-year term, exceeding the typical max of {most} "
                               "years. Verify maturity date or instrument classification.",
    "EXTREME_MATURITY_TERM": "Maturity term of {term} years exceeds 50-year maximum. Likely a data entry error.",
    "PAR_TYPE_MISMATCH": "Par value ${money} is unusually high for {type} instruments(typical max ${bound}). "
                         "Verify amount or classification.",
    "PAR_BELOW_MINIMUM": "Par value ${money} is below typical minimum for {type} instruments(${bound}). "
                         "May indicate incorrect units (thousands vs actual).",
    "TRAILING_WHITESPACE": "Value in '{column}' has leading/trailing whitespace: '{shown}'.",
    "SPECIAL_CHARS_IN_NAME": "Issuer name contains suspicious characters: {found} in '{value}'.",
    "INCONSISTENT_CASING": "Issuer name has inconsistent casing: {variants}. Standardize to one form.",
    "DUPLICATE_ROW": "Row {row} is an exact duplicate of a previous row.",
    "COPY_PASTE_SUSPECTED": "Column '{column}' has {n}/{non_null} rows ({percent}) with value '{value}'. "
                            "Possible copy-paste or default-fill error.",
    "ISSUER_STATE_MISMATCH": "Issuer name '{value}' suggests {name} ({code}), but state column says '{stated}'. "
                             "Verify geographic data.",
}

# End of the fixed values.


def bond_pack(
    as_of: datetime | None = None, earliest: str = EARLIEST, latest: str = LATEST,
) -> RulePack:
    """All checks for bond tables. ``as_of`` is the moment dates are judged by (default: now)."""
    as_of = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    # built once per pack: each piece of an expression is a call into the JVM
    prepared = {
        p.name: replace(p, column=cache(p.column)) for p in _prepared(as_of, earliest, latest)}
    rules = (
        *_missing_rules(), *_identifier_rules(), *_date_rules(as_of), *_number_rules(), *_code_rules(),
        *_name_rules(), *_by_type_rules(), *_table_rules(),
    )
    rules = tuple(
        replace(r, fires=cache(r.fires), message=cache(r.message)) if isinstance(r, RowRule) else r for r in rules)
    return RulePack(REQUIRED_COLUMNS, CHECKS, rules, prepared)


def _clean(column: str) -> str:
    return f"_clean_{column}"


def _there(column: str) -> Column:
    """Not null and not blank."""
    return F.col(_clean(column)) != ""


def _limit(table: dict, key: Column, pick=lambda entry: entry) -> Column:
    """The limit for a type, null for a type without one: a map folded into the expression."""
    pairs = [F.lit(x) for name, entry in table.items() for x in (name, float(pick(entry)))]
    return F.try_element_at(F.create_map(*pairs), key)


def _low(entry: tuple) -> float:
    return entry[0]


def _high(entry: tuple) -> float:
    return entry[1]


def _prepared(as_of: datetime, earliest: str, latest: str) -> Iterable[Prepared]:
    """The columns that rules share, each worked out once per row."""
    c = F.col
    for column in REQUIRED_COLUMNS:
        yield Prepared(_clean(column), (column,), lambda column=column: strip(c(column)))
    for column in ("issue_date", "maturity_date"):
        yield from date_steps(column, _clean(column), as_of, earliest, latest)
    for column, symbols in (("par_value", ",$"), ("coupon_rate", "%")):
        text, number = f"_digits_{column}", f"_number_{column}"
        yield Prepared(text, (column,), lambda column=column, symbols=symbols: number_text(c(column), symbols))
        yield Prepared(number, (text,), lambda text=text: parse_number(c(text)))
    yield Prepared("_upper_cusip", (_clean("cusip"),), lambda: F.upper(_clean("cusip")))
    yield Prepared("_digit_cusip", ("_upper_cusip", _clean("cusip")), lambda: F.when(
        c(_clean("cusip")).rlike(ID_FORMAT), check_digit(c("_upper_cusip"))))
    yield Prepared("_code_state", (_clean("state"),), lambda: F.upper(_clean("state")))
    yield Prepared("_type", (_clean("bond_type"),), lambda: F.upper(_clean("bond_type")))
    yield Prepared("_lower_issuer_name", (_clean("issuer_name"),), lambda: F.lower(_clean("issuer_name")))
    yield Prepared("_named_state", ("_lower_issuer_name", "_code_state"), _named_state)


def _same_zone() -> Column:
    """A date with a UTC offset cannot be compared with one without."""
    return F.col("_zone_issue_date").isNull() == F.col("_zone_maturity_date").isNull()


def _term() -> Column:
    """Whole days from issue to maturity in years of 365.25 days."""
    days = F.extract(F.lit("DAY"), F.col("_moment_maturity_date") - F.col("_moment_issue_date"))
    return F.when(_same_zone(), days / F.lit(DAYS_PER_YEAR))


def _named_state() -> Column:
    """The first listed state whose name is part of the issuer's name while its code is not the stated one.

    One test per state, written out: as a lambda over the list it would be interpreted, which
    takes ten times as long.
    """
    name, stated = F.col("_lower_issuer_name"), F.col("_code_state")
    return F.coalesce(*[
        F.when(F.contains(name, F.lit(listed)) & (stated != code), F.lit(listed))
        for listed, code in STATE_NAMES.items()])


def _say(rule: str, **fields: Column):
    return lambda: fill(MESSAGES[rule], **fields)


def _missing_rules() -> Iterable[RowRule]:
    for column in REQUIRED_COLUMNS:
        yield RowRule(
            "missing_values", "MISSING_VALUE", ERROR, column, (_clean(column),),
            lambda column=column: F.coalesce(F.col(_clean(column)) == "", F.lit(True)),
            _say("MISSING_VALUE", column=F.lit(column)))


def _identifier_rules() -> Iterable[RowRule]:
    clean, upper, digit = F.col(_clean("cusip")), F.col("_upper_cusip"), F.col("_digit_cusip")
    last = F.substring(clean, 9, 1)
    yield RowRule(
        "cusip_format", "CUSIP_FORMAT", ERROR, "cusip", (_clean("cusip"), "_digit_cusip"),
        lambda: _there("cusip") & digit.isNull(), _say("CUSIP_FORMAT", value=clean))
    yield RowRule(
        "cusip_check_digit", "CUSIP_CHECK_DIGIT", ERROR, "cusip", (_clean("cusip"), "_digit_cusip"),
        lambda: digit != last, _say("CUSIP_CHECK_DIGIT", value=clean, expected=digit, got=last))
    yield RowRule(
        "cusip_issuer_structure", "CUSIP_ISSUER_ANOMALY", WARNING, "cusip", ("_upper_cusip",),
        lambda: (F.ascii(upper) >= ord("A")) & upper.rlike(ID_ALPHA_ISSUER),
        _say("CUSIP_ISSUER_ANOMALY", value=upper, issuer=F.substring(upper, 1, 6)))
    yield RowRule(
        "cusip_issuer_structure", "CUSIP_PLACEHOLDER", INFO, "cusip", ("_upper_cusip",),
        lambda: (F.substring(upper, 7, 2) == "00") & upper.rlike(ID_ZERO_ISSUE),
        _say("CUSIP_PLACEHOLDER", value=upper))


def _date_rules(as_of: datetime) -> Iterable[RowRule]:
    issue, maturity = F.col("_moment_issue_date"), F.col("_moment_maturity_date")
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    zoned = F.col("_zone_issue_date").isNotNull()
    parsed = {d: (d, _clean(d), f"_moment_{d}", f"_zone_{d}") for d in ("issue_date", "maturity_date")}
    undated = {d: is_undated(F.col(_clean(d)), F.col(f"_moment_{d}")) for d in parsed}
    # an issue date is compared with the clock, which fails for one with a UTC offset
    yield RowRule(
        "date_validity", "INVALID_DATE", ERROR, "issue_date", parsed["issue_date"],
        lambda: undated["issue_date"] | zoned, _say("INVALID_DATE", value=F.col("issue_date")))
    yield RowRule(
        "date_validity", "FUTURE_ISSUE_DATE", WARNING, "issue_date", parsed["issue_date"],
        lambda: ~zoned & (issue > now), _say("FUTURE_ISSUE_DATE", value=F.col("issue_date")))
    yield RowRule(
        "date_validity", "INVALID_DATE", ERROR, "maturity_date", parsed["maturity_date"],
        lambda: undated["maturity_date"], _say("INVALID_DATE", value=F.col("maturity_date")))
    yield RowRule(
        "date_validity", "MATURITY_BEFORE_ISSUE", ERROR, "maturity_date",
        (*parsed["issue_date"], *parsed["maturity_date"]), lambda: _same_zone() & (maturity <= issue),
        _say("MATURITY_BEFORE_ISSUE", maturity=F.col("maturity_date"), issue=F.col("issue_date")))


def _number_rules() -> Iterable[RowRule]:
    for column, below, above, unread in (
        ("par_value", "NEGATIVE_PAR_VALUE", "UNUSUAL_PAR_VALUE", "NON_NUMERIC_PAR"),
        ("coupon_rate", "NEGATIVE_COUPON", "HIGH_COUPON", "NON_NUMERIC_COUPON"),
    ):
        text, number = F.col(f"_digits_{column}"), F.col(f"_number_{column}")
        low = number <= 0 if column == "par_value" else number < 0
        high = number > (MAX_PAR if column == "par_value" else MAX_COUPON)
        shown = float_text(number)
        parsed = (column, f"_digits_{column}", f"_number_{column}")
        yield RowRule("numeric_ranges", below, ERROR, column, parsed,
                      lambda low=low: low, _say(below, number=shown))
        yield RowRule("numeric_ranges", above, WARNING, column, parsed,
                      lambda high=high: high, _say(above, number=shown, money=money_text(number)))
        yield RowRule("numeric_ranges", unread, ERROR, column, (*parsed, _clean(column)),
                      lambda column=column, text=text, number=number:
                      _there(column) & is_not_number(text, number),
                      _say(unread, value=F.col(column)))


def _code_rules() -> Iterable[RowRule]:
    yield RowRule(
        "state_codes", "INVALID_STATE", ERROR, "state", ("state", _clean("state"), "_code_state"),
        lambda: _there("state") & ~F.col("_code_state").isin(*STATE_CODES),
        _say("INVALID_STATE", value=F.col("state")))
    yield RowRule(
        "bond_type", "UNKNOWN_BOND_TYPE", WARNING, "bond_type", ("bond_type", _clean("bond_type"), "_type"),
        lambda: _there("bond_type") & ~F.col("_type").isin(*BOND_TYPES),
        _say("UNKNOWN_BOND_TYPE", value=F.col("bond_type"), known=F.lit(", ".join(sorted(BOND_TYPES)))))


def _name_rules() -> Iterable[RowRule]:
    name = F.col(_clean("issuer_name"))
    yield RowRule(
        "issuer_name_quality", "SHORT_ISSUER_NAME", WARNING, "issuer_name", (_clean("issuer_name"),),
        lambda: _there("issuer_name") & (F.length(name) < MIN_NAME_LENGTH), _say("SHORT_ISSUER_NAME", value=name))
    yield RowRule(
        "issuer_name_quality", "NUMERIC_ISSUER_NAME", WARNING, "issuer_name", (_clean("issuer_name"),),
        lambda: name.rlike(ALL_DIGITS), _say("NUMERIC_ISSUER_NAME", value=name))
    for column in WHITESPACE_COLUMNS:
        yield RowRule(
            "data_patterns", "TRAILING_WHITESPACE", INFO, column, (column, _clean(column)),
            lambda column=column: F.col(column) != F.col(_clean(column)),
            _say("TRAILING_WHITESPACE", column=F.lit(column), shown=quoted(F.col(column))))
    found = F.array_join(F.array_sort(F.array_distinct(
        F.regexp_extract_all(name, F.lit(SPECIAL_CHARACTERS), F.lit(0)))), "")
    yield RowRule(
        "data_patterns", "SPECIAL_CHARS_IN_NAME", WARNING, "issuer_name", (_clean("issuer_name"),),
        lambda: name.rlike(SPECIAL_CHARACTERS), _say("SPECIAL_CHARS_IN_NAME", found=found, value=name))
    named = F.col("_named_state")
    code_of = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    yield RowRule(
        "issuer_state_consistency", "ISSUER_STATE_MISMATCH", WARNING, "state",
        ("issuer_name", "_named_state", "_code_state"), lambda: named.isNotNull(),
        _say("ISSUER_STATE_MISMATCH", value=F.col("issuer_name"), name=F.initcap(named),
             code=F.try_element_at(code_of, named), stated=F.col("_code_state")))


def _by_type_rules() -> Iterable[RowRule]:
    kind, rate, par, term = F.col("_type"), F.col("_number_coupon_rate"), F.col("_number_par_value"), _term()
    low, high = _limit(COUPON_RANGES, kind, _low), _limit(COUPON_RANGES, kind, _high)
    coupon = dict(number=float_text(rate), type=kind, low=low.cast("string"), high=high.cast("string"))
    check, needs = "coupon_bond_type_consistency", ("_number_coupon_rate", "_type")
    yield RowRule(check, "COUPON_TYPE_MISMATCH", WARNING, "coupon_rate", needs,
                  lambda: rate > high, _say("COUPON_TYPE_MISMATCH high", **coupon))
    yield RowRule(check, "COUPON_TYPE_MISMATCH", INFO, "coupon_rate", needs,
                  lambda: (rate < low) & (rate != 0), _say("COUPON_TYPE_MISMATCH low", **coupon))

    most, years = _limit(MAX_TERM_YEARS, kind), F.format_string("%.1f", F.bround(term, 1))
    check, dates = "maturity_term_limits", (
        "_moment_issue_date", "_moment_maturity_date", "_zone_issue_date", "_zone_maturity_date", "_type")
    yield RowRule(check, "EXCESSIVE_MATURITY_TERM", WARNING, "maturity_date", dates,
                  lambda: term > most,
                  _say("EXCESSIVE_MATURITY_TERM", type=kind, term=years, most=most.cast("int")))
    # a null type is still checked here, a blank one is not
    yield RowRule(check, "EXTREME_MATURITY_TERM", ERROR, "maturity_date", dates,
                  lambda: (term > MAX_TERM) & F.coalesce(kind != "", F.lit(True)),
                  _say("EXTREME_MATURITY_TERM", term=years))

    least, most_par = _limit(PAR_RANGES, kind, _low), _limit(PAR_RANGES, kind, _high)
    check, needs = "par_value_by_bond_type", ("_number_par_value", "_type")
    yield RowRule(check, "PAR_TYPE_MISMATCH", WARNING, "par_value", needs, lambda: par > most_par,
                  _say("PAR_TYPE_MISMATCH", money=money_text(par), type=kind,
                       bound=F.format_string("%,.0f", most_par)))
    yield RowRule(check, "PAR_BELOW_MINIMUM", WARNING, "par_value", needs, lambda: par < least,
                  _say("PAR_BELOW_MINIMUM", money=money_text(par), type=kind,
                       bound=F.format_string("%,.0f", least)))


def _table_rules() -> Iterable[TableRule]:
    yield TableRule(
        "required_columns", "MISSING_COLUMN", ERROR, (),
        lambda rows, row, data: table_rules.missing_columns(
            rows, data, REQUIRED_COLUMNS, MESSAGES["MISSING_COLUMN"]), of_file=True)
    yield TableRule(
        "duplicate_cusips", "DUPLICATE_CUSIP", WARNING, ("cusip",),
        lambda rows, row, data: table_rules.duplicate_values(rows, row, "cusip").select(
            "row", F.lit("cusip").alias("column"), F.lit(0).alias("emit_ord"),
            fill(MESSAGES["DUPLICATE_CUSIP"], value=F.col("value")).alias("message")))
    yield TableRule(
        "data_patterns", "INCONSISTENT_CASING", WARNING, ("issuer_name",),
        lambda rows, row, data: table_rules.inconsistent_casing(
            rows, row, "issuer_name", MESSAGES["INCONSISTENT_CASING"]))
    yield TableRule(
        "copy_paste_errors", "DUPLICATE_ROW", WARNING, (),
        lambda rows, row, data: table_rules.duplicate_rows(rows, row, data).select(
            "row", F.lit(None).cast("string").alias("column"), F.lit(0).alias("emit_ord"),
            fill(MESSAGES["DUPLICATE_ROW"], row=F.col("row")).alias("message")))
    yield TableRule(
        "copy_paste_errors", "COPY_PASTE_SUSPECTED", WARNING, (),
        lambda rows, row, data: _concentration(rows, data))


def _concentration(rows, data):
    columns = [c for c in CONCENTRATION_COLUMNS if c in data]
    if not columns:
        return None
    return table_rules.concentrated_values(rows, columns, MESSAGES["COPY_PASTE_SUSPECTED"])
