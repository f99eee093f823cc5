"""The bond pack as tables of parameters, for :mod:`assayframe.plans.compiler`. Values come from :mod:`assayframe.plans.bonds`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bonds as b
from .compiler import SPEC_SCHEMA, Spec
from .pack import ERROR, INFO, WARNING

SYMBOLS = {"par_value": ",$", "coupon_rate": "%"}


def _say(rule: str, **renamed: str) -> str:
    text = b.MESSAGES[rule]
    for old, new in renamed.items():
        text = text.replace("{" + old + "}", "{" + new + "}")
    return text


def bond_specs() -> list[Spec]:
    """One line per rule, in reporting order."""
    def line(check: str, rule: str, severity: str, kind: str, role: str, message: str | None = None, **more) -> Spec:
        return Spec(check, rule, severity, kind, role, message or _say(rule), **more)

    numbers = (("par_value", "NEGATIVE_PAR_VALUE", True, "UNUSUAL_PAR_VALUE", b.MAX_PAR, "NON_NUMERIC_PAR"),
               ("coupon_rate", "NEGATIVE_COUPON", False, "HIGH_COUPON", b.MAX_COUPON, "NON_NUMERIC_COUPON"))
    term = dict(other="issue_date", third="bond_type")
    by_type = dict(other="bond_type", lookup="coupon_ranges")
    par = dict(other="bond_type", lookup="par_ranges")
    return [
        line("required_columns", "MISSING_COLUMN", ERROR, "columns", ""),
        *[line("missing_values", "MISSING_VALUE", ERROR, "required", c) for c in b.REQUIRED_COLUMNS],
        line("cusip_format", "CUSIP_FORMAT", ERROR, "format", "cusip", pattern=b.ID_FORMAT),
        line("duplicate_cusips", "DUPLICATE_CUSIP", WARNING, "repeated value", "cusip"),
        line("date_validity", "INVALID_DATE", ERROR, "date", "issue_date", clock=True),
        line("date_validity", "FUTURE_ISSUE_DATE", WARNING, "future", "issue_date"),
        line("date_validity", "INVALID_DATE", ERROR, "date", "maturity_date"),
        line("date_validity", "MATURITY_BEFORE_ISSUE", ERROR, "not after", "maturity_date", _say("MATURITY_BEFORE_ISSUE", maturity="value", issue="other"),
             other="issue_date"),
        *[x for role, low, at, high, most, unread in numbers for x in (
            line("numeric_ranges", low, ERROR, "below", role, bound=0.0, at=at),
            line("numeric_ranges", high, WARNING, "above", role, bound=most),
            line("numeric_ranges", unread, ERROR, "number", role))],
        line("state_codes", "INVALID_STATE", ERROR, "member", "state", lookup="states"),
        line("bond_type", "UNKNOWN_BOND_TYPE", WARNING, "member", "bond_type", lookup="types"),
        line("issuer_name_quality", "SHORT_ISSUER_NAME", WARNING, "shorter", "issuer_name", bound=float(b.MIN_NAME_LENGTH)),
        line("issuer_name_quality", "NUMERIC_ISSUER_NAME", WARNING, "holds", "issuer_name", pattern=b.ALL_DIGITS),
        line("cusip_check_digit", "CUSIP_CHECK_DIGIT", ERROR, "check digit", "cusip", pattern=b.ID_FORMAT),
        line("cusip_issuer_structure", "CUSIP_ISSUER_ANOMALY", WARNING, "matches", "cusip", _say("CUSIP_ISSUER_ANOMALY", issuer="group"),
             pattern=b.ID_ALPHA_ISSUER.replace("[A-Z]{6}", "([A-Z]{6})")),
        line("cusip_issuer_structure", "CUSIP_PLACEHOLDER", INFO, "matches", "cusip", pattern=b.ID_ZERO_ISSUE),
        line("coupon_bond_type_consistency", "COUPON_TYPE_MISMATCH", WARNING, "above limit", "coupon_rate", _say("COUPON_TYPE_MISMATCH high"), **by_type),
        line("coupon_bond_type_consistency", "COUPON_TYPE_MISMATCH", INFO, "below limit", "coupon_rate", _say("COUPON_TYPE_MISMATCH low"), nonzero=True, **by_type),
        line("maturity_term_limits", "EXCESSIVE_MATURITY_TERM", WARNING, "term above limit", "maturity_date", lookup="max_terms", **term),
        line("maturity_term_limits", "EXTREME_MATURITY_TERM", ERROR, "term above", "maturity_date", bound=b.MAX_TERM, **term),
        line("par_value_by_bond_type", "PAR_TYPE_MISMATCH", WARNING, "above limit", "par_value", **par),
        line("par_value_by_bond_type", "PAR_BELOW_MINIMUM", WARNING, "below limit", "par_value", **par),
        *[line("data_patterns", "TRAILING_WHITESPACE", INFO, "untrimmed", c) for c in b.WHITESPACE_COLUMNS],
        line("data_patterns", "SPECIAL_CHARS_IN_NAME", WARNING, "holds", "issuer_name", pattern=b.SPECIAL_CHARACTERS),
        line("data_patterns", "INCONSISTENT_CASING", WARNING, "spelling", "issuer_name"),
        line("copy_paste_errors", "DUPLICATE_ROW", WARNING, "repeated row", ""),
        line("copy_paste_errors", "COPY_PASTE_SUSPECTED", WARNING, "share", ",".join(b.CONCENTRATION_COLUMNS), bound=0.6),
        line("issuer_state_consistency", "ISSUER_STATE_MISMATCH", WARNING, "named", "issuer_name", other="state", lookup="state_names"),
    ]


def spec_table(spark: SparkSession) -> DataFrame:
    fields = [f.split()[0] for f in SPEC_SCHEMA.split(", ")]
    lines = [(n, *[getattr(s, f) for f in fields]) for n, s in enumerate(bond_specs())]
    return spark.createDataFrame(lines, f"ord int, {SPEC_SCHEMA}")


def role_table(spark: SparkSession, columns: dict[str, str] | None = None) -> DataFrame:
    """Which column holds each role; by default the one of its name."""
    lines = [(n, c, (columns or {}).get(c, c), SYMBOLS.get(c)) for n, c in enumerate(b.REQUIRED_COLUMNS)]
    return spark.createDataFrame(lines, "ord int, role string, column string, symbols string")


def lookup_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Codes, limits by type and state names as small tables."""
    def codes(values) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "code string")

    def limits(table: dict) -> DataFrame:
        return spark.createDataFrame([(k, float(low), float(high)) for k, (low, high) in table.items()], "code string, low double, high double")

    return {
        "states": codes(b.STATE_CODES), "types": codes(b.BOND_TYPES), "coupon_ranges": limits(b.COUPON_RANGES), "par_ranges": limits(b.PAR_RANGES),
        "max_terms": spark.createDataFrame([(k, float(v)) for k, v in b.MAX_TERM_YEARS.items()], "code string, most double"),
        "state_names": spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(b.STATE_NAMES.items())], "name string, code string, ord long"),
    }
