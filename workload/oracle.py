"""The registered queries in SQL, written apart from the rules they check.

Message texts are fixed values: they are stated here once more, in SQL, so that those of the pack are checked.
"""

from __future__ import annotations

import re

from assayframe.plans.bonds import (
    BOND_TYPES, CHECKS, COUPON_RANGES, MAX_TERM_YEARS, PAR_RANGES, REQUIRED_COLUMNS, STATE_CODES, STATE_NAMES,
)

from .securities import AS_OF, LETTERS, STATES, TYPES

COLUMNS = ", ".join(REQUIRED_COLUMNS)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _rows(table: dict) -> str:
    lines = []
    for key, entry in table.items():
        values = entry if isinstance(entry, tuple) else (entry,)
        lines.append(f"('{key}', {', '.join(f'CAST({v} AS DOUBLE)' for v in values)})")
    return "VALUES " + ", ".join(lines)


_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(body: str) -> str:
    def part(p: int) -> str:
        value = f"((instr('{_ALPHABET}', substr({body}, {p}, 1)) - 1) * {2 - p % 2})"
        return f"({value} // 10 + {value} % 10)"

    return f"CAST((10 - ({' + '.join(part(p) for p in range(1, 9))}) % 10) % 10 AS VARCHAR)"


SECURITIES = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, c_nationkey AS s, o_totalprice AS price, o_orderdate AS d,
    {_list(name for name, _ in STATES)}[c_nationkey + 1] AS sname,
    {_list(code for _, code in STATES)}[c_nationkey + 1] AS scode,
    {_list(code for _, code in STATES)}[(c_nationkey + 1) % 25 + 1] AS wrong,
    CASE WHEN o_orderkey % 43 = 0 THEN concat('ABCDEF', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'))
         WHEN o_orderkey % 47 = 0 THEN concat(upper(to_base(o_orderkey // 47, 36, 6)), '00')
         ELSE concat(upper(to_base(o_orderkey, 36, 7)), substr('{LETTERS}', CAST(o_orderkey % 24 + 1 AS INTEGER), 1)) END AS body
  FROM orders JOIN customer ON o_custkey = c_custkey),
once AS (
  SELECT k,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 17 = 0 THEN substr(body, 1, 7)
         WHEN k % 13 = 0 THEN concat(body, CAST((CAST({_digit('body')} AS INTEGER) + 1) % 10 AS VARCHAR))
         ELSE concat(body, {_digit('body')}) END AS cusip,
    CASE WHEN k % 61 = 0 THEN NULL WHEN k % 59 = 0 THEN 'AB' WHEN k % 53 = 0 THEN '12345'
         WHEN k % 31 = 0 THEN lower(concat('City ', CAST(c % 40 AS VARCHAR), ' of ', sname))
         WHEN k % 37 = 0 THEN concat('City ', CAST(c % 40 AS VARCHAR), ' of ', sname, '  ')
         WHEN k % 41 = 0 THEN concat('City <', CAST(c % 40 AS VARCHAR), '> of ', sname)
         ELSE concat('City ', CAST(c % 40 AS VARCHAR), ' of ', sname) END AS issuer_name,
    CASE WHEN k % 67 = 0 THEN 'XX' WHEN k % 29 = 0 THEN wrong WHEN k % 71 = 0 THEN lower(scode) ELSE scode END AS state,
    CASE WHEN k % 73 = 0 THEN 'not-a-date' WHEN k % 79 = 0 THEN '2099-01-01' WHEN k % 83 = 0 THEN strftime(d, '%m/%d/%Y')
         ELSE strftime(d, '%Y-%m-%d') END AS issue_date,
    CASE WHEN k % 89 = 0 THEN '1990-01-01' WHEN k % 97 = 0 THEN concat(CAST(year(d) + 60 AS VARCHAR), strftime(d, '-%m-01'))
         ELSE concat(CAST(year(d) + 1 + k % 20 AS VARCHAR), strftime(d, '-%m-01')) END AS maturity_date,
    CASE WHEN k % 101 = 0 THEN '-500' WHEN k % 103 = 0 THEN 'abc' WHEN k % 107 = 0 THEN '$1,250,000'
         WHEN k % 109 = 0 THEN '5000000000' WHEN k % 113 = 0 THEN '  ' WHEN k % 7 = 0 THEN '250000'
         ELSE CAST(CAST(round(price) AS BIGINT) AS VARCHAR) END AS par_value,
    CASE WHEN k % 127 = 0 THEN '22.5' WHEN k % 131 = 0 THEN '-1.5' WHEN k % 137 = 0 THEN 'N/A' WHEN k % 3 > 0 THEN '4.25'
         ELSE CAST(k % 36 AS VARCHAR) END AS coupon_rate,
    CASE WHEN k % 139 = 0 THEN 'XYZ' WHEN k % 149 = 0 THEN ' go ' WHEN k % 157 = 0 THEN '  ' WHEN k % 194 = 0 THEN NULL
         ELSE {_list(TYPES)}[k % 12 + 1] END AS bond_type
  FROM base),
securities AS (
  SELECT 2 * k + 2 AS row_id, {COLUMNS} FROM once
  UNION ALL SELECT 2 * k + 3, {COLUMNS} FROM once WHERE k % 151 = 0)"""

PARSED = f"""
parsed AS (
  SELECT row_id AS row, {COLUMNS}, trim(cusip) AS id, trim(issuer_name) AS name, upper(trim(state)) AS st,
    upper(trim(bond_type)) AS bt,
    coalesce(try_strptime(issue_date, '%Y-%m-%d'), try_strptime(issue_date, '%m/%d/%Y')) AS issued,
    try_strptime(maturity_date, '%Y-%m-%d') AS matures,
    TRY_CAST(trim(replace(replace(par_value, ',', ''), '$', '')) AS DOUBLE) AS par,
    TRY_CAST(trim(replace(coupon_rate, '%', '')) AS DOUBLE) AS rate
  FROM securities),
coupon_limits(kind, low, high) AS ({_rows(COUPON_RANGES)}),
term_limits(kind, most) AS ({_rows(MAX_TERM_YEARS)}),
par_limits(kind, low, high) AS ({_rows(PAR_RANGES)}),
state_names(name, code, ord, title) AS (VALUES {', '.join(f"('{n}', '{c}', {i}, '{n.title()}')" for i, (n, c) in enumerate(STATE_NAMES.items()))}),
terms AS (
  SELECT row, bt, CAST(date_diff('day', issued, matures) AS DOUBLE) / 365.25 AS years FROM parsed
  WHERE issued IS NOT NULL AND matures IS NOT NULL)"""

_ID = "regexp_full_match(id, '[A-Za-z0-9]{9}')"


def _issue(check: str, rule: str, severity: str, column: str, where: str, source: str = "parsed",
           place: int = 0, message: str = "NULL", row: str = "row") -> str:
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    rank = {"error": 0, "warning": 1, "info": 2}[severity]
    return (
        f"SELECT CAST({row} AS BIGINT) AS row, {name} AS \"column\", '{severity}' AS severity, '{rule}' AS rule, {message} AS message, "
        f"{rank} AS sev_rank, {CHECKS.index(check)} AS check_ord, CAST({place} AS BIGINT) AS emit_ord "
        f"FROM {source} WHERE {where}"
    )


def _text(template: str, **fields: str) -> str:
    """A message in SQL: ``[name]`` in the template stands for the field of that name."""
    parts = re.split(r"\[(\w+)\]", template)
    return "concat(" + ", ".join(fields[x] if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts)) + ")"


def _number(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


def _money(value: str, digits: int = 2) -> str:
    return f"format('{{:,.{digits}f}}', {value})"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_COUPON = "parsed JOIN coupon_limits ON kind = bt"
_PAR = "parsed JOIN par_limits ON kind = bt"

RULES: dict[str, list[str]] = {
    "missing_values": [
        _issue("missing_values", "MISSING_VALUE", "error", c, f"{c} IS NULL OR trim({c}) = ''", place=i, message=_text(f"Required field '{c}' is empty."))
        for i, c in enumerate(REQUIRED_COLUMNS)],
    "id_format": [_issue("cusip_format", "CUSIP_FORMAT", "error", "cusip", f"id <> '' AND NOT {_ID}",
                        message=_text("Invalid CUSIP format: '[id]'. Expected 9 alphanumeric characters.", id="id"))],
    "duplicate_ids": [_issue(
        "duplicate_cusips", "DUPLICATE_CUSIP", "warning", "cusip", "nth > 1",
        """(SELECT row, id, row_number() OVER (PARTITION BY id ORDER BY row) AS nth FROM parsed
            WHERE id <> '' AND cusip IN (SELECT cusip FROM securities GROUP BY cusip HAVING count(*) > 1))""",
        message=_text("Duplicate CUSIP '[id]' found.", id="id"))],
    "invalid_date": [
        _issue("date_validity", "INVALID_DATE", "error", c, f"trim({c}) <> '' AND {p} IS NULL", place=o,
               message=_text("Cannot parse date value: '[v]'.", v=c))
        for c, p, o in (("issue_date", "issued", 0), ("maturity_date", "matures", 2))],
    "future_date": [_issue("date_validity", "FUTURE_ISSUE_DATE", "warning", "issue_date",
                           "issued > TIMESTAMP '2024-01-01'", place=1,
                           message=_text("Issue date '[v]' is in the future.", v="issue_date"))],
    "date_order": [_issue("date_validity", "MATURITY_BEFORE_ISSUE", "error", "maturity_date", "matures <= issued", place=3,
                          message=_text("Maturity date ([m]) is on or before issue date ([i]).", m="maturity_date", i="issue_date"))],
    "par_range": [
        _issue("numeric_ranges", "NEGATIVE_PAR_VALUE", "error", "par_value", "par <= 0",
               message=_text("Par value must be positive, got [n].", n=_number("par"))),
        _issue("numeric_ranges", "UNUSUAL_PAR_VALUE", "warning", "par_value", "par > 1e9", place=1,
               message=_text("Par value of [m] is unusually large — verify.", m=_money("par"))),
        _issue("numeric_ranges", "NON_NUMERIC_PAR", "error", "par_value", "trim(par_value) <> '' AND par IS NULL", place=2,
               message=_text("Par value '[v]' is not a valid number.", v="par_value"))],
    "coupon_range": [
        _issue("numeric_ranges", "NEGATIVE_COUPON", "error", "coupon_rate", "rate < 0", place=3,
               message=_text("Coupon rate cannot be negative: [n]%.", n=_number("rate"))),
        _issue("numeric_ranges", "HIGH_COUPON", "warning", "coupon_rate", "rate > 15", place=4,
               message=_text("Coupon rate of [n]% seems unusually high — verify.", n=_number("rate"))),
        _issue("numeric_ranges", "NON_NUMERIC_COUPON", "error", "coupon_rate",
               "trim(coupon_rate) <> '' AND rate IS NULL", place=5,
               message=_text("Coupon rate '[v]' is not a valid number.", v="coupon_rate"))],
    "invalid_state": [_issue("state_codes", "INVALID_STATE", "error", "state", f"st <> '' AND st NOT IN {_in(STATE_CODES)}",
                             message=_text("'[v]' is not a valid US state/territory code.", v="state"))],
    "unknown_type": [_issue("bond_type", "UNKNOWN_BOND_TYPE", "warning", "bond_type",
                            f"bt <> '' AND bt NOT IN {_in(BOND_TYPES)}",
                            message=_text("Instrument type '[v]' is not a recognized classification. Expected one of: "
                                          "BAB, BAN, CD, COPS, GO, HFA, IDR, OTHER, RAN, REV, TAN, TRAN.", v="bond_type"))],
    "name_quality": [
        _issue("issuer_name_quality", "SHORT_ISSUER_NAME", "warning", "issuer_name", "name <> '' AND length(name) < 3",
               message=_text("Issuer name '[v]' is suspiciously short.", v="name")),
        _issue("issuer_name_quality", "NUMERIC_ISSUER_NAME", "warning", "issuer_name",
               "regexp_full_match(name, '[0-9]+')", place=1,
               message=_text("Issuer name '[v]' appears to be purely numeric.", v="name"))],
    "id_check_digit": [_issue("cusip_check_digit", "CUSIP_CHECK_DIGIT", "error", "cusip",
                              f"{_ID} AND substr(id, 9, 1) <> {_digit('upper(id)')}",
                              message=_text("CUSIP '[v]' has an invalid check digit. Expected '[e]', got '[g]'. "
                                            "Possible transposition or fabricated identifier.",
                                            v="id", e=_digit("upper(id)"), g="substr(id, 9, 1)"))],
    "id_issuer_alpha": [_issue("cusip_issuer_structure", "CUSIP_ISSUER_ANOMALY", "warning", "cusip",
                               f"{_ID} AND regexp_full_match(substr(id, 1, 6), '[A-Za-z]{{6}}')",
                               message=_text("CUSIP '[v]': issuer code '[i]' is all-alphabetic. Public-sector CUSIPs typically have "
                                             "numeric issuer codes. Verify the instrument classification.",
                                             v="upper(id)", i="upper(substr(id, 1, 6))"))],
    "id_placeholder": [_issue("cusip_issuer_structure", "CUSIP_PLACEHOLDER", "info", "cusip",
                              f"{_ID} AND substr(id, 7, 2) = '00'", place=1,
                              message=_text("CUSIP '[v]': issue ID '00' may indicate placeholder data.", v="upper(id)"))],
    "coupon_by_type": [
        _issue("coupon_bond_type_consistency", "COUPON_TYPE_MISMATCH", "warning", "coupon_rate", "rate > high", _COUPON,
               message=_text("Coupon rate [n]% is unusually high for [t] instruments (expected [l]–[h]%). Verify rate or classification.",
                             n=_number("rate"), t="bt", l=_number("low"), h=_number("high"))),
        _issue("coupon_bond_type_consistency", "COUPON_TYPE_MISMATCH", "info", "coupon_rate",
               "rate < low AND rate <> 0", _COUPON, 1,
               message=_text("Coupon rate [n]% is below typical range for [t] instruments(expected [l]–[h]%).",
                             n=_number("rate"), t="bt", l=_number("low"), h=_number("high")))],
    "term_by_type": [_issue("maturity_term_limits", "EXCESSIVE_MATURITY_TERM", "warning", "maturity_date",
                            "years > most", "terms JOIN term_limits ON kind = bt",
                            message=_text("[t] instrument has a [y]-year term, exceeding the typical max of [m] years. "
                                          "Verify maturity date or instrument classification.",
                                          t="bt", y="format('{:.1f}', years)", m="CAST(most AS INTEGER)"))],
    "term_extreme": [_issue("maturity_term_limits", "EXTREME_MATURITY_TERM", "error", "maturity_date",
                            "years > 50 AND (bt IS NULL OR bt <> '')", "terms", 1,
                            message=_text("Maturity term of [y] years exceeds 50-year maximum. Likely a data entry error.",
                                          y="format('{:.1f}', years)"))],
    "par_by_type": [
        _issue("par_value_by_bond_type", "PAR_TYPE_MISMATCH", "warning", "par_value", "par > high", _PAR,
               message=_text("Par value $[p] is unusually high for [t] instruments(typical max $[b]). Verify amount or classification.",
                             p=_money("par"), t="bt", b=_money("high", 0))),
        _issue("par_value_by_bond_type", "PAR_BELOW_MINIMUM", "warning", "par_value", "par < low", _PAR, 1,
               message=_text("Par value $[p] is below typical minimum for [t] instruments($[b]). "
                             "May indicate incorrect units (thousands vs actual).", p=_money("par"), t="bt", b=_money("low", 0)))],
    "whitespace": [
        _issue("data_patterns", "TRAILING_WHITESPACE", "info", c, f"{c} <> trim({c})", place=i,
               message=_text(f"Value in '{c}' has leading/trailing whitespace: ''[v]''.", v=c))
        for i, c in enumerate(("issuer_name", "state", "bond_type", "cusip"))],
    "special_chars": [_issue("data_patterns", "SPECIAL_CHARS_IN_NAME", "warning", "issuer_name",
                             r"regexp_matches(name, '[<>{}\\|~`\[\]^]')", place=4,
                             message=_text("Issuer name contains suspicious characters: [f] in '[v]'.", v="name",
                                           f=r"list_aggregate(list_sort(list_distinct(regexp_extract_all(name, '[<>{}\\|~`\[\]^]'))), 'string_agg', '')"))],
    "inconsistent_casing": [_issue(
        "data_patterns", "INCONSISTENT_CASING", "warning", "issuer_name", "n > 1",
        """(SELECT count(*) AS n, min(seen) AS first, string_agg(chr(39) || name || chr(39), ', ' ORDER BY seen) AS variants
            FROM (SELECT name, min(row) AS seen FROM parsed WHERE name IS NOT NULL GROUP BY name) GROUP BY lower(name))""", "first", row="NULL",
        message=_text("Issuer name has inconsistent casing: [v]. Standardize to one form.", v="variants"))],
    "duplicate_rows": [_issue(
        "copy_paste_errors", "DUPLICATE_ROW", "warning", "", "nth > 1",
        f"(SELECT row_id AS row, row_number() OVER (PARTITION BY {COLUMNS} ORDER BY row_id) AS nth FROM securities)",
        message=_text("Row [r] is an exact duplicate of a previous row.", r="row"))],
    "value_concentration": [
        _issue("copy_paste_errors", "COPY_PASTE_SUSPECTED", "warning", c, "n > 3 AND n > 0.6 * total AND records >= 5",
               f"""(SELECT trim({c}) AS v, count(*) AS n, (SELECT count({c}) FROM parsed) AS total, (SELECT count(*) FROM parsed) AS records
                    FROM parsed WHERE {c} IS NOT NULL GROUP BY trim({c}))""", place=i + 1, row="NULL",
               message=_text(f"Column '{c}' has [n]/[t] rows ([p]%) with value '[v]'. Possible copy-paste or default-fill error.",
                             n="n", t="total", p="CAST(round_even(100 * n / total, 0) AS BIGINT)", v="v"))
        for i, c in enumerate(("issuer_name", "par_value", "coupon_rate"))],
    "name_state_mismatch": [_issue(
        "issuer_state_consistency", "ISSUER_STATE_MISMATCH", "warning", "state", "TRUE",
        """(SELECT p.row, any_value(p.issuer_name) AS issuer, any_value(p.st) AS stated, arg_min(s.title, s.ord) AS state_name,
              arg_min(s.code, s.ord) AS code
            FROM parsed p JOIN state_names s ON contains(lower(p.name), s.name) AND s.code <> p.st GROUP BY p.row)""",
        message=_text("Issuer name '[v]' suggests [n] ([c]), but state column says '[s]'. Verify geographic data.",
                      v="issuer", n="state_name", c="code", s="stated"))],
}

WITH = f"WITH {SECURITIES}, {PARSED}"
ALL = " UNION ALL ".join(part for parts in RULES.values() for part in parts)
ISSUES = f"{WITH}, issues AS ({ALL})"
_ORDER = "coalesce(row, 0), sev_rank, check_ord, emit_ord"
_COUNTS = """CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS errors,
  CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings,
  CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info"""
_STATUS = "CASE WHEN errors > 0 THEN 'ERRORS' WHEN warnings > 0 THEN 'WARNINGS' ELSE 'OK' END AS status"
_TOTALS = f"""totals AS (SELECT (SELECT count(*) FROM securities) AS total_rows,
  (SELECT count(DISTINCT row) FROM issues WHERE severity = 'error') AS error_rows)"""
_RATE = "round_even((1 - error_rows / total_rows) * 100, 2)"


def queries() -> dict[str, str]:
    found = {
        key: f"{WITH}, issues AS ({' UNION ALL '.join(parts)}) SELECT row, \"column\", severity, rule, message FROM issues"
        for key, parts in RULES.items()}
    by_table = {"codes_by_table": ("invalid_state", "unknown_type"), "limits_by_table": ("coupon_by_type", "term_by_type", "par_by_type"),
                "names_by_table": ("name_state_mismatch",)}
    found |= {
        key: f"{WITH}, issues AS ({' UNION ALL '.join(p for k in keys for p in RULES[k])}) SELECT row, \"column\", severity, rule, message FROM issues"
        for key, keys in by_table.items()}
    found["normalize_columns"] = f"WITH {SECURITIES} SELECT row_id, {COLUMNS} FROM securities"
    found["row_numbers"] = "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS BIGINT) AS row, o_orderkey FROM orders"
    found["file_row_numbers"] = "SELECT CAST(o_orderkey + 2 AS BIGINT) AS row, o_orderkey, o_custkey FROM orders"
    found["parse_numbers"] = f"{WITH} SELECT row, par, rate FROM parsed"
    found["parse_dates"] = (
        f"{WITH} SELECT row, strftime(issued, '%Y-%m-%d %H:%M:%S') AS issued, "
        "strftime(matures, '%Y-%m-%d %H:%M:%S') AS matures FROM parsed")
    without = [p for parts in RULES.values() for p in parts]
    gone = ("'state'", "'bond_type'")
    kept = [
        p for key, parts in RULES.items() for p in parts
        if key not in ("coupon_by_type", "term_by_type", "term_extreme", "par_by_type", "name_state_mismatch",
                       "duplicate_rows") and not any(f'{g} AS "column"' in p for g in gone)]
    narrow = ", ".join(c for c in REQUIRED_COLUMNS if c not in ("state", "bond_type"))
    kept.append(_issue(
        "copy_paste_errors", "DUPLICATE_ROW", "warning", "", "nth > 1",
        f"(SELECT row_id AS row, row_number() OVER (PARTITION BY {narrow} ORDER BY row_id) AS nth FROM securities)"))
    kept += [_issue("required_columns", "MISSING_COLUMN", "error", c, "TRUE", "(SELECT 1 AS one)", i, row="NULL")
             for i, c in enumerate(REQUIRED_COLUMNS) if c in ("state", "bond_type")]
    assert len(without) > len(kept)
    found["missing_columns"] = (
        f"{WITH}, issues AS ({' UNION ALL '.join(kept)}) SELECT rule, \"column\", CAST(count(*) AS BIGINT) AS n "
        "FROM issues GROUP BY rule, \"column\"")

    full = f'row, "column", severity, rule, sev_rank, check_ord, emit_ord'
    found["all_issues"] = f'{ISSUES} SELECT row, "column", severity, rule FROM issues'
    found["compiled_issues"] = found["all_issues"]
    found["issues_sorted"] = f"{ISSUES} SELECT {full} FROM issues ORDER BY {_ORDER}"
    found["filter_severity"] = f'{ISSUES} SELECT row, "column", severity, rule FROM issues WHERE severity = \'error\''
    found["filter_rule"] = f'{ISSUES} SELECT row, "column", severity, rule FROM issues WHERE rule LIKE \'%CUSIP%\''
    found["top_issues"] = (
        f'{ISSUES} SELECT row, "column", severity, rule, CAST((SELECT count(*) FROM issues) - 50 AS BIGINT) AS left_out '
        f"FROM issues ORDER BY {_ORDER} LIMIT 50")
    found["issue_log"] = (
        f"{ISSUES} SELECT coalesce(CAST(row AS VARCHAR), '—') AS row, coalesce(\"column\", '—') AS field, "
        "upper(severity) AS severity, rule, message AS description FROM issues")
    found["severity_counts"] = f"{ISSUES} SELECT {_COUNTS} FROM issues"
    found["pass_rate"] = f"{ISSUES}, {_TOTALS} SELECT total_rows, error_rows, {_RATE} AS pass_rate FROM totals"
    found["summary"] = f"""{ISSUES}, {_TOTALS}, counts AS (SELECT {_COUNTS} FROM issues)
      SELECT 'securities' AS file_name, total_rows, 8 AS total_columns, 17 AS validators_run, errors, warnings, info,
        {_RATE} AS pass_rate, errors = 0 AND warnings = 0 AS is_clean, errors > 0 AS has_errors,
        CASE WHEN {_RATE} >= 90 THEN 'good' WHEN {_RATE} >= 60 THEN 'fair' ELSE 'poor' END AS band
      FROM totals, counts"""
    found["csv_rows"] = f"""WITH {SECURITIES} SELECT CAST(row_number() OVER (ORDER BY row_id) + 1 AS BIGINT) AS row,
      CAST(row_id AS VARCHAR) AS row_id, {", ".join(f"CASE WHEN {c} NOT IN ('', 'N/A') THEN {c} END AS {c}" for c in REQUIRED_COLUMNS)}
      FROM securities"""
    found["report_document"] = f"""{ISSUES}, {_TOTALS}, counts AS (SELECT {_COUNTS} FROM issues),
      placed AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM issues),
      rules AS (SELECT rule, count(*) AS n, min(place) AS seen FROM placed GROUP BY rule),
      cols AS (SELECT "column" AS c, {_COUNTS} FROM issues WHERE "column" IS NOT NULL GROUP BY "column")
      SELECT 'securities' AS file_name, '{AS_OF.isoformat()}' AS generated_at, total_rows, 8 AS total_columns, 17 AS validators_run,
        errors, warnings, info, {_RATE} AS pass_rate,
        (SELECT '{{' || string_agg('"' || rule || '":' || n, ',' ORDER BY n DESC, seen) || '}}' FROM rules) AS by_rule,
        (SELECT '{{' || string_agg('"' || c || '":{{"errors":' || errors || ',"warnings":' || warnings || ',"info":' || info || '}}', ',' ORDER BY c)
          || '}}' FROM cols) AS by_column
      FROM totals, counts"""
    found["report_while_writing"] = found["report_document"]
    found["rule_counts"] = f"{ISSUES} SELECT rule, CAST(count(*) AS BIGINT) AS n FROM issues GROUP BY rule ORDER BY n DESC"
    found["rule_severity"] = f"""{ISSUES} SELECT rule, CAST(count(*) AS BIGINT) AS n,
      ['error', 'warning', 'info'][min(sev_rank) + 1] AS severity FROM issues GROUP BY rule"""
    found["rule_share"] = f"""{ISSUES}, counts AS (SELECT rule, CAST(count(*) AS BIGINT) AS n FROM issues GROUP BY rule),
      shares AS (SELECT rule, n, n / (SELECT max(n) FROM counts) AS share FROM counts)
      SELECT rule, n, share, CAST(floor(share * 25) AS INTEGER) AS bar_25, CAST(floor(share * 15) AS INTEGER) AS bar_15,
        CAST(round_even(share * 100, 0) AS INTEGER) AS percent FROM shares"""
    found["column_stats"] = f'{ISSUES} SELECT "column", {_COUNTS} FROM issues WHERE "column" IS NOT NULL GROUP BY "column"'
    stats = f'stats AS (SELECT "column", {_COUNTS} FROM issues GROUP BY "column")'
    found["column_health"] = f"""{ISSUES}, {stats},
      listed AS (SELECT unnest({_list(REQUIRED_COLUMNS)}) AS col),
      joined AS (SELECT col AS "column", coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
        FROM listed LEFT JOIN stats ON col = "column")
      SELECT "column", errors, warnings, {_STATUS} FROM joined"""
    found["column_overview"] = f"""{ISSUES}, {stats} SELECT "column", errors, warnings, {_STATUS} FROM stats
      WHERE "column" IS NOT NULL AND errors + warnings > 0"""
    found["casing_variants"] = f"""{WITH}, v AS (SELECT lower(name) AS lowered, name AS spelling, min(row) AS first
        FROM parsed WHERE name IS NOT NULL GROUP BY ALL)
      SELECT lowered AS name, spelling, CAST(first AS BIGINT) AS first,
        CAST(count(*) OVER (PARTITION BY lowered) AS BIGINT) AS n FROM v
      QUALIFY count(*) OVER (PARTITION BY lowered) > 1"""
    return found
