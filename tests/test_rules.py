"""Row and table rules on literal cases: one valid row with single fields changed."""

from datetime import datetime

import pytest

from assayframe.operators.issues import first_issues, sorted_issues
from assayframe.operators.summary import column_health, pass_rate, profile, rule_counts, summary
from assayframe.plans.bonds import CHECKS, REQUIRED_COLUMNS, bond_pack
from assayframe.plans.engine import normalize_columns, run_checks, validate
from assayframe.plans.pack import WARNING, RowRule

AS_OF = datetime(2026, 12, 1)
VALID = dict(
    cusip="54327AB17", issuer_name="Town of Boulder Colorado", state="CO", issue_date="2019-05-20",
    maturity_date="2039-05-20", par_value="2500000", coupon_rate="3.75", bond_type="GO")


def row_rules():
    return [r.rule for r in bond_pack(AS_OF).rules if isinstance(r, RowRule)]


# Changed fields -> the rules that fire on the row, by name.
CASES = [
    ({}, []),
    ({"cusip": ""}, ["MISSING_VALUE"]),
    ({"cusip": None}, ["MISSING_VALUE"]),
    ({"state": "   "}, ["ISSUER_STATE_MISMATCH", "MISSING_VALUE", "TRAILING_WHITESPACE"]),
    ({"cusip": "12345"}, ["CUSIP_FORMAT"]),
    ({"cusip": "54327A-B1"}, ["CUSIP_FORMAT"]),
    ({"cusip": "54327AB18"}, ["CUSIP_CHECK_DIGIT"]),
    ({"cusip": "543270X72"}, []),
    ({"cusip": "54327A004"}, ["CUSIP_CHECK_DIGIT", "CUSIP_PLACEHOLDER"]),
    ({"cusip": "QWERTYUIO"}, ["CUSIP_CHECK_DIGIT", "CUSIP_ISSUER_ANOMALY"]),
    ({"issue_date": "not-a-date"}, ["INVALID_DATE"]),
    ({"issue_date": "05/20/2019"}, []),
    ({"issue_date": "2099-01-01"}, ["FUTURE_ISSUE_DATE", "MATURITY_BEFORE_ISSUE"]),
    ({"issue_date": "2019-05-20T00:00:00Z"}, ["INVALID_DATE"]),
    ({"maturity_date": "2019-05-20"}, ["MATURITY_BEFORE_ISSUE"]),
    ({"maturity_date": "2300-01-01"}, ["INVALID_DATE"]),
    ({"issue_date": "12/31/99", "maturity_date": "2010-01-01"}, []),
    ({"par_value": "0"}, ["NEGATIVE_PAR_VALUE", "PAR_BELOW_MINIMUM"]),
    ({"par_value": "abc"}, ["NON_NUMERIC_PAR"]),
    ({"par_value": "5d"}, ["NON_NUMERIC_PAR"]),
    ({"par_value": "2_500_000"}, []),
    ({"par_value": "nan"}, []),
    ({"par_value": "inf"}, ["PAR_TYPE_MISMATCH", "UNUSUAL_PAR_VALUE"]),
    ({"par_value": "$2,500,000"}, []),
    ({"par_value": "500000000"}, []),
    ({"par_value": "600000000"}, ["PAR_TYPE_MISMATCH"]),
    ({"coupon_rate": "-2.5"}, ["COUPON_TYPE_MISMATCH", "NEGATIVE_COUPON"]),
    ({"coupon_rate": "0", "bond_type": "BAB"}, []),
    ({"coupon_rate": "15.0", "bond_type": "OTHER"}, []),
    ({"coupon_rate": "15.1", "bond_type": "OTHER"}, ["HIGH_COUPON"]),
    ({"coupon_rate": "N/A"}, ["NON_NUMERIC_COUPON"]),
    ({"coupon_rate": "4.25%"}, []),
    ({"state": "XX"}, ["INVALID_STATE", "ISSUER_STATE_MISMATCH"]),
    ({"state": "co"}, []),
    ({"bond_type": "XYZ"}, ["UNKNOWN_BOND_TYPE"]),
    ({"bond_type": "\tGO"}, ["TRAILING_WHITESPACE"]),
    ({"issuer_name": "AB"}, ["SHORT_ISSUER_NAME"]),
    ({"issuer_name": "99"}, ["NUMERIC_ISSUER_NAME", "SHORT_ISSUER_NAME"]),
    ({"issuer_name": "City {of} Boulder"}, ["SPECIAL_CHARS_IN_NAME"]),
    ({"issuer_name": "State of Arkansas", "state": "AR"}, ["ISSUER_STATE_MISMATCH"]),
    ({"issuer_name": "West Virginia Roads", "state": "WV"}, ["ISSUER_STATE_MISMATCH"]),
    ({"issuer_name": "City of Albany New York", "state": "NY"}, []),
    ({"maturity_date": "2055-05-20"}, ["EXCESSIVE_MATURITY_TERM"]),
    ({"maturity_date": "2080-01-15"}, ["EXCESSIVE_MATURITY_TERM", "EXTREME_MATURITY_TERM"]),
    ({"maturity_date": "2080-01-15", "bond_type": None}, ["EXTREME_MATURITY_TERM", "MISSING_VALUE"]),
    ({"maturity_date": "2080-01-15", "bond_type": " "}, ["MISSING_VALUE", "TRAILING_WHITESPACE"]),
    ({"maturity_date": "2060-01-15", "bond_type": "COPS"}, []),
    ({"par_value": "1000"}, []),
    ({"par_value": "999.99"}, ["PAR_BELOW_MINIMUM"]),
    ({"par_value": "500000000.01"}, ["PAR_TYPE_MISMATCH"]),
    ({"par_value": "1000000000", "bond_type": "REV"}, []),
    ({"par_value": "1000000001", "bond_type": "REV"}, ["PAR_TYPE_MISMATCH", "UNUSUAL_PAR_VALUE"]),
    ({"par_value": "50000001", "bond_type": "CD", "maturity_date": "2023-05-20"}, ["PAR_TYPE_MISMATCH"]),
    ({"coupon_rate": "7.0"}, []),
    ({"coupon_rate": "7.01"}, ["COUPON_TYPE_MISMATCH"]),
    ({"coupon_rate": "8.0", "bond_type": "REV"}, []),
    ({"coupon_rate": "2.99", "bond_type": "BAB"}, ["COUPON_TYPE_MISMATCH"]),
    ({"coupon_rate": "5.01", "bond_type": "TAN", "maturity_date": "2020-05-20"}, ["COUPON_TYPE_MISMATCH"]),
    ({"maturity_date": "2021-06-20", "bond_type": "RAN"}, ["EXCESSIVE_MATURITY_TERM"]),
    ({"maturity_date": "2024-05-19", "bond_type": "CD"}, []),
    ({"issuer_name": "\u3000Town Hall", "state": "\x0bNY"}, ["TRAILING_WHITESPACE", "TRAILING_WHITESPACE"]),
    ({"issuer_name": "State of Iowa", "state": "IA"}, []),
]


def table(spark, changes):
    rows = [tuple([i + 2] + [{**VALID, **c}[n] for n in REQUIRED_COLUMNS]) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, "row long, " + ", ".join(f"{c} string" for c in REQUIRED_COLUMNS))


def found(issues):
    return sorted((r["row"], r["rule"]) for r in issues.select("row", "rule").collect())


def test_row_rules(spark):
    issues = validate(table(spark, [c for c, _ in CASES]), bond_pack(AS_OF).only(rules=row_rules()))
    rows = {}
    for row, rule in found(issues):
        rows.setdefault(row, []).append(rule)
    wrong = [(c, rows.get(i + 2, []), want) for i, (c, want) in enumerate(CASES) if rows.get(i + 2, []) != want]
    assert not wrong


def test_messages(spark):
    issues = validate(table(spark, [
        {"par_value": "-1e17"}, {"par_value": "5000000000"}, {"issuer_name": "It's <x>"}, {"state": "NY"},
        {"coupon_rate": "12"}, {"maturity_date": "2056-05-20"}, {"cusip": " 54327AB18"},
    ]), bond_pack(AS_OF).only(rules=row_rules()))
    texts = [r["message"] for r in sorted_issues(issues).collect()]
    assert texts == [
        "Par value must be positive, got -1e+17.",
        "Par value $-100,000,000,000,000,000.00 is below typical minimum for GO instruments($1,000). "
        "May indicate incorrect units (thousands vs actual).",
        "Par value of 5,000,000,000.00 is unusually large — verify.",
        "Par value $5,000,000,000.00 is unusually high for GO instruments(typical max $500,000,000). "
        "Verify amount or classification.",
        "Issuer name contains suspicious characters: <> in 'It's <x>'.",
        "Issuer name 'Town of Boulder Colorado' suggests Colorado (CO), but state column says 'NY'. Verify geographic data.",
        "Coupon rate 12.0% is unusually high for GO instruments (expected 0.0–7.0%). Verify rate or classification.",
        "GO instrument has a 37.0-year term, exceeding the typical max of 30 years. "
        "Verify maturity date or instrument classification.",
        "CUSIP '54327AB18' has an invalid check digit. Expected '7', got '8'. "
        "Possible transposition or fabricated identifier.",
        "Value in 'cusip' has leading/trailing whitespace: '' 54327AB18''.",
    ]


@pytest.mark.parametrize("partitions", [1, 5])
def test_table_rules(spark, partitions):
    rows = table(spark, [
        {"cusip": "A", "issuer_name": "Town"}, {"cusip": "A", "issuer_name": "TOWN"}, {"cusip": "A ", "issuer_name": "town"},
        {"cusip": None, "state": ""}, {"cusip": None, "state": None}, {"cusip": "A", "issuer_name": "Town"},
    ]).repartition(partitions)
    rules = ["DUPLICATE_CUSIP", "DUPLICATE_ROW", "INCONSISTENT_CASING", "COPY_PASTE_SUSPECTED"]
    issues = validate(rows, bond_pack(AS_OF).only(rules=rules))
    got = [(r["row"], r["column"], r["rule"], r["message"]) for r in sorted_issues(issues).collect()]
    assert got == [
        (None, "issuer_name", "INCONSISTENT_CASING",
         "Issuer name has inconsistent casing: 'Town', 'TOWN', 'town'. Standardize to one form."),
        (None, "par_value", "COPY_PASTE_SUSPECTED", "Column 'par_value' has 6/6 rows (100%) with value '2500000'. "
         "Possible copy-paste or default-fill error."),
        (None, "coupon_rate", "COPY_PASTE_SUSPECTED", "Column 'coupon_rate' has 6/6 rows (100%) with value '3.75'. "
         "Possible copy-paste or default-fill error."),
        (3, "cusip", "DUPLICATE_CUSIP", "Duplicate CUSIP 'A' found."),
        (7, "cusip", "DUPLICATE_CUSIP", "Duplicate CUSIP 'A' found."),
        (7, None, "DUPLICATE_ROW", "Row 7 is an exact duplicate of a previous row."),
    ]


def concentrated(spark, values):
    rows = table(spark, [{"issuer_name": None, "par_value": None, "coupon_rate": v} for v in values])
    return [r["message"] for r in validate(rows, bond_pack(AS_OF).only(rules=["COPY_PASTE_SUSPECTED"])).collect()]


def test_concentration_edges(spark):
    """Over 60 % of the filled fields, over 3 copies, 5 rows at least."""
    assert concentrated(spark, list("aaaaaabcde")) == []  # 60 % exactly
    assert len(concentrated(spark, list("aaaaaaabcd"))) == 1
    assert concentrated(spark, ["a", "a", "a", "b", None]) == []  # 3 copies
    assert len(concentrated(spark, ["a", "a ", " a", "a", None])) == 1
    assert concentrated(spark, list("aaaa")) == []  # 4 rows


def test_many_spellings_are_all_listed(spark):
    names = ["".join(c.upper() if i >> n & 1 else c for n, c in enumerate("springfield")) for i in range(1500)]
    (issue,) = validate(table(spark, [{"issuer_name": n} for n in names]), bond_pack(AS_OF).only(rules=["INCONSISTENT_CASING"])).collect()
    assert all(f"'{n}'" in issue["message"] for n in names)


def test_hot_duplicates(spark):
    """Half of all rows share one identifier; the result is that of a plain reading."""
    rows = table(spark, [{"cusip": "HOT" if i % 2 else f"id{i % 7}"} for i in range(400)])
    got = found(validate(rows.repartition(5), bond_pack(AS_OF).only(rules=["DUPLICATE_CUSIP", "DUPLICATE_ROW"])))
    seen, want = set(), []
    for i in range(400):
        value = "HOT" if i % 2 else f"id{i % 7}"
        want += [(i + 2, rule) for rule in ("DUPLICATE_CUSIP", "DUPLICATE_ROW")] if value in seen else []
        seen.add(value)
    assert got == sorted(want)


def test_partitions_change_nothing(spark):
    rows = table(spark, [c for c, _ in CASES])
    one, many = (sorted(map(tuple, validate(rows.repartition(n), bond_pack(AS_OF)).collect()), key=str) for n in (1, 6))
    assert one == many


def test_rounding_of_the_pass_rate_and_of_amounts(spark):
    from pyspark.sql import functions as F

    from assayframe.functions.numbers import money_text

    for errors, rate in ((7, 99.83), (13, 99.67)):
        rows = table(spark, [{"cusip": ""} if i < errors else {} for i in range(4000)])
        assert pass_rate(profile(validate(rows, bond_pack(AS_OF).only(rules=["MISSING_VALUE"]))), rows).first()["pass_rate"] == rate
    values = spark.createDataFrame([(2.675,), (0.125,), (-2.675,), (1234567.005,)], "v double")
    assert [r[0] for r in values.select(money_text(F.col("v"))).collect()] == ["2.67", "0.12", "-2.67", "1,234,567.00"]


def test_texts_in_quotes_are_those_of_repr(spark):
    from pyspark.sql import functions as F

    from assayframe.functions.text import quoted

    texts = ["a\x0bb", "\u3000x", "it's", "\\ \t", "\x85\xa0 '\"", "\u2028\u200a\x1f", "plain"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(quoted(F.col("v"))).collect()] == [repr(t) for t in texts]


def test_constants_stated_again():
    from assayframe.plans import bonds

    assert bonds.COUPON_RANGES["REV"] == (0, 8) and bonds.COUPON_RANGES["BAB"] == (3, 10) and len(bonds.COUPON_RANGES) == 8
    assert bonds.MAX_TERM_YEARS["TAN"] == 2 and bonds.MAX_TERM_YEARS["REV"] == 40 and bonds.PAR_RANGES["CD"] == (1000, 50_000_000)
    assert len(bonds.STATE_CODES) == 55 and len(bonds.STATE_NAMES) == 50 and len(CHECKS) == 17 and len(bonds.BOND_TYPES) == 12


def test_filters_narrow_the_pack():
    pack = bond_pack(AS_OF)
    assert {r.rule for r in pack.only(named_like="cusip_c").rules} == {"CUSIP_CHECK_DIGIT"}
    assert {r.severity for r in pack.only(severity="ERROR").rules} == {"error"}


def test_error_rows_with_a_table_rule_that_names_rows(spark):
    from pyspark.sql import functions as F

    from assayframe.plans.pack import ERROR, TableRule

    whole = TableRule("own", "OWN", ERROR, (), lambda rows, row, data: rows.select(
        row, F.lit(None).cast("string").alias("column"), F.lit("m").alias("message"), F.lit(0).alias("emit_ord")))
    rows = table(spark, [{"cusip": "", "state": ""}, {}, {}])
    counted = profile(validate(rows, bond_pack(AS_OF).only(rules=["MISSING_VALUE"]).add(whole)))
    assert pass_rate(counted, rows).first()["error_rows"] == 3


def test_missing_and_upper_case_columns(spark):
    rows = table(spark, [{}]).drop("state")
    assert found(validate(rows, bond_pack(AS_OF))) == [(None, "MISSING_COLUMN")]
    upper = table(spark, [{"cusip": ""}]).toDF("row", *[f" {c.upper()}" for c in REQUIRED_COLUMNS])
    assert found(validate(upper, bond_pack(AS_OF))) == [(2, "MISSING_VALUE")]
    assert found(run_checks(upper, bond_pack(AS_OF))) == []
    placed = table(spark, [{"cusip": ""}]).withColumnRenamed("row", "ROW_ID")
    assert found(validate(placed, bond_pack(AS_OF), "ROW_ID")) == [(2, "MISSING_VALUE")]
    with pytest.raises(ValueError):
        normalize_columns(upper.toDF(*["A", " a"] + list("cdefghi")))


def test_reports(spark):
    rows = table(spark, [{"cusip": ""}, {}, {"coupon_rate": "15.5", "bond_type": "OTHER"}, {"cusip": None, "par_value": "x"}])
    issues = validate(rows, bond_pack(AS_OF).only(rules=row_rules()))
    counted = profile(issues)
    line = summary(counted, rows, 8, len(CHECKS)).first().asDict()
    assert line == {
        "file_name": "unknown", "total_rows": 4, "total_columns": 8, "validators_run": 17, "errors": 3, "warnings": 1,
        "info": 0, "pass_rate": 50.0, "is_clean": False, "has_errors": True, "band": "poor"}
    assert [tuple(r) for r in rule_counts(counted).collect()] == [
        ("MISSING_VALUE", 2), ("HIGH_COUPON", 1), ("NON_NUMERIC_PAR", 1)]
    health = {r["column"]: r["status"] for r in column_health(counted, REQUIRED_COLUMNS).collect()}
    assert health["cusip"] == "ERRORS" and health["coupon_rate"] == "WARNINGS" and health["state"] == "OK"
    top = first_issues(issues, 3).collect()
    assert len(top) == 3 and {r["left_out"] for r in top} == {1}
    empty = rows.where("false")
    assert summary(profile(validate(empty, bond_pack(AS_OF))), empty, 8, 17).first()["pass_rate"] == 0.0


def test_added_rule(spark):
    from pyspark.sql import functions as F

    pack = bond_pack(AS_OF).add(RowRule(
        "own_check", "NO_VOWEL", WARNING, "issuer_name", ("issuer_name",),
        lambda: ~F.col("issuer_name").rlike("(?i)[aeiou]"), lambda: F.lit("no vowel")))
    assert found(validate(table(spark, [{"issuer_name": "XYZ"}]), pack.only(checks=["own_check"]))) == [(2, "NO_VOWEL")]


def test_report_files(spark, tmp_path):
    import json

    from assayframe.sources.reports import report, write_issues, write_log, write_report

    rows = table(spark, [{"cusip": ""}, {}, {"coupon_rate": "15.5", "bond_type": "OTHER"}])
    issues = validate(rows, bond_pack(AS_OF).only(rules=row_rules()))
    write_report(report(profile(issues), rows, 8, 17, "x.csv", AS_OF), str(tmp_path / "report"))
    write_issues(issues, str(tmp_path / "issues"))
    write_log(issues, str(tmp_path / "log"))
    (part,) = (tmp_path / "report").glob("*.json")
    document = json.loads(part.read_text())
    assert document["summary"]["pass_rate"] == 66.67 and document["summary"]["warnings"] == 1
    assert list(document["by_rule"].items()) == [("MISSING_VALUE", 1), ("HIGH_COUPON", 1)]
    assert document["by_column"]["cusip"] == {"errors": 1, "warnings": 0, "info": 0}
    assert spark.read.json(str(tmp_path / "issues")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).where("field = 'cusip' and row = '2'").count() == 1
