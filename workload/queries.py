"""The registered queries: one per operator, each over the whole derived table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.prepared import add_prepared
from assayframe.operators import issues as issue_ops
from assayframe.operators import summary as counts
from assayframe.operators.positions import number_sorted_rows, shared_folder
from assayframe.operators.table_rules import spellings
from assayframe.plans.bond_specs import bond_specs, lookup_tables, role_table, spec_table
from assayframe.plans.bonds import CHECKS, REQUIRED_COLUMNS, bond_pack
from assayframe.plans.compiler import compile_pack, roles_of, specs_of
from assayframe.plans.engine import normalize_columns, validate
from assayframe.plans.pack import RulePack
from assayframe.session import tune
from assayframe.sources.files import read_csv, read_parquet
from assayframe.sources.reports import report, write_and_profile

from .securities import AS_OF, securities

Query = Callable[[SparkSession, str], DataFrame]
ROW = "row_id"

# Query -> the rules it runs; nothing else is planned.
RULES_OF = {
    "missing_values": ("MISSING_VALUE",),
    "id_format": ("CUSIP_FORMAT",),
    "id_check_digit": ("CUSIP_CHECK_DIGIT",),
    "id_issuer_alpha": ("CUSIP_ISSUER_ANOMALY",),
    "id_placeholder": ("CUSIP_PLACEHOLDER",),
    "invalid_date": ("INVALID_DATE",),
    "future_date": ("FUTURE_ISSUE_DATE",),
    "date_order": ("MATURITY_BEFORE_ISSUE",),
    "par_range": ("NEGATIVE_PAR_VALUE", "UNUSUAL_PAR_VALUE", "NON_NUMERIC_PAR"),
    "coupon_range": ("NEGATIVE_COUPON", "HIGH_COUPON", "NON_NUMERIC_COUPON"),
    "invalid_state": ("INVALID_STATE",),
    "unknown_type": ("UNKNOWN_BOND_TYPE",),
    "name_quality": ("SHORT_ISSUER_NAME", "NUMERIC_ISSUER_NAME"),
    "coupon_by_type": ("COUPON_TYPE_MISMATCH",),
    "term_by_type": ("EXCESSIVE_MATURITY_TERM",),
    "term_extreme": ("EXTREME_MATURITY_TERM",),
    "par_by_type": ("PAR_TYPE_MISMATCH", "PAR_BELOW_MINIMUM"),
    "whitespace": ("TRAILING_WHITESPACE",),
    "special_chars": ("SPECIAL_CHARS_IN_NAME",),
    "name_state_mismatch": ("ISSUER_STATE_MISMATCH",),
    "duplicate_ids": ("DUPLICATE_CUSIP",),
    "duplicate_rows": ("DUPLICATE_ROW",),
    "inconsistent_casing": ("INCONSISTENT_CASING",),
    "value_concentration": ("COPY_PASTE_SUSPECTED",),
}

# Query -> the rules it runs from a pack compiled from tables, whose lists and limits are joined tables too.
COMPILED = {
    "codes_by_table": ("INVALID_STATE", "UNKNOWN_BOND_TYPE"),
    "limits_by_table": ("COUPON_TYPE_MISMATCH", "EXCESSIVE_MATURITY_TERM", "PAR_TYPE_MISMATCH", "PAR_BELOW_MINIMUM"),
    "names_by_table": ("ISSUER_STATE_MISMATCH",),
}


@cache
def _pack(application: str) -> RulePack:
    return bond_pack(AS_OF)


def pack_of(spark: SparkSession) -> RulePack:
    """The pack of this session; queries share its expressions."""
    return _pack(spark.sparkContext.applicationId)


def _issues(spark: SparkSession, sf_dir: str, rules: tuple[str, ...] | None = None) -> DataFrame:
    return validate(securities(tune(spark), sf_dir), pack_of(spark).only(rules=rules), ROW)


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select("row", "column", "severity", "rule")


def _rule_query(rules: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: _issues(spark, sf_dir, rules).select("row", "column", "severity", "rule", "message")


def _narrowed(**wanted: str) -> Query:
    """The filter narrows the pack: only the wanted rules are tested."""
    return lambda spark, sf_dir: _shown(validate(securities(tune(spark), sf_dir), pack_of(spark).only(**wanted), ROW))


def _counted(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_issues(spark, sf_dir))


def _profiled(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(counts.profile(_issues(spark, sf_dir)))


def _compiled_query(rules: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pack = compile_pack(bond_specs(), roles_of(role_table(spark)), lookup_tables(spark), AS_OF)
        return validate(securities(tune(spark), sf_dir), pack.only(rules=rules), ROW).select("row", "column", "severity", "rule", "message")

    return query


def _compiled_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, compiled from a table of parameters, over columns of other names; in the result they have the usual ones."""
    renamed = {c: f"field_{n}" for n, c in enumerate(REQUIRED_COLUMNS)}
    pack = compile_pack(specs_of(spec_table(spark)), roles_of(role_table(spark, renamed)), lookup_tables(spark), AS_OF)
    issues = validate(securities(tune(spark), sf_dir).withColumnsRenamed(renamed), pack, ROW)
    return _shown(issues.replace({f: c for c, f in renamed.items()}, subset="column"))


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = securities(tune(spark), sf_dir)
    return normalize_columns(table.toDF(*[f" {c.upper()} " for c in table.columns]))


def _row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return number_sorted_rows(orders, ["o_orderkey"])


def _file_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/orders.parquet").select("row", "o_orderkey", "o_custkey")


def _parsed(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return add_prepared(securities(tune(spark), sf_dir), names, pack_of(spark).prepared)


def _parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["_number_par_value", "_number_coupon_rate"]
    return _parsed(spark, sf_dir, names).select(F.col(ROW).alias("row"), *[
        F.col(n).alias(a) for n, a in zip(names, ("par", "rate"))])


def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["_moment_issue_date", "_moment_maturity_date"]
    return _parsed(spark, sf_dir, names).select(F.col(ROW).alias("row"), *[
        F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(a) for n, a in zip(names, ("issued", "matures"))])


def _missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns are gone: they are reported, the rules that need them are left out, all others run."""
    table = securities(tune(spark), sf_dir).drop("state", "bond_type")
    return validate(table, pack_of(spark), ROW).groupBy("rule", "column").agg(F.count("*").alias("n"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = securities(spark, sf_dir)
    return counts.summary(counts.profile(_issues(spark, sf_dir)), table, len(REQUIRED_COLUMNS), len(CHECKS), "securities")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document, its maps as text."""
    table = securities(spark, sf_dir)
    document = report(counts.profile(_issues(spark, sf_dir)), table, len(REQUIRED_COLUMNS), len(CHECKS), "securities", AS_OF)
    return document.select("file_name", "generated_at", "summary.*", F.to_json("by_rule").alias("by_rule"), F.to_json("by_column").alias("by_column"))


def _report_while_writing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document of the job that writes the issues."""
    table = securities(tune(spark), sf_dir)
    path = f"{shared_folder(spark)}/issues-{uuid.uuid4().hex}"
    profile = write_and_profile(_issues(spark, sf_dir), pack_of(spark), table.columns, path)
    document = report(profile, table, len(REQUIRED_COLUMNS), len(CHECKS), "securities", AS_OF)
    return document.select("file_name", "generated_at", "summary.*", F.to_json("by_rule").alias("by_rule"), F.to_json("by_column").alias("by_column"))


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table written as CSV in several files, nulls as a null token, and read back with row numbers."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table = securities(tune(spark), sf_dir).repartitionByRange(4, ROW).sortWithinPartitions(ROW)
    table.write.options(header=True, nullValue="NULL", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    return read_csv(spark, path)


def _sorted(issues: DataFrame) -> DataFrame:
    return issue_ops.sorted_issues(issues).drop("message", "first_error")


def _top(issues: DataFrame) -> DataFrame:
    return issue_ops.first_issues(issues, 50).select("row", "column", "severity", "rule", "left_out")


def queries() -> dict[str, Query]:
    return {
        "normalize_columns": _normalize,
        "row_numbers": _row_numbers,
        "file_row_numbers": _file_row_numbers,
        "csv_rows": _csv_rows,
        "parse_numbers": _parse_numbers,
        "parse_dates": _parse_dates,
        **{key: _rule_query(rules) for key, rules in RULES_OF.items()},
        **{key: _compiled_query(rules) for key, rules in COMPILED.items()},
        "compiled_issues": _compiled_issues,
        "casing_variants": lambda spark, sf_dir: spellings(securities(tune(spark), sf_dir), ROW, "issuer_name"),
        "missing_columns": _missing_columns,
        "all_issues": _counted(_shown),
        "issues_sorted": _counted(_sorted),
        "filter_severity": _narrowed(severity="error"),
        "filter_rule": _narrowed(named_like="cusip"),
        "top_issues": _counted(_top),
        "issue_log": _counted(issue_ops.issue_log),
        "severity_counts": _profiled(counts.severity_counts),
        "pass_rate": lambda spark, sf_dir: counts.pass_rate(counts.profile(_issues(spark, sf_dir)), securities(spark, sf_dir)),
        "summary": _summary,
        "report_document": _report,
        "report_while_writing": _report_while_writing,
        "rule_counts": _profiled(counts.rule_counts),
        "rule_severity": _profiled(counts.rule_severity),
        "rule_share": _profiled(counts.rule_share),
        "column_stats": _profiled(counts.column_stats),
        "column_health": _profiled(lambda p: counts.column_health(p, REQUIRED_COLUMNS)),
        "column_overview": _profiled(counts.column_overview),
    }
