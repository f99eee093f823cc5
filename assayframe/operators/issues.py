"""Sorting, filtering and cutting the table of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Fixed value: what stands for "no row" or "no column" in a printed log.
NO_VALUE = "—"
# So many issues of a printed list may be returned to the driver.
MOST_RETURNED = 10_000


def sort_key() -> list[Column]:
    """Row (issues of the whole file first), then severity, then the order of the checks."""
    return [F.coalesce(F.col("row"), F.lit(0)), F.col("sev_rank"), F.col("check_ord"), F.col("emit_ord")]


def sorted_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy(*sort_key())


def filter_issues(issues: DataFrame, severity: str | None = None, rule: str | None = None) -> DataFrame:
    """Issues of a severity, and of rules whose name contains ``rule``; case does not matter.

    For stored issues. Before a validation, narrow the pack instead (``pack.only``): rules that are
    not asked for are then not tested.
    """
    if severity:
        issues = issues.where(F.upper("severity") == severity.upper())
    if rule:
        issues = issues.where(F.contains(F.upper("rule"), F.lit(rule.upper())))
    return issues


def first_issues(issues: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` issues in order, with ``left_out``, the number of those that follow.

    A limit of zero or less means all. The first ones are found by a top-k per task, not a sort, and the same job
    counts the rest: the validation runs once, at once. Its last stage returns the rows, so a task that runs
    again is counted once. Limits above ``MOST_RETURNED`` do not pass through the driver; the issues are then read
    twice, so store them first (``staged``).
    """
    if limit <= 0:
        return sorted_issues(issues).withColumn("left_out", F.lit(0).cast("long"))
    if limit > MOST_RETURNED:
        total = issues.select(F.count(F.lit(1))).scalar()
        return sorted_issues(issues).limit(limit).withColumn("left_out", F.greatest(total - limit, F.lit(0)).cast("long"))
    counted = Observation()
    rows = sorted_issues(issues.observe(counted, F.count(F.lit(1)).alias("n"))).limit(limit).collect()
    first = issues.sparkSession.createDataFrame(rows, issues.schema)
    return sorted_issues(first).withColumn("left_out", F.lit(max(0, counted.get["n"] - limit)).cast("long"))


def issue_log(issues: DataFrame) -> DataFrame:
    """The columns of a printed log, all text."""
    return issues.select(
        F.coalesce(F.col("row").cast("string"), F.lit(NO_VALUE)).alias("row"),
        F.coalesce("column", F.lit(NO_VALUE)).alias("field"),
        F.upper("severity").alias("severity"), "rule", F.col("message").alias("description"),
    )
