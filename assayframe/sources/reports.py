"""Writing results: the report document as JSON, the issues as a table of their own."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.issues import issue_log, sort_key, sorted_issues
from ..operators.positions import durable
from ..operators.summary import column_stats, per_rule, summary
from ..plans.pack import SEVERITY_RANK, RowRule, RulePack


def report(profile: DataFrame, rows: DataFrame, total_columns: int, checks: int, file_name: str,
           generated_at: datetime) -> DataFrame:
    """One row: totals, issues per rule (most frequent first) and issues per column.

    ``profile`` is that of :func:`assayframe.operators.summary.profile`; it has a few rows per rule and
    is kept in the shared folder, since each of the three parts reads it. Each part is a line of its
    own with the others null. The issues themselves are written by ``write_issues``.
    """
    profile = durable(profile)
    totals = summary(profile, rows, total_columns, checks, file_name).select(F.struct(
        "total_rows", "total_columns", "validators_run", "errors", "warnings", "info", "pass_rate").alias("summary"))
    # at most one entry per rule, and one per column
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "seen", "rule")))
    by_rule = per_rule(profile).agg(F.map_from_entries(F.transform(
        ranked, lambda r: F.struct(r["rule"], -r["less"]))).alias("by_rule"))
    by_column = column_stats(profile).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("column", F.struct("errors", "warnings", "info"))))).alias("by_column"))
    parts = totals.unionByName(by_rule, allowMissingColumns=True).unionByName(by_column, allowMissingColumns=True)
    return parts.agg(
        F.lit(file_name).alias("file_name"), F.lit(generated_at.isoformat()).alias("generated_at"),
        *[F.first(part, ignorenulls=True).alias(part) for part in ("summary", "by_rule", "by_column")])


def write_report(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def write_issues(issues: DataFrame, path: str, form: str = "json", ordered: bool = True) -> None:
    """All issues, in parallel; ``ordered`` sorts them across the files of the folder.

    Where more than one output is made of the same issues, pass stored ones (``staged``).
    """
    shown = (sorted_issues(issues) if ordered else issues).select("row", "column", "severity", "rule", "message")
    shown.write.mode("overwrite").format(form).save(path)


def write_and_profile(
    issues: DataFrame, pack: RulePack, columns: Sequence[str], path: str, form: str = "json", ordered: bool = True,
) -> DataFrame:
    """As ``write_issues``, and the profile of what was written, counted by the same job.

    ``columns`` are those of the table. The counts are made where the files are written, behind the sort, in the last
    stage, so tasks that run again count once. A rule or column that the pack does not know stops the run.
    """
    if issues.schema["first_error"].metadata.get("by_bitmap"):
        raise ValueError("rules of the whole table name rows as errors: store the issues and take their profile")
    kinds = list(dict.fromkeys(
        (r.rule, c, r.severity) for r in pack.rules
        for c in ((r.column,) if isinstance(r, RowRule) else (None, *dict.fromkeys((*pack.required, *columns))))))
    rules = list(dict.fromkeys(rule for rule, _, _ in kinds))
    place = F.struct(*sort_key())
    is_kind = [(F.col("rule") == r) & F.col("column").eqNullSafe(F.lit(c)) & (F.col("severity") == s) for r, c, s in kinds]
    counted = Observation()
    watched = (sorted_issues(issues) if ordered else issues).observe(
        counted, F.count(F.lit(1)).alias("n"), F.count_if("first_error").alias("error_rows"),
        *[F.count_if(match).alias(f"n{i}") for i, match in enumerate(is_kind)],
        *[F.min(F.when(F.col("rule") == r, place)).alias(f"seen{i}") for i, r in enumerate(rules)])
    watched.select("row", "column", "severity", "rule", "message").write.mode("overwrite").format(form).save(path)
    found = counted.get
    lines = [(r, c, s, SEVERITY_RANK[s], found[f"n{i}"], found[f"seen{rules.index(r)}"], 0) for i, (r, c, s) in enumerate(kinds) if found[f"n{i}"]]
    if sum(line[4] for line in lines) != found["n"]:
        raise ValueError("there are issues of rules or columns that the pack does not name")
    if lines:
        lines[0] = (*lines[0][:-1], found["error_rows"])
    seen = issues.select(place.alias("seen")).schema["seen"].dataType.simpleString()
    return issues.sparkSession.createDataFrame(lines, f"rule string, column string, severity string, sev_rank int, n long, seen {seen}, error_rows long")


def write_log(issues: DataFrame, path: str) -> None:
    """The printed log as CSV with a header."""
    issue_log(sorted_issues(issues)).write.mode("overwrite").option("header", True).csv(path)
