"""Counts over the table of issues. Each is an aggregate with a small result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import two_decimals
from .issues import sort_key
from .positions import durable

# From which pass rate on a table counts as good or fair.
GOOD_PASS_RATE, FAIR_PASS_RATE = 90.0, 60.0


KIND = ("rule", "column", "severity", "sev_rank")


def profile(issues: DataFrame) -> DataFrame:
    """Issues by rule, column and severity: at most a few rows for each rule.

    All counts below are made from this table, so a validation runs once however many are wanted.
    ``seen`` is the first issue in order; ``error_rows`` adds up to the records with an error.
    """
    if issues.schema["first_error"].metadata.get("by_bitmap"):
        return _profile_by_bitmap(issues)
    return issues.groupBy(*KIND).agg(
        F.count("*").alias("n"), F.min(F.struct(*sort_key())).alias("seen"),
        F.count_if("first_error").alias("error_rows"))


def _profile_by_bitmap(issues: DataFrame) -> DataFrame:
    """Where several rules of the whole table may name one record: its number is a bit in the map of its range of numbers.

    The maps of one range are put together, so a record counts once, and neither sorts nor windows are needed. The number
    of records is in a row of its own, without a rule.
    """
    place = F.when((F.col("severity") == "error") & F.col("row").isNotNull(), F.bitmap_bit_position("row"))
    ranges = durable(issues.groupBy(*KIND, F.bitmap_bucket_number("row").alias("range")).agg(
        F.count("*").alias("n"), F.min(F.struct(*sort_key())).alias("seen"), F.bitmap_construct_agg(place).alias("bits")))
    zero = F.lit(0).cast("long")
    kinds = ranges.groupBy(*KIND).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), zero.alias("error_rows"))
    maps = ranges.groupBy("range").agg(F.bitmap_or_agg("bits").alias("bits"))
    rows = maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), zero).alias("error_rows")).withColumn("n", zero)
    return kinds.unionByName(rows, allowMissingColumns=True)


def _count(severity: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("n"))), F.lit(0))


def severity_counts(profile: DataFrame) -> DataFrame:
    return profile.agg(
        _count("error").alias("errors"), _count("warning").alias("warnings"), _count("info").alias("info"))


def _percent_passed(error_rows: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(two_decimals((1 - error_rows / total) * 100))


def _totals(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: number of records, of issues by severity and of records with an error.

    Records and issues are counted apart and the two lines added up, so nothing is joined.
    """
    zero = F.lit(0).cast("long")
    names = ("errors", "warnings", "info", "error_rows")
    counted = profile.agg(
        _count("error").alias("errors"), _count("warning").alias("warnings"), _count("info").alias("info"),
        F.coalesce(F.sum("error_rows"), zero).alias("error_rows")).withColumn("total_rows", zero)
    recorded = rows.agg(F.count("*").alias("total_rows")).withColumns({n: zero for n in names})
    return counted.unionByName(recorded).agg(*[F.sum(n).alias(n) for n in (*names, "total_rows")])


def pass_rate(profile: DataFrame, rows: DataFrame) -> DataFrame:
    """Percentage of records without an error; 0 for an empty table."""
    return _totals(profile, rows).select(
        "total_rows", "error_rows", _percent_passed(F.col("error_rows"), F.col("total_rows")).alias("pass_rate"))


def summary(profile: DataFrame, rows: DataFrame, total_columns: int, checks: int, file_name: str = "unknown") -> DataFrame:
    """One row with all totals. ``is_clean`` allows infos; ``has_errors`` ignores warnings."""
    rate = _percent_passed(F.col("error_rows"), F.col("total_rows"))
    return _totals(profile, rows).select(
        F.lit(file_name).alias("file_name"), "total_rows", F.lit(total_columns).alias("total_columns"),
        F.lit(checks).alias("validators_run"), "errors", "warnings", "info", rate.alias("pass_rate"),
        ((F.col("errors") == 0) & (F.col("warnings") == 0)).alias("is_clean"),
        (F.col("errors") > 0).alias("has_errors"),
        F.when(rate >= GOOD_PASS_RATE, "good").when(rate >= FAIR_PASS_RATE, "fair").otherwise("poor").alias("band"),
    )


def per_rule(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("rule").isNotNull()).groupBy("rule").agg(
        F.sum("n").alias("n"), F.min("sev_rank").alias("sev_rank"), F.min("seen").alias("seen"))


def rule_counts(profile: DataFrame) -> DataFrame:
    """Issues per rule, most frequent first; equal counts in order of first appearance."""
    return per_rule(profile).orderBy(F.desc("n"), "seen").select("rule", "n")


def rule_severity(profile: DataFrame) -> DataFrame:
    """The gravest severity of each rule's issues."""
    severity = F.get(F.lit(["error", "warning", "info"]), F.col("sev_rank"))
    return per_rule(profile).orderBy(F.desc("n"), "seen").select("rule", "n", severity.alias("severity"))


def rule_share(profile: DataFrame) -> DataFrame:
    """Each rule's count relative to the largest one, and as bars of 25 and 15 characters."""
    # the window runs over one row per rule
    share = F.col("n") / F.max("n").over(Window.partitionBy())
    return per_rule(profile).withColumn("share", share).orderBy(F.desc("n"), "seen").select(
        "rule", "n", "share", F.floor(F.col("share") * 25).cast("int").alias("bar_25"),
        F.floor(F.col("share") * 15).cast("int").alias("bar_15"),
        F.bround(F.col("share") * 100).cast("int").alias("percent"))


def column_stats(profile: DataFrame) -> DataFrame:
    """Issues per column and severity, for columns with an issue."""
    return profile.where(F.col("column").isNotNull()).groupBy("column").agg(
        _count("error").alias("errors"), _count("warning").alias("warnings"), _count("info").alias("info"))


def _status() -> Column:
    return F.when(F.col("errors") > 0, "ERRORS").when(F.col("warnings") > 0, "WARNINGS").otherwise("OK")


def column_health(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A status for each of the given columns, whether or not it has issues."""
    listed = profile.sparkSession.range(1, numPartitions=1).select(
        F.explode(F.lit(list(columns))).alias("column"), F.lit(0).cast("long").alias("errors"),
        F.lit(0).cast("long").alias("warnings"), F.lit(True).alias("asked"))
    found = column_stats(profile).select("column", "errors", "warnings", F.lit(False).alias("asked"))
    return (
        listed.unionByName(found).groupBy("column")
        .agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.max("asked").alias("asked"))
        .where("asked").select("column", "errors", "warnings", _status().alias("status"))
    )


def column_overview(profile: DataFrame) -> DataFrame:
    """Columns with an error or warning, by name."""
    return (
        column_stats(profile).where((F.col("errors") > 0) | (F.col("warnings") > 0))
        .select("column", "errors", "warnings", _status().alias("status")).orderBy("column")
    )
