"""From a table and a pack to the table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prepared import add_prepared, all_needs
from ..operators.lookups import with_facts
from .pack import BY_BITMAP, ERROR, ISSUE_SCHEMA, SEVERITY_RANK, Lookup, RowRule, RulePack, TableRule


def normalize_columns(table: DataFrame) -> DataFrame:
    """Column names in lower case without surrounding white space."""
    names = [c.lower().strip() for c in table.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns have the same name after normalization: {', '.join(twice)}")
    return table.toDF(*names)


def validate(table: DataFrame, pack: RulePack, row: str = "row") -> DataFrame:
    """All issues of a table, as a lazy frame in no particular order.

    ``row`` names the column that holds each record's position. It is not part of the data: no
    rule sees it as a value. Other columns are read as text.
    """
    return run_checks(normalize_columns(table), pack, row.lower().strip())


def run_checks(table: DataFrame, pack: RulePack, row: str = "row") -> DataFrame:
    """As ``validate``, with column names taken as they are.

    All row rules share one scan. Every table rule reads only the columns it needs.
    """
    data = [c for c in table.columns if c != row]
    rows = table.select(
        F.col(f"`{row}`").cast("long").alias(row), *[F.col(f"`{c}`").cast("string").alias(c) for c in data])
    runnable = pack.runnable(data)
    row_rules = [r for r in runnable if isinstance(r, RowRule)]
    frames = [_row_issues(rows, pack, row_rules, row)] if row_rules else []
    for rule in runnable:
        found = rule.issues(rows, row, data) if isinstance(rule, TableRule) else None
        if found is not None:
            frames.append(_ranked(found, pack, rule))
    if not frames:
        return table.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    issues = reduce(DataFrame.unionByName, frames)
    if any(isinstance(r, TableRule) and r.severity == ERROR and not r.of_file for r in runnable):
        # a row's errors then come from several frames: which one is the first is left open, and rows are counted by bitmaps
        issues = issues.withColumn("first_error", F.lit(None).cast("boolean").alias("first_error", metadata=BY_BITMAP))
    return issues


def _facts(lookup: Lookup, rows: DataFrame) -> tuple[DataFrame, str, bool]:
    facts, small = lookup.facts(rows)
    return facts, lookup.key, small


def _emit_order(pack: RulePack) -> dict[int, int]:
    """Position of each rule within its check."""
    seen: dict[str, int] = {}
    order = {}
    for rule in pack.rules:
        order[id(rule)] = seen[rule.check] = seen.get(rule.check, -1) + 1
    return order


def _row_issues(rows: DataFrame, pack: RulePack, rules: list[RowRule], row: str) -> DataFrame:
    """One projection tests every rule; rows then fan out to the rules that fired.

    Only the rule's number travels through the fan-out. What is constant per rule is looked up
    by that number, and messages are built last, so a plan that counts issues never makes them.
    """
    needed = dict.fromkeys(n for rule in rules for n in rule.needs)
    steps = pack.prepared
    wanted = all_needs(needed, steps)
    for lookup in pack.lookups:
        if wanted & set(lookup.columns):
            # joined ahead of the fused pass; what has been worked out for the key is not worked out again
            rows = add_prepared(rows, [lookup.key], steps)
            rows = with_facts(rows, *_facts(lookup, rows))
            steps = {n: s for n, s in steps.items() if n not in rows.columns}
    prepared = add_prepared(rows, needed, steps)
    tested = F.array(*[F.when(r.fires(), F.lit(i)).otherwise(F.lit(-1)) for i, r in enumerate(rules)])
    fired = prepared.withColumn("_fired", F.array_remove(tested, -1))
    errors = [i for i, r in enumerate(rules) if r.severity == ERROR]
    first_error = F.get(F.array_intersect("_fired", F.lit(errors)), 0) if errors else F.lit(None).cast("int")
    fired = fired.withColumn("_first_error", first_error)
    # not the inner form: for that one the optimizer tests the array's size in a filter at the scan
    # and works out every rule twice
    hits = fired.select("*", F.explode_outer("_fired").alias("_rule")).where(F.col("_rule").isNotNull())

    def constant(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))

    order = _emit_order(pack)
    message = F.coalesce(*[F.when(F.col("_rule") == i, r.message()) for i, r in enumerate(rules)])
    return hits.select(
        F.col(row).alias("row"),
        constant([r.column for r in rules]).alias("column"),
        constant([r.severity for r in rules]).alias("severity"),
        constant([r.rule for r in rules]).alias("rule"),
        message.alias("message"),
        constant([SEVERITY_RANK[r.severity] for r in rules]).alias("sev_rank"),
        constant([pack.checks.index(r.check) for r in rules]).alias("check_ord"),
        constant([order[id(r)] for r in rules]).cast("long").alias("emit_ord"),
        F.coalesce(F.col("_rule") == F.col("_first_error"), F.lit(False)).alias("first_error"),
    )


def _ranked(issues: DataFrame, pack: RulePack, rule: TableRule) -> DataFrame:
    return issues.select(
        F.col("row").cast("long").alias("row"), F.col("column").cast("string").alias("column"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.rule).alias("rule"), "message",
        F.lit(SEVERITY_RANK[rule.severity]).alias("sev_rank"),
        F.lit(pack.checks.index(rule.check)).alias("check_ord"),
        F.col("emit_ord").cast("long").alias("emit_ord"), F.lit(False).alias("first_error"),
    )
