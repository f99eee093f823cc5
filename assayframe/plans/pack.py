"""What a rule is, and how rules are gathered into a pack."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prepared import Prepared, source_columns

ERROR, WARNING, INFO = "error", "warning", "info"
# Metadata of the column first_error where it says nothing: rows with an error are then counted by their numbers.
BY_BITMAP = {"by_bitmap": True}
SEVERITY_RANK = {ERROR: 0, WARNING: 1, INFO: 2}

ISSUE_SCHEMA = T.StructType([
    T.StructField("row", T.LongType()),
    T.StructField("column", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("sev_rank", T.IntegerType()),
    T.StructField("check_ord", T.IntegerType()),
    T.StructField("emit_ord", T.LongType()),
    T.StructField("first_error", T.BooleanType()),
])


@dataclass(frozen=True)
class RowRule:
    """A rule that looks at one row: where ``fires`` is true, an issue with ``message`` is emitted.

    ``needs`` names the columns it reads (of the table, or prepared). A rule whose table columns
    are not all there is left out of the plan.
    """

    check: str
    rule: str
    severity: str
    column: str
    needs: tuple[str, ...]
    fires: Callable[[], Column]
    message: Callable[[], Column]


@dataclass(frozen=True)
class TableRule:
    """A rule over the whole table: a function from its rows to a frame of issues.

    The function gets the rows, the name of the position column and the names of the data
    columns. It returns a frame of row, column, message and emit_ord (the order of the issues
    within the rule), or None where the plan alone shows that there are none. ``of_file`` says that
    its issues name no row.
    """

    check: str
    rule: str
    severity: str
    needs: tuple[str, ...]
    issues: Callable[[DataFrame, str, list[str]], DataFrame | None]
    of_file: bool = False


@dataclass(frozen=True)
class Lookup:
    """Columns that rules read and that are joined to the rows by a prepared column, ``key``.

    ``facts`` makes the table of them, with one row per key: columns named ``key`` and ``columns``, and whether it
    may be sent to all tasks. It gets the rows, in case the facts depend on which keys there are.
    """

    key: str
    columns: tuple[str, ...]
    facts: Callable[[DataFrame], tuple[DataFrame, bool]]


@dataclass(frozen=True)
class RulePack:
    """Checks in reporting order, the rules of each, and the columns they share."""

    required: tuple[str, ...]
    checks: tuple[str, ...]
    rules: tuple[RowRule | TableRule, ...]
    prepared: dict[str, Prepared] = field(default_factory=dict)
    lookups: tuple[Lookup, ...] = ()

    def look_up(self, *lookups: Lookup) -> "RulePack":
        """A pack whose rules may also need the columns of these lookups."""
        steps = {c: Prepared(c, (found.key,), lambda c=c: F.col(c)) for found in lookups for c in found.columns}
        return replace(self, lookups=(*self.lookups, *lookups), prepared={**self.prepared, **steps})

    def add(self, rule: RowRule | TableRule, *prepared: Prepared) -> "RulePack":
        """A pack with one more rule; a new check name goes to the end of the list."""
        checks = self.checks if rule.check in self.checks else (*self.checks, rule.check)
        steps = {**self.prepared, **{p.name: p for p in prepared}}
        return replace(self, checks=checks, rules=(*self.rules, rule), prepared=steps)

    def only(
        self, checks: Iterable[str] | None = None, rules: Iterable[str] | None = None,
        severity: str | None = None, named_like: str | None = None,
    ) -> "RulePack":
        """A pack of the named checks or rules: what is not asked for is never planned.

        ``named_like`` keeps rules whose name contains it; case does not matter. Checks keep their
        numbers, so the issues sort as they would with the full pack.
        """
        def wanted(r: RowRule | TableRule) -> bool:
            return (
                (checks is None or r.check in set(checks))
                and (rules is None or r.rule in set(rules))
                and (severity is None or r.severity == severity.lower())
                and (named_like is None or named_like.upper() in r.rule.upper())
            )

        return replace(self, rules=tuple(r for r in self.rules if wanted(r)))

    def runnable(self, columns: Iterable[str]) -> list[RowRule | TableRule]:
        """The rules for which all table columns are there."""
        there = set(columns)
        return [r for r in self.rules if source_columns(r.needs, self.prepared) <= there]
