"""Columns worked out once and shared by rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Prepared:
    """A derived column: its name, the columns it reads and the expression."""

    name: str
    needs: tuple[str, ...]
    column: Callable[[], Column]


def source_columns(names: Iterable[str], steps: dict[str, Prepared]) -> set[str]:
    """The table columns that ``names`` (table columns or prepared ones) come from."""
    found: set[str] = set()
    for name in names:
        found |= source_columns(steps[name].needs, steps) if name in steps else {name}
    return found


def all_needs(names: Iterable[str], steps: dict[str, Prepared]) -> set[str]:
    """``names`` and all columns they depend on, prepared ones and those of the table."""
    found: set[str] = set()
    for name in names:
        found |= {name} | (all_needs(steps[name].needs, steps) if name in steps else set())
    return found


def add_prepared(rows: DataFrame, names: Iterable[str], steps: dict[str, Prepared]) -> DataFrame:
    """Add the prepared columns among ``names`` with all they depend on, one projection per depth."""
    depth: dict[str, int] = {}

    def measure(name: str) -> int:
        if name not in steps:
            return 0
        if name not in depth:
            depth[name] = 1 + max((measure(n) for n in steps[name].needs), default=0)
        return depth[name]

    for name in names:
        measure(name)
    for level in range(1, max(depth.values(), default=0) + 1):
        rows = rows.withColumns({n: steps[n].column() for n, d in depth.items() if d == level})
    return rows
