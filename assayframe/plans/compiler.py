"""From tables of parameters to a rule pack.

A rule is a line of a table: its check, name, severity and message, the ``role`` of the field it looks at, its
``kind``, and what that kind needs: a ``pattern``, a ``bound``, a second role in ``other``, the name of a ``lookup`` table.
A second table says which column holds each role. Nothing about a certain business is in here, so other tables
are checked by other lines. Lookup tables are joined, not written into expressions, so they may be of any size.

Messages name their fields in braces: ``{column}`` and ``{value}`` everywhere, others by kind:

| Kind | An issue where | Fields |
| --- | --- | --- |
| ``required`` | the field is null or blank | |
| ``format`` | it does not match ``pattern`` | |
| ``check digit`` | it matches ``pattern`` and its 9th character is not the check digit | expected, got |
| ``matches`` | in upper case it matches ``pattern`` | group (the first one of the pattern) |
| ``holds`` | ``pattern`` is found in it | found (different matches) |
| ``shorter`` | it has fewer than ``bound`` characters | |
| ``untrimmed`` | it begins or ends with white space | shown |
| ``member`` | it is not in ``lookup`` (column code) | known |
| ``number`` | it is no number | |
| ``below``, ``above`` | the number is below or above ``bound`` (``at`` it as well where that is set) | number, money |
| ``below limit``, ``above limit`` | the number is beyond low or high of ``lookup`` by the code in ``other`` (``nonzero``: 0 is allowed) | number, money, type, low, high, bound |
| ``date`` | it is no date (``clock``: one with a UTC offset is none either) | |
| ``future`` | the date is after the moment of the run | |
| ``not after`` | the date is not after that in ``other`` | other |
| ``term above``, ``term above limit`` | the years from ``other`` to the date exceed ``bound``, or most of ``lookup`` by the code in ``third`` | term, type, most |
| ``named`` | a name of ``lookup`` (name, code, ord) is in it, with another code than ``other`` states | name, code, stated |
| ``columns`` | a column of the roles is missing | |
| ``repeated value`` | the value stands in an earlier record | |
| ``repeated row`` | all columns equal those of an earlier record | row |
| ``spelling`` | values differ in case only | variants |
| ``share`` | one value fills over ``bound`` of the fields, for each role in ``role`` (comma-separated) | n, non_null, percent |
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import EARLIEST, LATEST, date_steps, is_undated
from ..functions.identifiers import check_digit
from ..functions.numbers import float_text, is_not_number, money_text, number_text, parse_number
from ..functions.prepared import Prepared
from ..functions.text import fill, quoted, strip
from ..operators import table_rules
from ..operators.lookups import is_small, names_in, one_per_key
from ..operators.positions import durable
from .pack import Lookup, RowRule, RulePack, TableRule

DAYS_PER_YEAR = 365.25
# A message lists so many codes at most; a table of rules or roles has so many lines at most.
SHOWN_CODES, MOST_LINES = 100, 10_000

SPEC_SCHEMA = ("check string, rule string, severity string, kind string, role string, message string, other string, third string, "
               "pattern string, bound double, at boolean, nonzero boolean, clock boolean, lookup string")


@dataclass(frozen=True)
class Spec:
    """One line of the table of rules."""

    check: str
    rule: str
    severity: str
    kind: str
    role: str
    message: str
    other: str | None = None
    third: str | None = None
    pattern: str | None = None
    bound: float | None = None
    at: bool | None = None
    nonzero: bool | None = None
    clock: bool | None = None
    lookup: str | None = None


def specs_of(table: DataFrame) -> list[Spec]:
    """The lines of a table of rules in the order of its column ``ord``."""
    names = [c for c in Spec.__dataclass_fields__ if c in table.columns]
    lines = table.orderBy("ord").select(*names).limit(MOST_LINES + 1).collect()
    if len(lines) > MOST_LINES:
        raise ValueError(f"more than {MOST_LINES} rules")
    return [Spec(**r.asDict()) for r in lines]


def roles_of(table: DataFrame) -> dict[str, tuple[str, str]]:
    """Role -> column and symbols that its numbers may hold, in the order of ``ord``."""
    lines = table.orderBy("ord").select("role", "column", F.coalesce("symbols", F.lit(""))).limit(MOST_LINES + 1).collect()
    if len(lines) > MOST_LINES or len({r[0] for r in lines}) < len(lines):
        raise ValueError("roles must differ, and there may be so many only")
    return {r[0]: (r[1], r[2]) for r in lines}


def compile_pack(
    specs: Iterable[Spec], roles: Mapping[str, tuple[str, str]], lookups: Mapping[str, DataFrame], as_of: datetime | None = None,
    earliest: str = EARLIEST, latest: str = LATEST,
) -> RulePack:
    """The pack of these rules over the columns that hold the roles. ``as_of``: the moment dates are judged by."""
    specs = list(specs)
    if any(c in column for column, _ in roles.values() for c in ".`"):
        raise ValueError("columns of roles must have names without dots and backticks")
    made = _Compiler(roles, dict(lookups), as_of or datetime.now(timezone.utc).replace(tzinfo=None), earliest, latest)
    rules = []
    for spec in specs:
        if spec.kind not in KINDS:
            raise ValueError(f"{spec.rule}: there is no kind {spec.kind!r}")
        unknown = [r for r in (*(spec.role or "").split(","), spec.other, spec.third) if r and r not in roles]
        if unknown:
            raise ValueError(f"{spec.rule}: no column holds the role {unknown[0]!r}")
        if spec.lookup and spec.lookup not in lookups:
            raise ValueError(f"{spec.rule}: there is no lookup {spec.lookup!r}")
        rule = KINDS[spec.kind](made, spec)
        rules.append(replace(rule, fires=cache(rule.fires), message=cache(rule.message)) if isinstance(rule, RowRule) else rule)
    required = tuple(column for column, _ in roles.values())
    pack = RulePack(required, tuple(dict.fromkeys(s.check for s in specs)), tuple(rules), made.steps)
    return pack.look_up(*made.lookups.values())


class _Compiler:
    """What the rules of one pack share: columns worked out once, and joined tables."""

    def __init__(self, roles, tables, as_of, earliest, latest) -> None:
        self.roles, self.tables, self.as_of, self.range = roles, tables, as_of, (earliest, latest)
        self.steps: dict[str, Prepared] = {}
        self.lookups: dict[tuple[str, str], Lookup] = {}

    def column(self, role: str) -> str:
        return self.roles[role][0]

    def step(self, name: str, needs: tuple[str, ...], column: Callable[[], Column]) -> str:
        self.steps.setdefault(name, Prepared(name, needs, cache(column)))
        return name

    def clean(self, role: str) -> str:
        column = self.column(role)
        return self.step(f"_clean_{column}", (column,), lambda: strip(F.col(f"`{column}`")))

    def upper(self, role: str) -> str:
        clean = self.clean(role)
        return self.step(f"_upper_{self.column(role)}", (clean,), lambda: F.upper(clean))

    def lower(self, role: str) -> str:
        clean = self.clean(role)
        return self.step(f"_lower_{self.column(role)}", (clean,), lambda: F.lower(clean))

    def number(self, role: str) -> tuple[str, str]:
        column, symbols = self.roles[role]
        text = self.step(f"_digits_{column}", (column,), lambda: number_text(F.col(f"`{column}`"), symbols))
        return text, self.step(f"_number_{column}", (text,), lambda: parse_number(F.col(text)))

    def date(self, role: str) -> tuple[str, str]:
        column = self.column(role)
        for step in date_steps(column, self.clean(role), self.as_of, *self.range):
            self.step(step.name, step.needs, step.column)
        return f"_moment_{column}", f"_zone_{column}"

    def facts(self, name: str, role: str, *wanted: str) -> list[str]:
        """Columns of a lookup table, by the code (in upper case) that the role holds."""
        key, columns = self.upper(role), [f"_{name}_{w}_{self.column(role)}" for w in wanted]

        @cache
        def table() -> tuple[DataFrame, bool]:
            known = one_per_key(self.tables[name], "code")
            values = [F.lit(True).alias(c) if w == "there" else F.col(w).alias(c) for w, c in zip(wanted, columns, strict=True)]
            return known.select(F.col("code").alias(key), *values), is_small(known)

        self.lookups.setdefault((name, key), Lookup(key, tuple(columns), lambda rows: table()))
        return columns

    def names(self, name: str, role: str) -> str:
        """The names of a lookup table that the role's text holds, in lower case."""
        key = self.lower(role)
        listed = f"_{name}_{self.column(role)}"

        def table(rows: DataFrame) -> tuple[DataFrame, bool]:
            texts = rows.select(key).where(F.col(key).isNotNull()).distinct()
            # found once per text, however many records hold it
            found = durable(names_in(texts, key, self.tables[name]).withColumnRenamed("listed", listed))
            return found, is_small(found.select(key, F.to_json(listed)))

        self.lookups.setdefault((name, key), Lookup(key, (listed,), table))
        return listed

    def rule(self, spec: Spec, needs: Iterable[str], fires: Callable[[], Column], **fields: Column) -> RowRule:
        column = self.column(spec.role)
        own = {"column": F.lit(column), "value": F.col(f"`{column}`")} | fields
        return RowRule(spec.check, spec.rule, spec.severity, column, (column, *needs), fires, lambda: fill(spec.message, **own))

    def table_rule(self, spec: Spec, needs: tuple[str, ...], issues, of_file: bool = False) -> TableRule:
        return TableRule(spec.check, spec.rule, spec.severity, needs, issues, of_file)


def _there(clean: str) -> Column:
    return F.col(clean) != ""


def _required(m: _Compiler, s: Spec):
    clean = m.clean(s.role)
    return m.rule(s, (clean,), lambda: F.coalesce(F.col(clean) == "", F.lit(True)))


def _format(m: _Compiler, s: Spec):
    clean = m.clean(s.role)
    return m.rule(s, (clean,), lambda: _there(clean) & ~F.col(clean).rlike(s.pattern), value=F.col(clean))


def _check_digit(m: _Compiler, s: Spec):
    clean, upper = m.clean(s.role), m.upper(s.role)
    digit = m.step(f"_digit_{m.column(s.role)}", (clean, upper), lambda: F.when(F.col(clean).rlike(s.pattern), check_digit(F.col(upper))))
    last = F.substring(clean, 9, 1)
    return m.rule(s, (clean, digit), lambda: F.col(digit) != last, value=F.col(clean), expected=F.col(digit), got=last)


def _matches(m: _Compiler, s: Spec):
    upper = m.upper(s.role)
    group = F.regexp_extract(upper, s.pattern, 1) if "(" in s.pattern else F.lit("")
    return m.rule(s, (upper,), lambda: F.col(upper).rlike(s.pattern), value=F.col(upper), group=group)


def _holds(m: _Compiler, s: Spec):
    clean = m.clean(s.role)
    found = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(clean), F.lit(s.pattern), F.lit(0)))), "")
    return m.rule(s, (clean,), lambda: F.col(clean).rlike(s.pattern), value=F.col(clean), found=found)


def _shorter(m: _Compiler, s: Spec):
    clean = m.clean(s.role)
    return m.rule(s, (clean,), lambda: _there(clean) & (F.length(clean) < int(s.bound)), value=F.col(clean))


def _untrimmed(m: _Compiler, s: Spec):
    column, clean = m.column(s.role), m.clean(s.role)
    return m.rule(s, (clean,), lambda: F.col(f"`{column}`") != F.col(clean), shown=quoted(F.col(f"`{column}`")))


def _member(m: _Compiler, s: Spec):
    clean, table = m.clean(s.role), m.tables[s.lookup]
    (there,) = m.facts(s.lookup, s.role, "there")
    known = F.lit(None).cast("string")
    if "{known}" in s.message:
        codes = [r[0] for r in table.select("code").where("code IS NOT NULL").orderBy("code").limit(SHOWN_CODES + 1).collect()]
        known = F.lit(", ".join(codes[:SHOWN_CODES]) + (", ..." if len(codes) > SHOWN_CODES else ""))
    return m.rule(s, (clean, there), lambda: _there(clean) & F.col(there).isNull(), known=known)


def _number(m: _Compiler, s: Spec):
    clean, (text, number) = m.clean(s.role), m.number(s.role)
    return m.rule(s, (clean, text, number), lambda: _there(clean) & is_not_number(F.col(text), F.col(number)))


def _shown(number: Column) -> dict[str, Column]:
    return {"number": float_text(number), "money": money_text(number)}


def _beyond(below: bool):
    def kind(m: _Compiler, s: Spec):
        _, name = m.number(s.role)
        number = F.col(name)
        fires = (number <= s.bound if s.at else number < s.bound) if below else (number >= s.bound if s.at else number > s.bound)
        return m.rule(s, (name,), lambda: fires, **_shown(number))

    return kind


def _beyond_limit(below: bool):
    def kind(m: _Compiler, s: Spec):
        _, name = m.number(s.role)
        low, high = (F.col(c) for c in m.facts(s.lookup, s.other, "low", "high"))
        number, code = F.col(name), m.upper(s.other)
        fires = (number < low) & (number != 0) if below and s.nonzero else number < low if below else number > high
        needs = (name, code, *m.facts(s.lookup, s.other, "low", "high"))
        return m.rule(s, needs, lambda: fires, type=F.col(code), low=low.cast("string"), high=high.cast("string"),
                      bound=F.format_string("%,.0f", low if below else high), **_shown(number))

    return kind


def _date(m: _Compiler, s: Spec):
    clean, (moment, zone) = m.clean(s.role), m.date(s.role)
    undated = is_undated(F.col(clean), F.col(moment))
    return m.rule(s, (clean, moment, zone), lambda: undated | F.col(zone).isNotNull() if s.clock else undated)


def _future(m: _Compiler, s: Spec):
    moment, zone = m.date(s.role)
    now = F.lit(m.as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return m.rule(s, (moment, zone), lambda: F.col(zone).isNull() & (F.col(moment) > now))


def _same_zone(one: str, other: str) -> Column:
    return F.col(one).isNull() == F.col(other).isNull()


def _not_after(m: _Compiler, s: Spec):
    (moment, zone), (earlier, its_zone) = m.date(s.role), m.date(s.other)
    column = m.column(s.other)
    return m.rule(s, (column, moment, zone, earlier, its_zone), lambda: _same_zone(zone, its_zone) & (F.col(moment) <= F.col(earlier)),
                  other=F.col(f"`{column}`"))


def _term(m: _Compiler, s: Spec):
    (moment, zone), (start, its_zone) = m.date(s.role), m.date(s.other)
    days = F.extract(F.lit("DAY"), F.col(moment) - F.col(start))
    term = F.when(_same_zone(zone, its_zone), days / F.lit(DAYS_PER_YEAR))
    needs = [m.column(s.other), moment, zone, start, its_zone]
    fields = {"term": F.format_string("%.1f", F.bround(term, 1))}
    if s.lookup:
        (most,) = m.facts(s.lookup, s.third, "most")
        code = m.upper(s.third)
        return m.rule(s, (*needs, code, most), lambda: term > F.col(most), type=F.col(code), most=F.col(most).cast("int"), **fields)
    if not s.third:
        return m.rule(s, needs, lambda: term > s.bound, **fields)
    # a null code is still checked, a blank one is not
    code = m.upper(s.third)
    return m.rule(s, (*needs, code), lambda: (term > s.bound) & F.coalesce(F.col(code) != "", F.lit(True)), **fields)


def _named(m: _Compiler, s: Spec):
    listed, code = m.names(s.lookup, s.role), m.upper(s.other)
    other = F.get(F.filter(F.col(listed), lambda x: x["code"] != F.col(code)), 0)
    first = m.step(f"_first{listed}_{m.column(s.other)}", (listed, code), lambda: other)
    spec_of_other = replace(s, role=s.other)
    return m.rule(spec_of_other, (m.column(s.role), first, code), lambda: F.col(first).isNotNull(), value=F.col(f"`{m.column(s.role)}`"),
                  name=F.initcap(F.col(first)["name"]), code=F.col(first)["code"], stated=F.col(code))


def _columns(m: _Compiler, s: Spec):
    wanted = [column for column, _ in m.roles.values()]
    return m.table_rule(s, (), lambda rows, row, data: table_rules.missing_columns(rows, data, wanted, s.message), of_file=True)


def _repeated_value(m: _Compiler, s: Spec):
    column = m.column(s.role)
    return m.table_rule(s, (column,), lambda rows, row, data: table_rules.duplicate_values(rows, row, column).select(
        "row", F.lit(column).alias("column"), F.lit(0).alias("emit_ord"), fill(s.message, value=F.col("value")).alias("message")))


def _repeated_row(m: _Compiler, s: Spec):
    return m.table_rule(s, (), lambda rows, row, data: table_rules.duplicate_rows(rows, row, data).select(
        "row", F.lit(None).cast("string").alias("column"), F.lit(0).alias("emit_ord"), fill(s.message, row=F.col("row")).alias("message")))


def _spelling(m: _Compiler, s: Spec):
    column = m.column(s.role)
    return m.table_rule(s, (column,), lambda rows, row, data: table_rules.inconsistent_casing(rows, row, column, s.message))


def _share(m: _Compiler, s: Spec):
    columns = [m.column(r) for r in s.role.split(",")]

    def issues(rows: DataFrame, row: str, data: list[str]) -> DataFrame | None:
        there = [c for c in columns if c in data]
        return table_rules.concentrated_values(rows, there, s.message, over_share=s.bound) if there else None

    return m.table_rule(s, (), issues)


KINDS: dict[str, Callable[[_Compiler, Spec], RowRule | TableRule]] = {
    "required": _required, "format": _format, "check digit": _check_digit, "matches": _matches, "holds": _holds, "shorter": _shorter,
    "untrimmed": _untrimmed, "member": _member, "number": _number, "below": _beyond(True), "above": _beyond(False),
    "below limit": _beyond_limit(True), "above limit": _beyond_limit(False), "date": _date, "future": _future, "not after": _not_after,
    "term above": _term, "term above limit": _term, "named": _named, "columns": _columns, "repeated value": _repeated_value,
    "repeated row": _repeated_row, "spelling": _spelling, "share": _share,
}
