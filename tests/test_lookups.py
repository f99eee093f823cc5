"""Joined code lists, limits and names, and packs compiled from tables of parameters."""

import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import lookups
from assayframe.operators.lookups import is_small, names_in, one_per_key, with_facts
from assayframe.plans.bond_specs import bond_specs, lookup_tables, role_table, spec_table
from assayframe.plans.bonds import CHECKS, REQUIRED_COLUMNS, STATE_NAMES, bond_pack
from assayframe.plans.compiler import Spec, compile_pack, roles_of, specs_of
from assayframe.plans.engine import validate

from .test_rules import AS_OF, CASES, VALID, table

ISSUE = ("row", "column", "severity", "rule", "message", "sev_rank", "check_ord", "emit_ord", "first_error")


def lines(issues):
    return sorted((tuple(r[c] for c in ISSUE) for r in issues.collect()), key=str)


def test_the_bond_pack_from_tables(spark):
    """Issues, messages and orders of the compiled pack are those of the written one, with nulls and odd values."""
    rows = table(spark, [c for c, _ in CASES] + [{c: None for c in VALID}, {c: " \t" for c in VALID}] + [{}, {"issuer_name": "TOWN of boulder colorado"}])
    compiled = compile_pack(specs_of(spec_table(spark)), roles_of(role_table(spark)), lookup_tables(spark), AS_OF)
    assert set(compiled.checks) == set(CHECKS)
    position = {c: n for n, c in enumerate(compiled.checks)}
    want = [(*x[:6], position[CHECKS[x[6]]], *x[7:]) for x in lines(validate(rows, bond_pack(AS_OF)))]
    assert lines(validate(rows, compiled)) == sorted(want, key=str)


def test_renamed_columns(spark):
    names = {c: f"Field {n}" for n, c in enumerate(REQUIRED_COLUMNS)}
    rows = table(spark, [c for c, _ in CASES]).withColumnsRenamed(names)
    pack = compile_pack(bond_specs(), roles_of(role_table(spark, {c: n.lower() for c, n in names.items()})), lookup_tables(spark), AS_OF)
    back = {n.lower(): c for c, n in names.items()}
    got = sorted(((r["row"], back.get(r["column"], r["column"]), r["rule"]) for r in validate(rows, pack).collect()), key=str)
    want = sorted(((r["row"], r["column"], r["rule"]) for r in validate(table(spark, [c for c, _ in CASES]), bond_pack(AS_OF)).collect()), key=str)
    assert got == want
    gone = validate(rows.drop(names["state"]), pack)
    assert {r["column"] for r in gone.where("rule = 'MISSING_COLUMN'").collect()} == {names["state"].lower()}


@pytest.mark.parametrize("wrong", [dict(kind="no such"), dict(role="nobody"), dict(lookup="nothing")])
def test_wrong_parameters_are_refused(wrong):
    spec = Spec(**({"check": "c", "rule": "R", "severity": "error", "kind": "required", "role": "a", "message": ""} | wrong))
    with pytest.raises(ValueError, match="R: "):
        compile_pack([spec], {"a": ("a", "")}, {})
    with pytest.raises(ValueError, match="dots"):
        compile_pack([], {"a": ("a.b", "")}, {})


def test_a_million_codes_and_a_hot_one(spark, monkeypatch):
    """Beyond the limits of a broadcast the join is by key, a hot key dealt out; results stay."""
    codes = spark.range(1_000_000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"))
    hot = F.when(F.col("id") < 30_000, F.lit("c5")).when(F.col("id") < 35_000, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("id") * 50).cast("string")))
    rows = spark.range(50_000).select(F.col("id").alias("row"), hot.alias("kind"))
    pack = compile_pack([Spec("codes", "UNKNOWN", "error", "member", "kind", "'{value}' is unknown", lookup="codes")], {"kind": ("kind", "")}, {"codes": codes})
    assert not is_small(codes)
    found = validate(rows, pack)
    assert "_part" in found._jdf.queryExecution().executedPlan().toString()  # dealt out
    assert sorted(r["row"] for r in found.collect()) == [n for n in range(35_000, 50_000) if n * 50 >= 1_000_000]
    assert found.where("message <> concat(\"'c\", cast(row * 50 as string), \"' is unknown\")").isEmpty()


def test_facts_by_key_equal_broadcast_ones(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(n, rng.choice(["a", "a", "a", "b", None, "z"])) for n in range(500)], "n int, k string")
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    near, far = (sorted(map(tuple, with_facts(rows, facts, "k", small, 20).select("n", "k", "v").collect())) for small in (True, False))
    assert near == far and len(near) == 500
    with pytest.raises(ValueError, match="more than once"):
        one_per_key(facts.unionByName(facts), "k")


def test_names_by_index(spark):
    """Against testing every name on every text, for names that overlap, repeat parts and are shorter than a run."""
    rng = random.Random(11)
    names = [(n, c, i) for i, (n, c) in enumerate(STATE_NAMES.items())] + [("a b", "S1", 50), ("xy", "S2", 51), ("é", "S3", 52), ("", "S4", 53), (None, "S5", 54),
                                                                           ("kansas", "S6", 55)]
    parts = [n for n, _, _ in names if n] + ["city of", "west", "county", "x", "arkansasaw"]
    texts = list({" ".join(rng.choices(parts, k=rng.randrange(1, 5)))[rng.randrange(3):] for _ in range(300)} | {"", "xy"})
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    table = spark.createDataFrame(names, "name string, code string, ord long")
    got = {r["t"]: [tuple(x) for x in r["listed"]] for r in names_in(frame, "t", table).collect()}
    want = {t: [(o, n, c) for n, c, o in names if n and n in t] for t in texts}
    assert got == {t: x for t, x in want.items() if x}
    assert names_in(frame, "t", table.where("false")).count() == 0


def test_many_names(spark):
    """50,000 names: each text meets only those that share a run with it."""
    table = spark.range(50_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.lit(" town")).alias("name"), F.lit("ZZ").alias("code"), F.col("id").alias("ord"))
    texts = spark.range(2_000).select(F.concat(F.lit("the name "), (F.col("id") * 25).cast("string"), F.lit(" town hall")).alias("t"))
    found = names_in(texts, "t", table).collect()
    assert len(found) == 2_000 and all(f"name {x['ord']} town" in r["t"] for r in found for x in r["listed"])
    assert lookups.GRAM == 4
