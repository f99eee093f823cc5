"""Counts made by the job that reads or writes the issues, records counted by bitmaps, and names with very many spellings."""

from pyspark.sql import functions as F

from assayframe.operators.issues import first_issues, sorted_issues
from assayframe.operators.summary import pass_rate, profile, rule_counts, severity_counts
from assayframe.operators.table_rules import inconsistent_casing
from assayframe.plans.bonds import MESSAGES, bond_pack
from assayframe.plans.engine import validate
from assayframe.plans.pack import ERROR, TableRule
from assayframe.sources.reports import write_and_profile

from .test_rules import AS_OF, CASES, table


def rows_of(spark, times=1):
    return table(spark, [c for c, _ in CASES] * times)


def test_first_issues_count_what_is_left_out(spark):
    issues = validate(rows_of(spark), bond_pack(AS_OF))
    every = sorted_issues(issues).collect()
    got = first_issues(issues, 7)
    assert [r["message"] for r in got.collect()] == [r["message"] for r in every[:7]]
    assert {r["left_out"] for r in got.collect()} == {len(every) - 7}
    assert "FileScan" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Generate" not in plan  # nothing is validated again
    assert {r["left_out"] for r in first_issues(issues, 9_999).collect()} == {0} and first_issues(issues, 9_999).count() == len(every)
    assert first_issues(issues, 20_000).count() == len(every) and first_issues(issues.where("false"), 5).count() == 0


def test_profile_of_the_job_that_writes(spark, tmp_path):
    rows, pack = rows_of(spark), bond_pack(AS_OF)
    issues = validate(rows, pack)
    for n, ordered in enumerate((True, False)):
        counted = write_and_profile(issues, pack, rows.columns, f"{tmp_path}/{n}", ordered=ordered)
        want = profile(issues)
        names = ["rule", "column", "severity", "sev_rank", "n"]
        assert sorted(map(str, counted.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
        assert rule_counts(counted).collect() == rule_counts(want).collect()
        assert pass_rate(counted, rows).collect() == pass_rate(want, rows).collect()
        assert spark.read.json(f"{tmp_path}/{n}").count() == issues.count()
    assert write_and_profile(issues.where("false"), pack, rows.columns, f"{tmp_path}/none").count() == 0


def test_records_named_by_rules_of_the_whole_table(spark):
    """Records that row rules and two table rules name as errors count once; numbers are far apart and above 2 ** 40."""
    rows = rows_of(spark, 3).withColumn("row", F.col("row") * 50_021 + (1 << 40))

    def every(step):
        return lambda frame, row, data: frame.where(F.pmod(F.col(row), F.lit(step)) == 0).select(
            F.col(row).alias("row"), F.lit(None).alias("column"), F.lit(0).alias("emit_ord"), F.lit("m").alias("message"))

    pack = bond_pack(AS_OF).add(TableRule("own", "THIRD", ERROR, (), every(3))).add(TableRule("own", "FIFTH", ERROR, (), every(5)))
    issues = validate(rows, pack)
    assert "Window" not in issues._jdf.queryExecution().optimizedPlan().toString()
    counted = profile(issues)
    want = issues.where("severity = 'error' and row is not null").select("row").distinct().count()
    assert pass_rate(counted, rows).first()["error_rows"] == want > 0
    assert severity_counts(counted).first()["errors"] == issues.where("severity = 'error'").count()
    assert {r["rule"] for r in rule_counts(counted).collect()} == {r["rule"] for r in issues.select("rule").distinct().collect()}


def test_spellings_in_lists(spark):
    """Lists of three put together give the order of appearance, as one list does."""
    names = [f"{'tOwn'[:n % 5]}{'TOWN'[n % 5:]} {x}" for n in range(40) for x in ("a", "A", "b", "O'Hara")] + ["alone"] * 3 + [None, " town B "]
    rows = spark.createDataFrame([(1000 - 3 * n, x) for n, x in enumerate(names)], "row long, name string").repartition(3)
    got, want = (sorted(map(tuple, inconsistent_casing(rows, "row", "name", MESSAGES["INCONSISTENT_CASING"], n).collect()), key=str) for n in (3, 10_000))
    assert got == want and len(got) == 3
    first = {}
    for row, name in sorted((1000 - 3 * n, x) for n, x in enumerate(names) if x):
        first.setdefault(name.strip().lower(), {}).setdefault(name.strip(), row)
    for name, of in first.items():
        if len(of) > 1:
            shown = ", ".join(f'"{x}"' if "'" in x else f"'{x}'" for x in of)
            assert MESSAGES["INCONSISTENT_CASING"].replace("{variants}", shown) in [r[3] for r in got]


def test_very_many_spellings_of_one_name(spark):
    bits = F.concat(*[F.when(F.shiftright("id", i) % 2 == 1, F.lit("X")).otherwise(F.lit("x")) for i in range(20)])
    rows = spark.range(200_000).select(F.col("id").alias("row"), bits.alias("name"))
    found = inconsistent_casing(rows, "row", "name", MESSAGES["INCONSISTENT_CASING"]).select(F.length("message").alias("n"), "emit_ord").collect()
    assert len(found) == 1 and found[0]["emit_ord"] == 0
    assert found[0]["n"] == len(MESSAGES["INCONSISTENT_CASING"]) - len("{variants}") + 200_000 * 24 - 2
