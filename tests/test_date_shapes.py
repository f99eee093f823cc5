"""Shapes of dates, matched by kind."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from assayframe.functions import dates
from assayframe.functions.prepared import add_prepared


def test_a_date_is_matched_against_the_shapes_of_its_kind_only(spark):
    days, months, years = ("3", "03", "13", "31", "3rd"), ("2", "02", "12", "feb", "feb.", "september", "q2", "xyz", ""), ("99", "1999", "5", "")
    texts = [sep.join(order) for parts in product(days, months, years) for order in (parts, parts[::-1], (parts[1], parts[0], parts[2]))
             for sep in ("-", "/", " ", ", ", "")]
    texts += ["2q1999", "2q99", "99q2", "19990203", "990203", "=1999-2-3", "=1999-feb-3", "not-a-date", "", None, "é1999", "1999 é"]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "text string")
    in_turn = F.col("text")
    for shape, order in dates._SHAPES:
        in_turn = F.regexp_replace(in_turn, shape, order)
    got = rows.select("text", dates._in_order(F.col("text")).alias("got"), in_turn.alias("want")).collect()
    assert [r for r in got if r["got"] != r["want"]] == [] and sum(str(r["got"]).startswith("=") for r in got) > 100
    plan = rows.select(dates._in_order(F.col("text")))._jdf.queryExecution().analyzed().toString()
    letters, plain = plan.split("ELSE")[:2]
    assert "sep(?:" in letters and "sep(?:" not in plain.split(" END")[0]


def test_clocks_are_looked_for_in_texts_with_a_colon_and_read_as_before(spark):
    texts = ["2024-01-02 03:04", "01/02/2024 3:04 pm utc", "20240102t0304", "2024-01-02t05", "jan 5 2024 5pm", "01/02/2024", "a:b", ":", "2024-01-02 03:04:05.1234567+0100"]
    rows = spark.createDataFrame([(t,) for t in texts], "_clean_d string")
    steps = {p.name: p for p in dates.date_steps("d", "_clean_d", dates.datetime(2024, 1, 1))}
    out = add_prepared(rows, ["_moment_d", "_zone_d"], steps)
    for group, name in ((1, "_clock_d"), (2, "_half_d")):
        assert out.where(~F.col(name).eqNullSafe(F.regexp_extract("_text_d", dates._CLOCK, group))).count() == 0
    assert out.where(F.col("_moment_d").isNotNull()).count() == 7
