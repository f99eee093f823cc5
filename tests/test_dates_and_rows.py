"""Date parsing against pandas, row numbers against a plain reading of the files."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.functions.dates import date_steps, is_undated
from assayframe.functions.prepared import Prepared, add_prepared
from assayframe.functions.text import strip
from assayframe.operators.groups import rows_with_group
from assayframe.operators.positions import number_sorted_rows
from assayframe.sources.files import read_csv, read_parquet

DATES = """2023-01-15|2023/01/15|2023.01.15|20230115|2023|2023-01|2023Q1|1Q2023|2023-1-5|2023-13|2023-15-01|01/15/2023
1/5/2023|01-15-2023|15/01/2023|15.01.2023|5.1.2023|1/2/23|13/2/23|31/12/99|12/31/99|1/2/75|1/2/76|00/01/2023|Jan 15, 2023
January 15 2023|15 Jan 2023|15-Jan-23|15Jan2023|2023-Jan-15|Jan 2023|Sept 5 2023|5th January 2023|Sun Jan 15 2023|Monday
NaT|nan|None|0|12|44927|5000000|20231301|2023-02-30|2024-02-29|30/02/2023|2300-01-01|2262-04-11|2262-04-12|1677-09-21
2023-01-15T10:30|2023-01-15 10:30:00.123456|2023-01-15T10:30:00Z|2023-01-15T10:30:00+05:30|2023-01-15 10:30 PM
01/15/2023 10:30:15|2023-01-15 25:00|  2023-01-15  |abc|12/2023|99/99/9999|99-01-15|150123|011523|123456|2023-01-15 13:02 PM
Mayor|Juli 4 2023|15 January 2023 3:05 PM|20230115T103000|2023-01-15x|1/2|13/2023|TBD""".replace("\n", "|").split("|")


def test_dates_like_pandas(spark):
    steps = (Prepared("_clean_v", ("v",), lambda: strip(F.col("v"))), *date_steps("v", "_clean_v", datetime.now()))
    table = spark.createDataFrame([(v,) for v in DATES], "v string").coalesce(1)
    parsed = add_prepared(table, ["_moment_v", "_zone_v"], {p.name: p for p in steps})
    wrong = []
    for line in parsed.select(
        "v", F.col("_moment_v").cast("string").alias("m"), F.col("_zone_v").isNotNull().alias("zoned"),
        is_undated(F.col("_clean_v"), F.col("_moment_v")).alias("bad"),
    ).collect():
        try:
            want = pd.to_datetime(line["v"])
        except ValueError:
            good = line["bad"]
        else:
            if want is pd.NaT:
                good = line["m"] is None and not line["bad"]
            else:
                zoned = want.tzinfo is not None
                want = want.tz_convert("UTC").tz_localize(None) if zoned else want
                good = line["m"] is not None and pd.Timestamp(line["m"]) == want and line["zoned"] == zoned
        if not good:
            wrong.append(tuple(line))
    assert not wrong


def test_csv_row_numbers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    expected, row = {}, 2
    for name in ("a", "b", "c"):
        lines = ["cusip,note"]
        for i in range(400):
            lines.append(f"{name}{i},N/A" if i % 3 else f'{name}{i},"say ""x"""')
            expected[f"{name}{i}"] = row
            row += 1
            if i % 7 == 0:
                lines.append("")
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        table = read_csv(spark, str(folder))
        got = {r["cusip"]: (r["row"], r["note"]) for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: v[0] for k, v in got.items()} == expected
    assert got["a1"][1] is None and got["a0"][1] == 'say "x"'


def test_header_collision(spark, tmp_path):
    (tmp_path / "x.csv").write_text("CUSIP,cusip\n1,2\n")
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "x.csv"))


def csv_folder(path, **files):
    path.mkdir()
    for name, text in files.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


def test_csv_is_bound_by_name_or_refused(spark, tmp_path):
    other = csv_folder(tmp_path / "order", a="cusip,state\nA,TX\n", b="state,cusip\nNY,B\n")
    with pytest.raises(Exception, match="header|FAILED_READ_FILE"):
        read_csv(spark, other).collect()
    longer = csv_folder(tmp_path / "long", a="cusip,state\nA,TX\nB,NY,extra,more\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, longer).select("cusip").collect()
    shorter = csv_folder(tmp_path / "short", a='cusip,state\n"A, B"\n"C ""x""", \n')
    assert [tuple(r) for r in read_csv(spark, shorter).orderBy("row").collect()] == [(2, "A, B", None), (3, 'C "x"', " ")]
    taken = csv_folder(tmp_path / "row", a="Row,cusip\n9,A\n")
    with pytest.raises(ValueError, match="row="):
        read_csv(spark, taken)
    assert [tuple(r) for r in read_csv(spark, taken, row="line").collect()] == [(2, "9", "A")]
    spark.range(3).withColumnRenamed("id", "row").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="row="):
        read_parquet(spark, str(tmp_path / "p"))


def test_shared_folder_is_required_off_this_machine(monkeypatch):
    from types import SimpleNamespace

    from assayframe.operators.positions import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_parquet_and_sorted_row_numbers(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    numbered = read_parquet(spark, str(tmp_path / "t"))
    assert numbered.where("row <> id + 2").count() == 0 and numbered.count() == 1000
    mixed = spark.range(1000).repartition(7)
    assert number_sorted_rows(mixed, ["id"]).where("row <> id + 2").count() == 0


@pytest.mark.parametrize("largest", [1, 2, 100])
def test_hot_groups_lose_no_rows(spark, largest):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("k < 10")
    got = rows_with_group(rows, groups, "k", "n", largest, 10)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.where("k < 10").collect())
