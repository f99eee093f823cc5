"""The bond table that all registered queries check, derived from orders and customers.

The driver's tables hold no nulls and no bond fields. Every order becomes one security, and
defects are planted by arithmetic on the order key. Rows whose key is a multiple of 151 come
twice. ``oracle.py`` states the same derivation in SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions.identifiers import check_digit
from assayframe.plans.bonds import STATE_NAMES
from assayframe.sources.files import staged

AS_OF = datetime(2024, 1, 1)
STATES = [(" ".join(w.capitalize() for w in name.split()), code) for name, code in STATE_NAMES.items()][:25]
TYPES = ("GO", "REV", "CD", "BAB", "IDR", "TAN", "BAN", "RAN", "TRAN", "COPS", "HFA", "OTHER")
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def _first(*cases: tuple[int, Column | str | None], otherwise: Column | str) -> Column:
    """The value of the first listed divisor of the key."""
    k = F.col("k")
    value = None
    for divisor, result in cases:
        result = F.lit(result) if isinstance(result, str) or result is None else result
        value = F.when(k % divisor == 0, result) if value is None else value.when(k % divisor == 0, result)
    return value.otherwise(otherwise)


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.lit(list(values)), index.cast("int"))


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _coded(number: Column, width: int) -> Column:
    """The number to base 36: different up to 36 ** width."""
    return F.lpad(F.conv(number.cast("string"), 10, 36), width, "0")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table as a stored one: written once per session and source, then read back.

    Bond tables are stored columns. Left as expressions, the derivation would be copied by the
    optimizer into every filter above it, which no real input does.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        _STAGED[key] = staged(derive(spark, sf_dir))
    return _STAGED[key]


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id`` (the position) and the eight text columns of the pack."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("s"))
    base = orders.join(customers, "c")

    k, s, c = F.col("k"), F.col("s"), F.col("c")
    code, year = _pick([code for _, code in STATES], s), F.year("day")
    city, state = (c % 40).cast("string"), _pick([name for name, _ in STATES], s)
    name = F.concat(F.lit("City "), city, F.lit(" of "), state)
    body = _first(
        (43, F.concat(F.lit("ABCDEF"), _padded(k % 100, 2))), (47, F.concat(_coded(F.floor(k / 47), 6), F.lit("00"))),
        otherwise=F.concat(_coded(k, 7), F.substring(F.lit(LETTERS), (k % 24 + 1).cast("int"), F.lit(1))))
    month = F.date_format("day", "-MM-01")

    table = base.withColumn("body", body).withColumn("digit", check_digit(F.col("body"))).select(
        F.explode(F.when(k % 151 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        k,
        _first((19, None), (17, F.substring("body", 1, 7)),
               (13, F.concat("body", ((F.col("digit").cast("int") + 1) % 10).cast("string"))),
               otherwise=F.concat("body", "digit")).alias("cusip"),
        _first((61, None), (59, "AB"), (53, "12345"), (31, F.lower(name)), (37, F.concat(name, F.lit("  "))),
               (41, F.concat(F.lit("City <"), city, F.lit("> of "), state)), otherwise=name).alias("issuer_name"),
        _first((67, "XX"), (29, _pick([code for _, code in STATES], (s + 1) % 25)), (71, F.lower(code)),
               otherwise=code).alias("state"),
        _first((73, "not-a-date"), (79, "2099-01-01"), (83, F.date_format("day", "MM/dd/yyyy")),
               otherwise=F.date_format("day", "yyyy-MM-dd")).alias("issue_date"),
        _first((89, "1990-01-01"), (97, F.concat((year + 60).cast("string"), month)),
               otherwise=F.concat((year + 1 + k % 20).cast("string"), month)).alias("maturity_date"),
        _first((101, "-500"), (103, "abc"), (107, "$1,250,000"), (109, "5000000000"), (113, "  "), (7, "250000"),
               otherwise=F.round("price").cast("long").cast("string")).alias("par_value"),
        F.when(k % 127 == 0, "22.5").when(k % 131 == 0, "-1.5").when(k % 137 == 0, "N/A").when(k % 3 > 0, "4.25")
        .otherwise((k % 36).cast("string")).alias("coupon_rate"),
        _first((139, "XYZ"), (149, " go "), (157, "  "), (194, None), otherwise=_pick(list(TYPES), k % 12)).alias("bond_type"),
    )
    return table.withColumn("row_id", 2 * k + 2 + F.col("again")).select(
        "row_id", "cusip", "issuer_name", "state", "issue_date", "maturity_date", "par_value", "coupon_rate", "bond_type")
