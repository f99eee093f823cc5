"""Operators over a whole table: missing columns, duplicates, spellings, concentrated values.

Each groups with a partial aggregate first, so a value that fills much of the table reaches the
shuffle as one record per task, and joins its result back where single rows are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_text
from ..functions.text import fill, quoted, strip
from .groups import rows_with_group

# Spellings of one name that one list holds, on average.
SPELLINGS_PER_LIST = 10_000


def missing_columns(rows: DataFrame, data: Sequence[str], required: Sequence[str], message: str) -> DataFrame | None:
    """Required columns the table does not have: known from the schema, so no job is needed."""
    there = {c.lower().strip() for c in data}
    absent = [(place, name) for place, name in enumerate(required) if name not in there]
    if not absent:
        return None
    lines = F.array(*[F.struct(F.lit(p).alias("emit_ord"), F.lit(n).alias("column")) for p, n in absent])
    return rows.sparkSession.range(1, numPartitions=1).select(F.inline(lines)).select(
        F.lit(None).cast("long").alias("row"), "column", "emit_ord",
        fill(message, column=F.col("column")).alias("message"),
    )


def duplicate_values(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Rows whose value was seen before: all but the first of each group of equal values.

    A row takes part if its raw value occurs more than once; such rows are then compared without
    surrounding white space. Returns ``row`` and the stripped ``value``.
    """
    raw = rows.select(F.col(row).alias("row"), F.col(column).alias("raw")).where(F.col("raw").isNotNull())
    repeated = (
        raw.groupBy("raw").agg(F.count("*").alias("n"), F.min("row").alias("first"))
        .where(F.col("n") > 1).withColumn("value", strip(F.col("raw"))).where(F.col("value") != "")
    )
    first = repeated.groupBy("value").agg(F.min("first").alias("first"))
    groups = repeated.drop("first").join(first, "value")
    return rows_with_group(raw, groups, "raw", "n").where(F.col("row") > F.col("first")).select("row", "value")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row. Lengths are part of the text, so neither nulls nor borders are ambiguous."""
    fields = [
        F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`")).cast("string"), F.lit(":"), F.col(f"`{c}`")), F.lit("-"))
        for c in columns
    ]
    # never null: a join on it then adds no null test, which would work it out a second time
    return F.coalesce(F.unhex(F.sha2(F.concat(*fields), 256)), F.lit(b""))


def duplicate_rows(rows: DataFrame, row: str, columns: Sequence[str]) -> DataFrame:
    """Rows equal to an earlier one in all ``columns``, nulls being equal. Returns ``row``.

    The columns are compared by digest, so 32 bytes per row are shuffled however wide the table.
    """
    digests = rows.select(F.col(row).alias("row"), row_digest(columns).alias("digest"))
    groups = digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    repeated = groups.where(F.col("n") > 1)
    return rows_with_group(digests, repeated, "digest", "n").where(F.col("row") > F.col("first")).select("row")


def spellings(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Every spelling of names that differ only in case: ``name``, ``spelling``, ``first`` row, ``n`` of the name."""
    variants = _variants(rows, row, column)
    return rows_with_group(variants, _varied(variants).select("name", "n"), "name", "n")


def _variants(rows: DataFrame, row: str, column: str) -> DataFrame:
    named = rows.where(F.col(column).isNotNull())
    return (
        named.select(F.col(row).alias("row"), strip(F.col(column)).alias("spelling"))
        .groupBy("spelling").agg(F.min("row").alias("first"))
        .withColumn("name", F.lower("spelling"))
    )


def _varied(variants: DataFrame) -> DataFrame:
    return variants.groupBy("name").agg(F.count("*").alias("n"), F.min("first").alias("seen")).where(F.col("n") > 1)


def inconsistent_casing(
    rows: DataFrame, row: str, column: str, message: str, per_list: int = SPELLINGS_PER_LIST,
) -> DataFrame:
    """One line per name with several spellings, which the message lists in order of appearance.

    Names with one spelling are dropped before anything is gathered. The spellings of a name are listed by stretches of the
    table, many at most ``per_list`` long on average, each in a task of its own; these lists follow each other, so what the
    last step puts together are a few texts in order, however many spellings a name has.
    """
    variants = _variants(rows, row, column)
    varied = variants.groupBy("name").agg(
        F.count("*").alias("n"), F.min("first").alias("seen"), F.max("first").alias("last")).where(F.col("n") > 1)
    lists = F.ceil(F.col("n") / per_list)
    place = F.floor((F.col("first") - F.col("seen")) * lists / (F.col("last") - F.col("seen") + 1))
    listed = rows_with_group(variants, varied, "name", "n", rows_per_part=per_list).groupBy("name", "seen", place.alias("place")).agg(
        F.array_sort(F.collect_list(F.struct("first", "spelling"))).alias("some"))
    texts = listed.select("name", "seen", "place", F.array_join(F.transform("some", lambda v: quoted(v["spelling"])), ", ").alias("text"))
    whole = texts.groupBy("name", "seen").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    return whole.select(
        F.lit(None).cast("long").alias("row"), F.lit(column).alias("column"), F.col("seen").alias("emit_ord"),
        fill(message, variants=F.array_join(F.col("all.text"), ", ")).alias("message"))


def top_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent stripped value of each column: ``column``, ``value``, ``n``, ``non_null``, ``total``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), strip(F.col(c)).alias("value")) for c in columns])
    counts = rows.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return counts.groupBy("column").agg(
        F.max_by("value", known).alias("value"), F.max(known).alias("n"),
        F.sum(known).alias("non_null"), F.sum("n").alias("total"),
    )


def concentrated_values(
    rows: DataFrame, columns: Sequence[str], message: str, min_rows: int = 5,
    over_share: float = 0.6, over_count: int = 3,
) -> DataFrame:
    """Columns in which one value fills more than the given share of the non-null fields."""
    top = top_values(rows, columns).withColumn("ratio", F.col("n") / F.col("non_null"))
    # above one half there is only one such value, so ties cannot arise
    kept = top.where(
        (F.col("total") >= min_rows) & (F.col("ratio") > over_share) & (F.col("n") > over_count))
    place = F.array_position(F.lit(list(columns)), F.col("column"))
    return kept.select(
        F.lit(None).cast("long").alias("row"), "column", place.alias("emit_ord"),
        fill(message, column=F.col("column"), n=F.col("n"), non_null=F.col("non_null"),
             percent=percent_text(F.col("ratio")), value=F.col("value")).alias("message"),
    )
