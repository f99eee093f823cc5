"""Tables from files, as text with row numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import NULL_TOKENS, blank_tokens_to_null
from ..operators.positions import number_file_rows, number_parquet_rows, shared_folder


def scan_csv(
    spark: SparkSession, path: str | list[str], quoted_newlines: bool = False,
    null_tokens: tuple[str, ...] = NULL_TOKENS,
) -> DataFrame:
    """A CSV file or folder with a header line, all columns text, the usual null tokens as null.

    ``quoted_newlines`` allows line breaks inside quotes; Spark then cannot split a file.
    """
    table, names = _records(spark, path, quoted_newlines)
    return _whole(table, names).select(*[blank_tokens_to_null(F.col(f"`{c}`"), null_tokens).alias(c) for c in names])


def read_csv(
    spark: SparkSession, path: str | list[str], quoted_newlines: bool = False,
    null_tokens: tuple[str, ...] = NULL_TOKENS, row: str = "row",
) -> DataFrame:
    """As ``scan_csv``, with the row number first, in a column that the files must not have."""
    table, names = _records(spark, path, quoted_newlines)
    _free(names, row)
    numbered = _whole(number_file_rows(table, row), names)
    return numbered.select(row, *[blank_tokens_to_null(F.col(f"`{c}`"), null_tokens).alias(c) for c in names])


def read_parquet(spark: SparkSession, path: str | list[str], row: str = "row") -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    table = spark.read.parquet(*paths)
    _free(table.columns, row)
    return number_parquet_rows(table, row)


def staged(table: DataFrame, path: str | None = None) -> DataFrame:
    """The table written once as Parquet and read back.

    ``path`` must not exist yet; without one, a folder in the shared folder is made. Nothing
    deletes it: it may be read as long as the session lasts.

    A validation reads its input once for all row rules and again for every table rule. For a
    Parquet table those are scans of a few columns. A CSV file would be parsed in full each time:
    stage it first.
    """
    path = path or f"{shared_folder(table.sparkSession)}/staged-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


# A column for the text of records whose number of fields is not that of the header.
_ODD = "_odd_record"
_QUOTES = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _records(spark: SparkSession, path: str | list[str], quoted_newlines: bool) -> tuple[DataFrame, list[str]]:
    """The scan, with the column ``_ODD``, and the names of its other columns.

    All files must have the header of the first: Spark would bind other columns by position, so
    it is told to compare every header and to stop at one that differs.
    """
    # whole records are parsed: else the number of fields would go unseen where few columns are read
    lines = {"multiLine": str(quoted_newlines).lower(), "columnPruning": "false"}
    raw = spark.read.options(**_QUOTES, **lines).csv(path).limit(1).collect()
    names = [str(f) for f in raw[0]] if raw else []
    folded = [f.lower().strip() for f in names]
    twice = sorted({f for f in folded if folded.count(f) > 1})
    if twice:
        raise ValueError(f"the header names a column more than once: {', '.join(twice)}")
    schema = StructType([StructField(n, StringType()) for n in (*names, _ODD)])
    reader = spark.read.schema(schema).options(**_QUOTES, **lines, header="true", enforceSchema="false", mode="PERMISSIVE",
                                               columnNameOfCorruptRecord=_ODD, nullValue="", emptyValue="")
    return reader.csv(path), names


def _whole(records: DataFrame, names: list[str]) -> DataFrame:
    """Stops at a record with more fields than the header; one with fewer is filled up with nulls.

    Only records whose number of fields differs are looked at again: their commas outside quotes
    are counted.
    """
    bare = F.regexp_replace(F.col(_ODD), r'"(?:[^"]|"")*"', "")
    message = F.concat(F.lit("a record has more fields than the header: "), F.col(_ODD))
    fits = F.when(F.regexp_count(bare, F.lit(",")) < len(names), True).otherwise(F.raise_error(message).cast("boolean"))
    return records.where(F.when(F.col(_ODD).isNull(), True).otherwise(fits)).drop(_ODD)


def _free(names: list[str], row: str) -> None:
    if row.lower().strip() in {n.lower().strip() for n in names}:
        raise ValueError(f"the table has a column {row!r} of its own: pass another name for the position as row=")
