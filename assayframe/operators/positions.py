"""Row numbers: the line a record has in a spreadsheet with one header line (first record = 2)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_ROW = 2

# A table of one row per file split is sent to all tasks up to this many rows (some tens of MB);
# above it the offsets are joined by shuffle.
BROADCAST_SPLITS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, on storage that all executors reach.

    It is the one in ``spark.checkpoint.dir``. Only a session whose master is ``local`` (a test) gets
    a temporary one where that is unset: elsewhere executors would not find it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder on storage that all executors share")
            folder = tempfile.mkdtemp(prefix="assayframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back.

    What was numbered once must not come out differently when a lost executor makes Spark run a
    stage again.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def _small(table: DataFrame) -> DataFrame:
    """Marked for broadcast where its row count allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SPLITS else table


def number_file_rows(scan: DataFrame, row: str = "row") -> DataFrame:
    """Number the records of a file scan in file order, files in order of their paths.

    Spark packs file splits by size, so partition order is not file order. One pass counts the
    records of every split; its result, one row per split, gives each split its first number, and
    a record adds its position within the split. ``scan`` must be the scan itself: a filter or
    repartition before this would change the positions.
    """
    tagged = scan.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        *[F.col(f"`{c}`") for c in scan.columns],
    )
    splits = tagged.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    splits = durable(_first_numbers(splits))
    place = F.col("_id") - F.col("_low")
    numbered = tagged.join(_small(splits), ["_file", "_start"], "left").withColumn(
        row, _checked(place.between(0, F.col("_n") - 1), F.col("_first") + place))
    return numbered.select(row, *[F.col(f"`{c}`") for c in scan.columns])


def number_parquet_rows(scan: DataFrame, row: str = "row", place: Column | None = None) -> DataFrame:
    """The same for Parquet, whose reader already knows a record's position in its file.

    ``place`` orders the files by something else than their path (``_file``).
    """
    tagged = scan.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"),
        *[F.col(f"`{c}`") for c in scan.columns],
    )
    files = tagged.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_start", F.lit(0))
    files = durable(_first_numbers(files, place)).drop("_start")
    numbered = tagged.join(_small(files), "_file", "left").withColumn(
        row, _checked(F.col("_place") < F.col("_n"), F.col("_first") + F.col("_place")))
    return numbered.select(row, *[F.col(f"`{c}`") for c in scan.columns])


def number_sorted_rows(table: DataFrame, order_by: list[str | Column], row: str = "row") -> DataFrame:
    """Number the rows of a table that has no order of its own by the given key.

    The sorted table is written to the shared folder as Parquet, so its order stays as it is and
    later reads take only the columns they need; its part files are then numbered like any others.
    No window runs over the whole table. Whoever owns the shared folder deletes the copy.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    table.orderBy(*order_by).write.parquet(path)
    part = F.regexp_extract("_file", r"part-(\d+)-[^/]*$", 1).cast("long")
    return number_parquet_rows(spark.read.schema(table.schema).parquet(path), row, part)


def _first_numbers(splits: DataFrame, place: Column | None = None) -> DataFrame:
    """Add the number of each split's first record. One row per split goes in, not data."""
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    within = splits.withColumn("_within", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # one row per file: far smaller than the file listing that Spark's driver holds anyway
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_total"))
    order = [place, F.col("_file")] if place is not None else [F.col("_file")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_files"))
    first = F.col("_files") + F.col("_within") + FIRST_ROW
    return within.join(files, "_file").withColumn("_first", first).drop("_within", "_files")


def _checked(holds: Column, number: Column) -> Column:
    message = "the files changed, or were split differently, after their records were counted"
    return F.when(holds, number).otherwise(F.raise_error(F.lit(message)).cast("long"))


