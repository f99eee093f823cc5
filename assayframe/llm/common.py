"""Helpers that several operators share: stored tables, joins that survive hot keys, batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import shared_folder

# What separates words, as a regular expression and as characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

# Tables of up to this many rows (some tens of MB) may be sent to all tasks, after counting them.
BROADCAST_ROWS = 500_000
# So many of the largest keys are dealt out over several tasks in a join, and over so many.
HOT_KEYS, SPREAD = 1000, 32


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared checkpoint folder. Whoever owns that folder cleans it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str = "table") -> DataFrame:
    """The frame written to the shared folder as Parquet and read back: lineage ends here."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def text_key(text: str = "text") -> Column:
    """A hash of the text. With doc_id it tells rows apart; rows equal in both get equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def small(table: DataFrame) -> DataFrame:
    """Marked for broadcast if counting it allows; beyond that Spark joins by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def spread_join(rows: DataFrame, facts: DataFrame, key: str, size: str, by: str) -> DataFrame:
    """Inner join of rows with one fact per key, where a few keys may own most rows.

    The facts of the ``HOT_KEYS`` largest keys (a broadcast of fixed size) are repeated ``SPREAD``
    times and their rows dealt over the copies by a hash of the column ``by``. All rows take the
    same equi-join, so the result does not depend on which keys are hot.
    """
    hot = facts.where(F.col(size) > SPREAD).orderBy(F.desc(size), key).limit(HOT_KEYS).select(key, F.lit(SPREAD).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(by)), parts)).drop("_parts")
    copied = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_part", F.col("_part").cast("long")).drop("_parts", size)
    return dealt.join(copied, [key, "_part"]).drop("_part")


def shielded(docs: DataFrame, *needed: str):
    """The frame with all columns but the needed ones under names of no meaning, and what gives them their own again.

    So no column of the input is taken for a helper's. ``undo(out, *added)`` puts the columns in their old order, then
    those added; a column of the input called like one of these is replaced.
    """
    inner = [c if c in needed else f"column {n}" for n, c in enumerate(docs.columns)]

    def undo(out: DataFrame, *added: str) -> DataFrame:
        kept = [F.col(f"`{i}`").alias(c) for i, c in zip(inner, docs.columns, strict=True) if c not in added]
        return out.select(*kept, *added)

    return docs.toDF(*inner), undo


def every_nth(docs: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of the ``rows`` rows, chosen by a hash of doc_id and text."""
    step = max(1, rows // wanted)
    return docs if step == 1 else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)


_kept: dict = {}


def kept(key, make):
    """The one large object that a worker keeps from task to task; asking for another lets go of it."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Workers outlive a stage: what one operator kept must not add to what the next one needs."""
    _kept.clear()
    gc.collect()  # large objects may refer to each other: without this they stay until some later collection
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with this C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold at most ``limit`` bytes, or one row more."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = size = 0
        for at, length in enumerate(lengths):
            size += length
            if size >= limit:
                yield batch.slice(start, at + 1 - start)
                start, size = at + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, nulls as empty ones."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def with_fields(schema, *fields: tuple[str, str]):
    """A Spark schema with these fields put at its end; fields of the same names give way."""
    from pyspark.sql.types import StructType

    names = {name for name, _ in fields}
    out = StructType([f for f in schema.fields if f.name not in names])
    for name, kind in fields:
        out = out.add(name, kind)
    return out


def put(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with these columns at its end, in the order of :func:`with_fields`."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), [n for n, _ in kept] + list(columns))
