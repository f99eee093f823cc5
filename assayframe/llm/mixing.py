"""Mixing sources to target weights by systematic sampling.

A source's documents all have the same number of expected copies, target / size. In a fixed order, the
prefix sum of expected copies plus one random offset per source crosses integers; a document is taken
once for each integer it crosses. So a source takes its expected number of documents, give or take one,
and a document never more than ``cap`` times. The order is: hash range of about ``RANGE_ROWS`` documents,
then size, so that sizes are stratified and words come near the target too. No range is one source's
whole, so a source that owns a third of all rows is spread over many tasks.

A null text has size 0; null is a source like any other, last in order. Documents of size 0 are sampled
too, and add nothing. A source of size 0 has target 0 and is left out. Rows equal in doc_id, text and size
are interchangeable. An empty table gives an empty one. Columns of the input called like an output are
replaced. Reruns agree, however the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPREAD, WORD, shielded, stored

RANGE_ROWS, RANGES = 4096, 65536
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix"


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _place() -> Column:
    """One of ``RANGES`` places, by a hash of doc_id and text."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.shiftright(_hash32(text), 16)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: n, source_size, target. ``sizes`` has source, n, source_size, one row per source.

    The windows run over one row per source, not over data. A source is capped if the level that is left
    when all sources of smaller cap per weight are capped would lift it above its cap.
    """
    everything = Window.partitionBy().orderBy("_ratio", "_nth").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(w) for w in weights])
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    total = Window.partitionBy()
    level = (
        sizes.withColumn("_nth", nth).withColumn("_w", F.get(cycle, (F.col("_nth") - 1) % len(weights)))
        .withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumns({"_all": F.sum("source_size").over(total), "_weights": F.sum("_w").over(total),
                      "_caps_before": F.coalesce(F.sum("_cap").over(everything), F.lit(0)),
                      "_weights_before": F.coalesce(F.sum("_w").over(everything), F.lit(0))})
    )
    capped = F.col("_cap") * (F.col("_weights") - F.col("_weights_before")).cast("double") <= (
        F.col("_all") - F.col("_caps_before")).cast("double") * F.col("_w")
    level = level.withColumn("_capped", capped).withColumns({
        "_left": F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(total),
        "_open": F.col("_weights") - F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0)).over(total)})
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(
        (F.col("_left") * F.col("_w")).cast("double") / F.col("_open").cast("double"))
    return level.select("source", "n", "source_size", target.alias("target"))


def _ranges(n: Column) -> Column:
    return F.least(F.lit(RANGES), F.floor(n / RANGE_ROWS) + 1)


def _range() -> Column:
    return F.floor(F.col("_place") * F.col("_ranges") / RANGES)


def sample(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every document with size, source_size, target and copies (how often the mix takes it)."""
    docs, undo = shielded(docs, "doc_id", "source", "text")
    sized = docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_place": _place()})
    # first pass: counts by source and place, added up to sources and to the ranges of their documents
    places = stored(sized.groupBy("source", "_place").agg(F.count("*").alias("_n"), F.sum("size").alias("_size")), "places")
    sizes = places.groupBy("source").agg(F.sum("_n").alias("n"), F.sum("_size").alias("source_size"))
    sources = stored(targets(sizes, weights, cap).withColumn("_ranges", _ranges(F.col("n"))), "sources")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        _with_source(places, sources).withColumn("_range", _range()).groupBy("source", "_range").agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col("source").alias("_source"), F.col("_range").alias("_in"), "_before")
    )
    # second pass: a document's place in its range, and the range's first place in the source
    order = Window.partitionBy("source", "_range").orderBy("size", "doc_id", "_place", F.xxhash64("text"))
    placed = _with_source(sized, sources).withColumn("_range", _range()).withColumn("_nth", F.row_number().over(order))
    placed = placed.join(ranges, (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("_range") == F.col("_in")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _hash32(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))) / float(1 << 32)
    nth = F.col("_before") + F.col("_nth")
    copies = F.floor(nth * rate + offset) - F.floor((nth - 1) * rate + offset)
    return undo(placed.withColumn("copies", copies.cast("long")), "size", "source_size", "target", "copies")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the facts of their source: by broadcast if there are few sources, else by a salted join."""
    facts = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if facts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), same).drop("_source", "n")
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.join(salted, same & (F.col("_place") % SPREAD == F.col("_salt"))).drop("_source", "_salt", "n")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the columns of ``docs``."""
    inner, undo = shielded(docs, "doc_id", "source", "text")
    taken = sample(inner, weights, cap, seed).where(F.col("copies") > 0)
    return undo(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
