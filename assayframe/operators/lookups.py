"""Facts looked up for rows by a key: code lists, limits by code, listed names that a text holds.

A table of facts is sent to all tasks if counting it shows that it is small; beyond that rows and facts are
joined by key, with the largest keys of the rows dealt out over several tasks. Null keys find nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import LARGEST_GROUPS, MOST_PARTS, ROWS_PER_PART
from .positions import durable

# A table of facts of so many rows, and bytes in its texts, may be sent to all tasks.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
# Names are found by a run of so many characters, shorter ones by all of theirs.
GRAM = 4


def is_small(table: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table may be sent to all tasks. Counts it."""
    texts = [F.octet_length(f"`{name}`") for name, kind in table.dtypes if kind == "string"]
    size = F.sum(sum((F.coalesce(t, F.lit(0)).cast("long") for t in texts), F.lit(16)))
    n, held = table.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return n <= most_rows and held <= most_bytes


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """The rows with a key; it must not stand twice, or rows would be looked up twice."""
    known = table.where(F.col(key).isNotNull())
    twice = known.groupBy(key).count().where("count > 1").select(key).limit(1).collect()
    if twice:
        raise ValueError(f"the key {twice[0][0]!r} stands more than once in a table of facts")
    return known


def with_facts(rows: DataFrame, facts: DataFrame, key: str, small: bool, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """All rows, with the columns of their key's fact, or nulls. ``facts`` has one row per key."""
    if small:
        return rows.join(F.broadcast(facts), key, "left")
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("count") / rows_per_part)).cast("int").alias("_parts")
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = counts.where(F.col("count") > rows_per_part).orderBy(F.desc("count"), key).limit(LARGEST_GROUPS).select(key, parts)
    # rows without a key match nothing and are dealt out as well
    count = F.coalesce("_parts", F.when(F.col(key).isNull(), F.lit(MOST_PARTS)).otherwise(F.lit(1)))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), count).cast("int")).drop("_parts")
    copied = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], "left").drop("_part")


def names_in(texts: DataFrame, text: str, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """``text`` and ``listed``: the names that it holds as (ord, name, code), in their order. Texts without any are left out.

    ``texts`` has each text once; ``names`` has name, code and ord; null and empty names are never found. Each name stands
    in an index under the one of its runs of ``gram`` characters that the fewest names hold. A text looks up its
    runs there by an equi-join, so its work does not grow with the number of names; candidates are then verified.
    """
    size = F.least(F.length("name"), F.lit(gram))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substring(F.col("name"), i, size)))
    each = names.where(F.length("name") > 0).select("name", "code", "ord", F.explode(runs).alias("_run"))
    held = each.groupBy("_run").agg(F.count("*").alias("_names"))
    index = durable(each.join(held, "_run").groupBy("ord", "name", "code").agg(F.min_by("_run", F.struct("_names", "_run")).alias("_run")))
    sizes = [r[0] for r in index.select(F.length("_run")).distinct().collect()]  # at most ``gram`` numbers
    if not sizes:
        return texts.where("false").select(text, F.lit(None).cast("array<struct<ord:bigint,name:string,code:string>>").alias("listed"))

    def of(n: int):
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n))))

    every = F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in sizes]))))
    looked = texts.where(F.length(text) > 0).select(text, F.explode(every).alias("_run"))
    found = looked.join(F.broadcast(index) if is_small(index) else index, "_run").where(F.contains(F.col(text), F.col("name")))
    listed = F.struct(F.col("ord").cast("long").alias("ord"), "name", "code")
    return found.groupBy(text).agg(F.array_sort(F.collect_list(listed)).alias("listed"))
