"""Joining the rows of a table back to facts about the groups they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# So many of the largest groups are dealt out over several tasks each: one task for each so many
# rows, up to a limit. What is broadcast is this many keys, whatever the size of the table.
LARGEST_GROUPS = 1000
ROWS_PER_PART, MOST_PARTS = 10_000, 256


def rows_with_group(
    rows: DataFrame, groups: DataFrame, key: str, size: str, largest: int = LARGEST_GROUPS,
    rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Each row with the facts of its group; rows of no listed group are left out.

    ``groups`` has one row per ``key``, with the number of rows it stands for in ``size``. All rows
    take one equi-join on the key and a part number. Of the ``largest`` groups the facts are repeated
    for several parts and the rows dealt over them by a hash of their columns, so the rows of a hot
    key do not meet in one task; every other group has the single part 0.
    """
    # ordering by all columns makes this use of ``groups`` the same plan as the other: Spark then
    # aggregates once
    order = [F.desc(size), *[F.col(f"`{c}`") for c in groups.columns if c != size]]
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col(size) / rows_per_part)).cast("int")
    hot = groups.orderBy(*order).limit(largest).where(F.col(size) > rows_per_part).select(key, parts.alias("_parts"))
    count = F.coalesce("_parts", F.lit(1))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*columns), count).cast("int")).drop("_parts")
    facts = groups.join(F.broadcast(hot), key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), count - 1))).drop("_parts")
    return dealt.join(facts, [key, "_part"]).drop("_part")
