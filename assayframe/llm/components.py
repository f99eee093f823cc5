"""Connected components of a graph given as a table of links.

Each round, every node with a smaller neighbour hooks to the smallest one, chains of hooks are halved
until all end at a root, and links are rewritten to roots; links inside a component vanish. Only
aggregates, which are added up before the shuffle, and equi-joins are used, so a node with very many
neighbours is no single task's work. Every round is stored, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``links`` has the columns a and b. Returns node and root, the smallest node of its component.

    Only nodes with a link are listed; nulls and links of a node to itself are ignored.
    """
    links = stored(_oriented(links), "links")
    found = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "found")
    while not links.isEmpty():
        hooks = _roots(stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks"))
        found = stored(_rewritten(found, hooks, "root"), "found")
        links = stored(_oriented(_rewritten(links, hooks, "a", "b")), "links")
    return found


def _oriented(links: DataFrame) -> DataFrame:
    different = links.where(F.col("a") != F.col("b"))
    return different.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow hooks, twice as far each time, until every node points to a node without a hook."""
    while True:
        onward = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
        step = stored(hooks.join(onward, F.col("root") == F.col("_at"), "left").select(
            "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "hooks")
        hooks = step.drop("moved")
        if step.where("moved").isEmpty():
            return hooks


def _rewritten(table: DataFrame, hooks: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        at = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_root"))
        table = table.join(at, F.col(column) == F.col("_at"), "left").withColumn(column, F.coalesce("_root", column)).drop("_at", "_root")
    return table
