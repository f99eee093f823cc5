"""The trie of all prefixes of conversations, by the recursion of van Emde Boas.

Sequences are cut at half the depth: equal heads are one cut prefix, which gets a name; the heads make up the
upper trie, the tails under one name a lower forest. Both are of half the depth and are cut in turn, all of
them side by side: a round halves every segment of every sequence, so depth D takes log2(D) rounds and a round
handles a row for each segment. The last round leaves single symbols, the edges of the trie.

- Heads are compared by digests of blocks of 2, 4, 8, ... symbols (SHA-256 of the halves' digests), which
  partial aggregates build beforehand; no sequence is ever gathered in one place, however long it is.
- The name of a prefix is its smallest member. With its depth this is the key of a node.
- Totals of lower forests are grafted upward: those of the smallest segments first give, round by round, the total of
  each cut's lower forest; from the largest segments down, a cut then holds what hangs below it within its segment
  and what has been grafted to the cuts below, until segments are single nodes. Each round has half the rows of
  the one before, so all rounds together handle two or three rows for each symbol, however deep the trie is.

Equal sequences are one, with a weight, before the recursion begins. Names are joined back with the largest
groups dealt over several tasks, so a first turn that a third of all conversations share is no single task's work;
turns are numbered by a distributed sort, so a conversation may hold any share of the rows.

Null conv_ids belong to no conversation; null turns come first; turns of the same number come in the order of
their digests, and repeated rows are turns of their own. Null roles and texts are empty ones. Other columns are
ignored. An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, put, spread_join, stored, with_fields

# Bytes of member lists that one record holds on their way to be hashed.
CHUNK_BYTES = 1 << 20
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, symbol (32 bytes that stand for role and text) and weight (words of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("symbol"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("weight"))


def _numbered_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one part: number of the part, and of each row among those of its conversation here."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv").to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
        nth = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
        if conv[0] == last:
            nth[:starts[1] if len(starts) > 1 else None] += seen
        last, seen = conv[-1], int(nth[-1]) + 1
        yield put(batch, part=pa.array(np.full(len(conv), part)), nth=pa.array(nth))


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`turns` with ``part`` and ``nth``, and how many rows of each conversation lie in earlier parts.

    The position of a row is ``nth`` + ``before``; ``total`` is the length of its conversation.
    """
    # equal rows are alike, so which of them comes first does not matter; the salt lets them lie in several parts
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    order = ["conv", "turn", "symbol", "_salt"]
    sorted_rows = salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    placed = stored(sorted_rows.mapInArrow(_numbered_here, with_fields(rows.schema, ("part", "long"), ("nth", "long"))), "turns")
    # one row per conversation and part that holds some of it
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, stored(sizes.select("conv", "part", "n", before.alias("before"), F.sum("n").over(whole).alias("total")), "parts")


def rebuilt(conversations: DataFrame, every: int, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another one, as sequences and lengths for :func:`nodes`.

    Conversation c takes its first h turns from conversation c - c % ``every`` (all where that is shorter, none where it
    is absent) and goes on with its own turns after its first h. ``head`` is h, a column over ``conv``, at most ``most``.
    """
    placed, parts = numbered(turns(conversations))
    totals = parts.select("conv", "total").distinct()
    base = F.col("conv") - F.col("conv") % every
    heads = totals.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("total").alias("there"))
    convs = totals.select("conv", "total", base.alias("base"), head.alias("h")).join(heads, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = stored(convs.select("conv", "base", "h", "total", taken.alias("taken")), "conversations")

    facts = parts.join(convs.select("conv", "h", "taken"), "conv").select(
        F.struct("conv", "part").alias("key"), "n", "before", "h", "taken")
    at = F.col("nth") + F.col("before")
    own = spread_join(placed.withColumn("key", F.struct("conv", "part")), facts, "key", "n", "nth").select(
        "conv", at.alias("at"), "h", "taken", "symbol", "weight")
    own = stored(own, "numbered")
    # at most so many rows of each conversation that others begin with
    first = own.where((F.col("conv") % every == 0) & (F.col("at") < most)).select(F.col("conv").alias("base"), "at", "symbol", "weight")
    lent = convs.join(first, "base").where(F.col("at") < F.col("h")).select("conv", "at", "symbol", "weight")
    kept = own.where(F.col("at") >= F.col("h")).select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "symbol", "weight")
    length = F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))
    return stored(lent.unionByName(kept), "sequences"), convs.select("conv", length.alias("length"))


def _blocks(sequences: DataFrame, rounds: int) -> list[DataFrame]:
    """By level k: conv, at and digest of each block of 2 ** k symbols, those of its halves as left and right."""
    # the weight belongs to the symbol: equal symbols have equal ones
    symbol = F.concat("symbol", F.unhex(F.lpad(F.hex("weight"), 16, "0")))
    levels = [sequences.select("conv", "at", symbol.alias("digest"))]
    for _ in range(rounds):
        half = F.col("at") % 2
        pairs = levels[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(half == 0, F.col("digest"))).alias("left"), F.max(F.when(half == 1, F.col("digest"))).alias("right"))
        digest = F.unhex(F.sha2(F.concat("left", F.coalesce("right", F.lit(b""))), 256))
        levels.append(stored(pairs.withColumn("digest", digest), "blocks"))
    return levels


def _edges(blocks: list[DataFrame], top: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Halve all segments of all sequences until they are single symbols.

    By level k: the segments of 2 ** k symbols (seq, at, n, digest, and root, the name of the prefix under which one
    hangs), and the cuts that made them: name and root, depth of both, for prefixes that some sequence goes on from.
    """
    segments, cuts = [top], []
    for level in range(len(blocks) - 1, 0, -1):
        halves = blocks[level].select(F.col("conv").alias("seq"), "at", "left", "right")
        cut = stored(segments[0].drop("digest").join(halves, ["seq", "at"]), "cut")
        keyed = cut.withColumn("key", F.struct("root", "at", "left"))
        names = keyed.groupBy("key").agg(F.min("seq").alias("name"), F.count("*").alias("size"), F.count("right").alias("tails")).where("tails > 0")
        names = stored(names.select("key", "name", "size"), "names")
        tails = keyed.where(F.col("right").isNotNull()).drop("root")
        lower = spread_join(tails, names, "key", "size", "seq").select(
            "seq", (F.col("at") * 2 + 1).alias("at"), "n", F.col("name").alias("root"), F.col("right").alias("digest"))
        upper = cut.select("seq", (F.col("at") * 2).alias("at"), "n", "root", F.col("left").alias("digest"))
        segments.insert(0, stored(upper.unionByName(lower), "segments"))
        begin = F.shiftleft("key.at", level)
        cuts.insert(0, names.select("name", (begin + (1 << (level - 1))).alias("depth"), F.col("key.root").alias("root"), begin.alias("root_depth")))
    return segments, cuts


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of member lists arrive in order: one digest for each sequence."""
    at, digest = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch.column("seq").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if digest is None or key != at:
                if digest is not None:
                    out.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
        yield _digests(out)
    if digest is not None:
        yield _digests([(at, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"seq": pa.array([r[0] for r in rows], pa.int64()), "sha256": pa.array([r[1] for r in rows], pa.string())})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members to texts of their ids, comma-joined, cut where the sequence changes or a batch ends."""
    for batch in batches:
        seq, conv = (batch.column(c).to_numpy() for c in ("seq", "conv"))
        starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
        cuts = [c for a, b in zip(starts, np.append(starts[1:], len(seq)), strict=True) for c in range(a, b, CHUNK_BYTES // 24)]
        texts = [",".join(map(str, conv[a:b].tolist())).encode() for a, b in zip(cuts, [*cuts[1:], len(seq)], strict=True)]
        yield pa.RecordBatch.from_pydict({"seq": seq[cuts], "first": conv[cuts], "text": pa.array(texts, pa.binary())})


def member_digests(members: DataFrame) -> DataFrame:
    """seq and the SHA-256 of its members' decimal numbers (column conv), ascending and comma-joined.

    A hash runs over its text in order, so one task reads a sequence's list; it gets it as few large records, made
    by many tasks, and holds one at a time.
    """
    placed = members.select("seq", "conv").repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv")
    chunks = placed.mapInArrow(_chunks, "seq long, first long, text binary")
    return chunks.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq long, sha256 string")


def nodes(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv, at, symbol, weight); ``lengths`` has conv and length, 0 allowed.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves and saved (sums
    over the subtree: nodes without children, and a node's weight for each member but one), ends_sha256.
    """
    lengths = stored(lengths, "lengths")
    least, count, deepest = lengths.agg(F.min("conv"), F.count("*"), F.max("length")).first()
    rounds = max(0, int(deepest or 0) - 1).bit_length()
    blocks = _blocks(sequences, rounds)
    whole = blocks[-1].select("conv", "digest")
    equal = stored(whole.groupBy("digest").agg(F.min("conv").alias("seq"), F.count("*").alias("n")), "different")
    zero = F.lit(0).cast("long")
    segments, cuts = _edges(blocks, equal.select("seq", zero.alias("at"), "n", zero.alias("root"), "digest"))

    edges = segments[0].withColumn("key", F.struct("root", "at", "digest"))
    made = stored(edges.groupBy("key").agg(F.min("seq").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("size")), "nodes")
    weight = F.conv(F.hex(F.substring("key.digest", 33, 8)), 16, 10).cast("long")
    made = made.select("key", "size", "conv_id", (F.col("key.at") + 1).alias("depth"), F.col("key.root").alias("parent"), "n_convs",
                       ((F.col("n_convs") - 1) * weight).alias("own"))

    children = made.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = made.drop("key", "size").join(children.where("depth > 0"), ["conv_id", "depth"], "left")
    known = stored(known.withColumn("leaf", F.col("n_children").isNull().cast("long")), "known")
    grafted = known.select("conv_id", "depth", "leaf", "own").unionByName(_grafts(known, segments, cuts))
    totals = grafted.groupBy("conv_id", "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved"))

    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent"))
    out = known.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved")

    def long(value) -> Column:
        return F.lit(value).cast("long")

    first = known.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.coalesce(F.sum("leaf"), long(0)), long(1)).alias("n_leaves"),
                      F.coalesce(F.sum("own"), long(0)).alias("saved"))
    first = first.where(F.lit(count) > 0).select(
        long(least).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(count).alias("n_convs"), "n_children", "n_leaves", "saved")
    return out.unionByName(first).join(_ends(lengths, whole, equal, edges, made), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.when(F.col("depth") == 0, _turnless(lengths)).otherwise(F.lit(_NO_MEMBERS))))


def _grafts(known: DataFrame, segments: list[DataFrame], cuts: list[DataFrame]) -> DataFrame:
    """conv_id, depth, leaf and own: what hangs below each node that some sequence goes on from."""
    sums = [F.sum("leaf").alias("leaf"), F.sum("own").alias("own")]
    # totals of the segments that hang under one name, from single symbols to halves of the whole
    total = known.groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(*sums)
    lower = []
    for level, cut in enumerate(cuts):
        total = stored(total, "totals")
        lower.append(stored(cut.join(total, ["name", "depth"]), "lower"))
        upper = total.where(F.col("depth") % (2 << level) == 0)
        below = lower[-1].select(F.col("root").alias("name"), F.col("root_depth").alias("depth"), "leaf", "own")
        total = upper.unionByName(below).groupBy("name", "depth").agg(*sums)
    # what hangs below a cut, within its segment and beyond; at last every node is one
    held = known.select("conv_id", "depth", "leaf", "own").where("false")
    for level in range(len(cuts) - 1, -1, -1):
        there = segments[level].select(F.col("seq").alias("conv_id"), ((F.col("at") + 1) * (1 << level)).alias("depth"), "root")
        beyond = held.join(there, ["conv_id", "depth"]).select(F.col("root").alias("conv_id"), (F.col("depth") - (1 << level)).alias("depth"), "leaf", "own")
        within = lower[level].select(F.col("name").alias("conv_id"), "depth", "leaf", "own")
        held = stored(held.unionByName(within.unionByName(beyond).groupBy("conv_id", "depth").agg(*sums)), "grafts")
    return held


def _turnless(lengths: DataFrame) -> Column:
    """The digest of the members that have no turn at all."""
    found = member_digests(lengths.where("length = 0").select(F.lit(0).cast("long").alias("seq"), "conv")).first()
    return F.lit(found["sha256"] if found else _NO_MEMBERS)


def _ends(lengths: DataFrame, whole: DataFrame, equal: DataFrame, edges: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the nodes at which a sequence ends."""
    members = spread_join(whole, equal, "digest", "n", "conv").select("seq", "conv")
    last = lengths.select(F.col("conv").alias("seq"), (F.col("length") - 1).alias("at"))
    ends = edges.join(last, ["seq", "at"]).select("key", "seq")
    nodes = spread_join(ends, made.select("key", "size", "conv_id", "depth"), "key", "size", "seq")
    return nodes.join(member_digests(members), "seq").select("conv_id", "depth", F.col("sha256").alias("ends_sha256"))
