"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in at most four bits agree in at least four of them: that is
the guaranteed minimum of shared positional bytes. A posting list of one byte value would hold about 1/256 of
all fingerprints, and lists of pairs drawn from it would grow with the square of the corpus. So the index has
one list for each set of four positions and the four bytes there: two fingerprints share a list exactly if
their tally of shared bytes reaches four. Nothing is capped and no pair is lost.

Equal fingerprints are one entry. Within a list, candidates are verified by counting differing bits, and only
links that join groups are returned: a search from one fingerprint to those not yet reached. So a list of n
near copies yields n - 1 links, not n * n / 2, and its work shrinks as it reaches them.

Null and blank texts have fingerprint zero and link like any other. Rows are told apart by doc_id and text;
repeated rows, rows with a null doc_id included, get equal results. The component id is the smallest doc_id
reachable, null if none has one. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, put, shielded, slices, small, spread_join, stored, text_bytes, text_key, with_fields
from .components import components

SHINGLE, BITS, SEED = 4, 4, 42
BATCH_BYTES = 4 << 20
_SETS = list(combinations(range(8), 8 - BITS))
_MASKS = np.array([sum(0xFF << (8 * p) for p in s) for s in _SETS], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included; ties are 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: only A-Z change, and only ASCII space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # so that memory is bounded for any length
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(
            starts[at:min(n, at + 65536)].tolist(), stops[at:at + 65536].tolist(), strict=True)), np.uint64, min(n, at + 65536) - at)
        set_bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Add ``simhash``, the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, text, BATCH_BYTES):
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch, text)], np.uint64)
            yield put(batch, simhash=pa.array(found.view(np.int64)))

    return docs.mapInArrow(run, with_fields(docs.schema, ("simhash", "long")))


def links(prints: DataFrame) -> DataFrame:
    """Links a, b that join all of the different fingerprints in ``simhash`` that differ in at most four bits."""
    def signed(mask: np.uint64) -> int:
        return int(np.uint64(mask).view(np.int64))

    keys = F.array(*[F.col("simhash").bitwiseAND(F.lit(signed(m))) for m in _MASKS])
    postings = prints.select("simhash", F.posexplode(keys).alias("positions", "shared"))
    lists = postings.repartition("positions", "shared").sortWithinPartitions("positions", "shared").drop("shared")
    found = lists.mapInArrow(_linked, "a long, b long")
    return found.distinct()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists arrive sorted; one that goes on in the next batch is held back."""
    prints, sets = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        prints = np.concatenate([prints, batch.column("simhash").to_numpy().view(np.uint64)])
        sets = np.concatenate([sets, batch.column("positions").to_numpy().astype(np.int64)])
        starts = _list_starts(prints, sets)
        if len(starts) > 1:
            yield _links_of(prints[:starts[-1]], starts)
            prints, sets = prints[starts[-1]:], sets[starts[-1]:]
    if len(prints):
        yield _links_of(prints, np.append(_list_starts(prints, sets), len(prints)))


def _list_starts(prints: np.ndarray, sets: np.ndarray) -> np.ndarray:
    shared = prints & _MASKS[sets]
    changed = (shared[1:] != shared[:-1]) | (sets[1:] != sets[:-1])
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _links_of(prints: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Lists of two are verified all at once, longer ones by a search each."""
    sizes = np.diff(bounds)
    two = bounds[:-1][sizes == 2]
    near = np.bitwise_count(prints[two] ^ prints[two + 1]) <= BITS
    a, b = [prints[two][near]], [prints[two + 1][near]]
    for at in np.flatnonzero(sizes > 2):
        left, right = _search(prints[bounds[at]:bounds[at + 1]])
        a.append(left)
        b.append(right)
    both = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(both, ["a", "b"])


def _search(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each group of a list: everyone's reach among those that nobody has reached yet."""
    a, b, waiting, rest = [], [], [], members
    while len(rest) or waiting:
        if waiting:
            here = waiting.pop()
        else:
            here, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ here) <= BITS
        if near.any():
            reached = rest[near]
            a.append(np.full(len(reached), here))
            b.append(reached)
            waiting += list(reached)
            rest = rest[~near]
        elif not len(rest):
            break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, key (hash of the text), simhash, root (one for each group), component_id."""
    rows = fingerprints(docs.select("doc_id", F.col(text).alias("text"), text_key(text).alias("key"))).drop("text")
    rows = stored(rows, "fingerprints")
    prints = stored(rows.groupBy("simhash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    roots = components(links(prints))
    rooted = prints.join(roots, F.col("simhash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "simhash"))
    rooted = stored(rooted.select("simhash", "first", "n", "root"), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    facts = spread_join(rooted, named, "root", "prints", "simhash").select("simhash", "n", "root", "component_id")
    return spread_join(rows, facts, "simhash", "n", "key").select("doc_id", "key", "simhash", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of the smallest doc_id (null last), then of the smallest hash of
    the text; one row where that row is repeated."""
    docs, undo = shielded(docs, "doc_id", "text")
    same = groups(docs).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    wanted = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("first"))
    wanted = stored(wanted.select(F.col("first.doc_id").alias("_doc"), F.col("first.key").alias("_key"), F.col("first.n").alias("_n")), "wanted")
    kept = docs.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key() == F.col("_key")))
    if not wanted.where("_n > 1").isEmpty():
        once = kept.where("_n > 1").dropDuplicates(["_doc", "_key"])
        kept = kept.where("_n = 1").unionByName(once)
    return undo(kept)
