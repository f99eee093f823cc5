"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of characters that are no letters becomes one space; its n-grams of 1 to
``LONGEST`` characters are hashed to ``BUCKETS`` buckets. Spark adds up the n-grams of all labelled texts by language and
bucket; each task adds up its own first, so a language that owns most rows is no larger a group than any other. Per
language, executors turn the counts into log-probabilities (with add-``SMOOTH`` smoothing) and pack them as one row.

The matrix of log-probabilities is broadcast in blocks of at most ``LANGUAGES`` languages: 4 * ``BUCKETS`` * ``LANGUAGES``
bytes, whatever the corpus. More languages take more passes over the texts, whose bests are put together by row.
Tasks score batches of texts in numpy: the n-grams of a batch are rows of a sparse matrix, multiplied by gathering
their columns and adding them up text by text. A text of any length is scored whole, piece by piece.

The prediction is the language of the largest posterior (prior: its share of labelled texts), ties to the smaller
name; ``score`` is that posterior. A null text and one without a letter are `und`, with score 0, and so is every
text where nothing was learned. Texts without letters still count for the prior. Repeated rows are judged alike; an empty
table gives an empty one. Columns of the input called like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, put, slices, stored, text_key, with_fields

BUCKETS, LONGEST, SMOOTH = 1 << 16, 3, 0.5
# Languages of one pass; 32 MB of log-probabilities at most.
LANGUAGES = 128
# Bytes of text that one step scores, and characters of a text that it holds at a time.
BATCH_BYTES, PIECE = 1 << 20, 1 << 18
UNKNOWN = "und"

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _characters(text: str) -> np.ndarray:
    """Code points in lower case, each run of others one space, a space before and after."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == 32) & (codes[:-1] == 32)
    return codes[~again]


def grams(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams that hold a letter, as often as they occur; so many places of the text at a time."""
    codes = _characters(text)
    if len(codes) < 3:  # no letter
        return
    for at in range(0, len(codes), PIECE):
        yield _buckets(codes[at:at + PIECE + LONGEST - 1], min(PIECE, len(codes) - at), buckets)


def _buckets(codes: np.ndarray, places: int, buckets: int) -> np.ndarray:
    """Of the n-grams that begin at one of the first ``places`` characters."""
    out, total = [], np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(LONGEST):
            total = (total[:len(codes) - n] * _MIX[0]) ^ (codes[n:] * _MIX[1])
            mixed = (total ^ (total >> np.uint32(15))) * _MIX[2] + np.uint32(n)
            here = ((mixed ^ (mixed >> np.uint32(13))) % np.uint32(buckets))[:places]
            out.append(here[codes[:len(here)] != 32] if n == 0 else here)
    return np.concatenate(out).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text", BATCH_BYTES):
        for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").fill_null("").to_pylist(), strict=True):
            if name not in held:
                if len(held) == LANGUAGES:  # so that a task's memory is bounded
                    yield from _flushed(held)
                held[name] = np.zeros(BUCKETS, np.int64)
            for found in grams(text):
                held[name] += np.bincount(found, minlength=BUCKETS)
    yield from _flushed(held)


def _flushed(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, counts in held.items():
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(there), pa.string()), "bucket": pa.array(there.astype(np.int32)), "n": counts[there]})
    held.clear()


def _packed(part: pa.Table) -> pa.Table:
    """A language's counts as one row: its log-probabilities as 32-bit floats."""
    counts = np.zeros(BUCKETS)
    known = part.column("bucket").to_numpy()
    there = known >= 0
    counts[known[there]] = part.column("n").to_numpy()[there]
    texts = int(part.column("n").to_numpy()[~there].sum())
    logs = np.log(counts + SMOOTH) - np.log(counts.sum() + SMOOTH * BUCKETS)
    return pa.table({"lang": part.column("lang")[:1], "texts": pa.array([texts]), "logs": pa.array([logs.astype("<f4").tobytes()], pa.binary())})


def train(labelled: DataFrame) -> DataFrame:
    """The model of texts with a known language (columns lang and text): lang, texts, logs. Null languages are left out."""
    known = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    texts = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.lit(-1).alias("bucket"), "n")
    # a language's group has at most a row for each bucket
    rows = counts.unionByName(texts).groupBy("lang").applyInArrow(_packed, "lang string, texts long, logs binary")
    return stored(rows, "languages")


class _Matrix:
    """The languages of one pass: buckets by languages."""

    def __init__(self, rows: list, texts: int) -> None:
        self.names = [r["lang"] for r in rows]
        self.prior = np.log(np.array([r["texts"] for r in rows]) / texts)
        self.logs = np.ascontiguousarray(np.stack([np.frombuffer(r["logs"], "<f4") for r in rows]).T)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The log of prior times likelihood, texts by languages."""
        out = np.tile(self.prior, (len(texts), 1))
        held, owners, size = [], [], 0
        step = max(1, (1 << 21) // len(self.names))
        for n, text in enumerate(texts):
            for found in grams(text):
                held.append(found)
                owners.append(n)
                size += len(found)
                if size >= step:
                    self._add(out, held, owners)
                    held, owners, size = [], [], 0
        self._add(out, held, owners)
        return out

    def _add(self, out: np.ndarray, held: list[np.ndarray], owners: list[int]) -> None:
        sizes = np.array([len(h) for h in held], np.int64)
        some = np.flatnonzero(sizes)
        if not len(some):
            return
        starts = np.cumsum(sizes[some]) - sizes[some]
        sums = np.add.reduceat(self.logs[np.concatenate(held)], starts, axis=0, dtype=np.float64)
        np.add.at(out, np.array(owners)[some], sums)


def _best(logs: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: the best language, the log of its joint probability, and the log of the sum over all languages."""
    at = logs.argmax(axis=1)
    top = logs[np.arange(len(logs)), at]
    return [names[i] for i in at], top, top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


def _score(matrix, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: _Matrix = matrix.value
        for batch in slices(batches, text, BATCH_BYTES):
            texts = batch.column(text).fill_null("").to_pylist()
            names, top, whole = _best(held.scores(texts), held.names) if texts else ([], np.zeros(0), np.zeros(0))
            lettered = pc.match_substring_regex(batch.column(text), r"\pL").fill_null(False)
            yield put(batch, _best=pa.array(names, pa.string()), _top=pa.array(top), _whole=pa.array(whole), _lettered=lettered)

    return run


def predict(docs: DataFrame, model: DataFrame, text: str = "text", languages: int = LANGUAGES) -> DataFrame:
    """Add ``lang_pred`` and ``score``. ``docs`` needs doc_id and the text."""
    spark = docs.sparkSession
    names = sorted(r["lang"] for r in model.select("lang").toLocalIterator())
    if not names:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    texts = model.agg(F.sum("texts")).first()[0]
    fields = (("_best", "string"), ("_top", "double"), ("_whole", "double"), ("_lettered", "boolean"))

    def scored(rows: DataFrame, block: list[str]) -> DataFrame:
        held = _Matrix(model.where(F.col("lang").isin(block)).orderBy("lang").collect(), texts)
        order = sorted(range(len(held.names)), key=held.names.__getitem__)
        held.names, held.prior, held.logs = [held.names[i] for i in order], held.prior[order], np.ascontiguousarray(held.logs[:, order])
        return rows.mapInArrow(_score(spark.sparkContext.broadcast(held), text), with_fields(rows.schema, *fields))

    blocks = [names[at:at + languages] for at in range(0, len(names), languages)]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    known = F.col("_lettered")
    prediction = F.when(known, F.col("_best")).otherwise(F.lit(UNKNOWN)).alias("lang_pred")
    score = F.when(known, F.exp(F.col("_top") - F.col("_whole"))).otherwise(F.lit(0.0)).alias("score")
    if len(blocks) == 1:
        return scored(docs, blocks[0]).select(*others, prediction, score)
    keyed = docs.select("doc_id", text_key(text).alias("_key"), text)
    passes = None
    for block in blocks:
        one = scored(keyed, block).drop(text)
        passes = one if passes is None else passes.unionByName(one)
    # rows equal in doc_id and text have equal results; of languages alike the smaller name wins
    first = F.max_by(F.struct("_top", "_best", "_lettered"), F.struct("_top", F.lit(0) - F.col("_pass")))
    merged = passes.withColumn("_pass", F.array_position(F.lit(names), F.col("_best"))).groupBy("doc_id", "_key").agg(
        first.alias("_first"), F.max("_top").alias("_most"), F.collect_set(F.struct("_pass", "_whole")).alias("_each"))
    whole = F.col("_most") + F.log(F.aggregate("_each", F.lit(0.0), lambda a, x: a + F.exp(x["_whole"] - F.col("_most"))))
    merged = merged.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text"), "_first.*", whole.alias("_whole"))
    joined = docs.join(merged, F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key(text) == F.col("_text")))
    return joined.select(*others, prediction, score)
