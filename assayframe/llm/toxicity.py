"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the different words of a text (letters and digits, in lower case) and their first 4, 5 and 6 characters,
which stand in for stems, hashed into ``DIMENSIONS`` places; a beginning counts once for each different word. One weight per place serves all thresholds: P(severity >= k) = sigmoid(weights . features - threshold k). A document
gets its expected severity, the sum of these probabilities, its likeliest grade, and whether severity 1 or more is
likelier than not.

The model is fitted on at most about ``LABELLED`` labelled documents, chosen by a hash; that is all that reaches the
driver, as lists of places. Places whose share of toxic documents may be chance, by a likelihood-ratio test, are left
out; a place that only toxic or only clean documents hold is judged like any other. The others get weights with an L1
penalty. Where labels only
say toxic or not, :func:`graded` spreads toxic documents over the grades by how many words they hold that mark
toxic ones. Scoring is one pass over all whole texts with a model of fixed size.

Null and blank texts have no features. Labels that are null, of a document that is not there, or of a null doc_id are
not used; with labels of one grade only, every document gets that grade. Rows are judged alone; repeated rows get
equal results and an empty table an empty one. Columns of the input called like an output are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put, slices, small, stored, with_fields

DIMENSIONS, GRADES = 1 << 17, 4
LABELLED, STEPS, PENALTY = 20_000, 1000, 1e-4
BEGINNINGS = (4, 5, 6)
BATCH_BYTES, KNOWN_WORDS = 4 << 20, 500_000
# In how many toxic documents, and with what odds, a word marks toxic ones.
MARK_DOCUMENTS, MARK_ODDS = 5, 8.0
# For a place to be a feature: how many documents have it, and how far, in standard errors, its share of toxic ones is
# from chance (the square root of the likelihood ratio, which holds for counts of 0 too).
LEAST_DOCUMENTS, SURE = 3, 4.0

_WORD = re.compile(r"[^\W_]+")


def _place(part: str) -> int:
    return zlib.crc32(part.encode()) % DIMENSIONS


def word_places(word: str) -> list[int]:
    """The places of a word and its beginnings; a word is told apart from a beginning that looks like it."""
    return [_place(word), *(_place(word[:n] + "*") for n in BEGINNINGS if len(word) >= n)]


class _Known(dict):
    """What was worked out for a word, remembered up to a bound."""

    def __init__(self, work) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, word: str):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = self.work(word)
        return value


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> np.ndarray:
    """The places of a text's different words and of their beginnings."""
    found = [p for w in words(text) for p in word_places(w)]
    return np.array(found, np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(severity >= k) for k = 1, 2, ..., one column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def graded(marks: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades 1 to ``grades`` - 1 for toxic documents, by thirds (for four grades) of the number of marking places; else 0."""
    out = toxic.astype(np.int64)
    if toxic.any():
        cuts = np.quantile(marks[toxic], np.arange(1, grades - 1) / (grades - 1))
        out[toxic] = 1 + np.searchsorted(cuts, marks[toxic], "left")
    return out


def _ratio(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Twice the log-likelihood ratio of having a place and being toxic, against having nothing to do with each other."""
    every, has = max(1, toxic + clean), bad + good
    out = np.zeros(len(bad))
    for seen, row, column in ((bad, has, toxic), (good, has, clean), (toxic - bad, every - has, toxic), (clean - good, every - has, clean)):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] * every / (row[some] * column))
    return out


def selected(bad: np.ndarray, good: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """By place, from the number of toxic and of clean documents that have it: the log-odds of a toxic document,
    0 where they may be chance or the place is rare, and whether the place marks toxic documents."""
    odds = np.log((bad + 1) / (toxic + 2)) - np.log((good + 1) / (clean + 2))
    sure = (bad + good >= LEAST_DOCUMENTS) & (_ratio(bad, good, toxic, clean) >= SURE ** 2)
    return np.where(sure, odds, 0.0), (bad >= MARK_DOCUMENTS) & (odds >= np.log(MARK_ODDS))


def fit(rows: list[np.ndarray], grade: np.ndarray, scale: np.ndarray, grades: int = GRADES, steps: int = STEPS) -> Model:
    """Maximum likelihood of the grades with an L1 penalty, by accelerated proximal gradient.

    ``rows`` are the places of each document. They enter scaled by their log-odds, ``scale``; those of scale 0 get no
    weight. The step is one over a bound of the curvature.
    """
    n = len(rows)
    share = np.array([(np.sum(grade >= k) + 0.5) / (n + 1) for k in range(1, grades)])
    thresholds = np.log((1 - share) / share)
    places = np.flatnonzero(scale)
    out = np.zeros(DIMENSIONS)
    if not len(places) or not n:
        return Model(out, thresholds)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    kept = scale[flat] != 0
    column, owner, value = np.searchsorted(places, flat[kept]), owner[kept], scale[flat[kept]]
    weights = ahead = np.zeros(len(places))
    step = 4 / _curvature(column, owner, value, n, len(places))
    pace, squares = 1.0, np.full(len(thresholds), 1e-8)
    for _ in range(steps):
        score = np.bincount(owner, value * ahead[column], n)
        ends = np.concatenate([[-np.inf], thresholds, [np.inf]])
        low, high = _sigmoid(ends[grade] - score), _sigmoid(ends[grade + 1] - score)
        pull = low + high - 1  # derivative of the log-likelihood by the score
        moved = ahead + step / n * np.bincount(column, value * pull[owner], len(places))
        moved = np.sign(moved) * np.maximum(0, np.abs(moved) - step * PENALTY)
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = moved + (pace - 1) / following * (moved - weights)
        weights, pace = moved, following
        inside = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / inside, low * (1 - low) / inside
        slope = np.array([up[grade == k].sum() - down[grade == k + 1].sum() for k in range(len(thresholds))]) / n
        squares += slope ** 2
        thresholds = np.sort(thresholds + slope / np.sqrt(squares))
    out[places] = weights * scale[places]
    return Model(out, thresholds)


def _curvature(column: np.ndarray, owner: np.ndarray, value: np.ndarray, rows: int, columns: int) -> float:
    """The largest eigenvalue of X'X / rows, by power iteration."""
    x, size = np.ones(columns), 1.0
    for _ in range(20):
        x = np.bincount(column, value * np.bincount(owner, value * x[column], rows)[owner], columns)
        size = max(float(np.linalg.norm(x)), 1e-12)
        x /= size
    return 2 * size / rows


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int = LABELLED) -> DataFrame:
    """Text and label of at most about ``bound`` labelled documents, stored."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").alias("_doc"), F.col(label).cast("int").alias("label"))
    step = max(1, -(-known.count() // bound))
    known = known.where(F.pmod(F.xxhash64("_doc"), F.lit(step)) == 0)
    return stored(docs.select("doc_id", "text").join(small(known), F.col("doc_id") == F.col("_doc")).select("text", "label"), "labelled")


def _document_counts(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean documents that have each place: at most one row per place reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, DIMENSIONS), np.int64)
        for batch in batches:
            for text, mark in zip(batch.column("text").fill_null("").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[int(mark > 0), np.unique(features(text))] += 1
        places = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_pydict({"place": places, "bad": counts[1, places], "good": counts[0, places]})

    table = some.mapInArrow(run, "place long, bad long, good long").groupBy("place").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, DIMENSIONS), np.int64)
    out[:, table["place"].to_numpy()] = table["bad"].to_numpy(), table["good"].to_numpy()
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", grades: int = GRADES) -> Model:
    """Fit on labels 0, 1, ... up to ``grades`` - 1; labels of 0 and 1 only are graded first."""
    some = labelled(docs, labels, label)
    bad, good = _document_counts(some)
    n = {r["toxic"]: r["count"] for r in some.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    scale, marking = selected(bad, good, n.get(True, 0), n.get(False, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            found = [features(t) for t in batch.column("text").fill_null("").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "places": pa.array([f[scale[f] != 0].astype("<i4").tobytes() for f in found], pa.binary()),
                "marks": pa.array([len(np.unique(f[marking[f]])) for f in found], pa.int64()), "label": batch.column("label")})

    # the places that were selected, of a bounded number of documents
    table = some.mapInArrow(run, "places binary, marks long, label int").toArrow()
    rows = [np.frombuffer(p, "<i4") for p in table["places"].to_pylist()]
    marked = table["label"].to_numpy().astype(np.int64)
    known = len(marked) and marked.max() > 1
    grade = np.clip(marked, 0, grades - 1) if known else graded(table["marks"].to_numpy(), marked > 0, grades)
    return fit(rows, grade, scale, grades)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add severity (expected), grade (likeliest) and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        weight = _Known(lambda word: math.fsum(model.weights[p] for p in word_places(word))).__getitem__
        for batch in slices(batches, text, BATCH_BYTES):
            sums = np.array([math.fsum(map(weight, words(t))) for t in batch.column(text).fill_null("").to_pylist()])
            above = model.above(sums)
            each = -np.diff(np.hstack([np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))]), axis=1)
            yield put(batch, severity=pa.array(above.sum(1)), grade=pa.array(each.argmax(1).astype(np.int32)), toxic=pa.array(above[:, 0] >= 0.5))

    return docs.mapInArrow(run, with_fields(docs.schema, ("severity", "double"), ("grade", "integer"), ("toxic", "boolean")))
