"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one more component, sqrt(largest norm squared - own norm squared), and queries a 0 there: then the
largest inner product is the smallest distance, whatever the norms.

Centroids are fitted on a sample of bounded size: k-means, then lists that the sample fills unevenly are split.
They are searched by an in-memory graph of nearest centroids, from fixed entries, with a beam. Every vector goes
to its nearest list and, as a boundary vector, to further ones whose distance is within ``BOUNDARY`` times the
nearest. A query looks into its nearest ``LEAST_PROBES`` lists, then into further ones, of which only what beats the k-th of
the first comes back: as many as are searched (the beam), pruned by the ratio of their distance to that of the last of the
first. Both figures are measured: ``TRIALS`` vectors of the sample, held out of the centroids, look for their k nearest in the
sample by brute force; the beam is the least that reaches a list of ``COVERED`` of these, the ratio the least that leaves
``WITHIN``. Neighbours among all vectors are nearer than those in the sample, so this is on the safe side. How many lists that makes
follows from the data; there is no other limit. With ``exact`` every query looks into all lists. Long lists are dealt into
blocks by a hash of the id, so no list is one task. What is sent to all tasks is the centroids and one row per
list, at most ``MAX_LISTS``.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Of rows with one
vec_id, the smallest vector counts. Vectors of differing lengths stop the run. A query for which fewer than k
neighbours were found is answered from all lists. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
# Vectors per list aimed at, lists at most, vectors of the sample per list.
LIST_ROWS, MAX_LISTS, SAMPLE_PER_LIST = 64, 2048, 16
COPIES, BOUNDARY = 4, 1.25
LEAST_PROBES, TRIALS, COVERED, WITHIN = 8, 256, 0.98, 0.99
DEGREE, ENTRIES, EXPAND, ROUNDS = 24, 32, 8, 6
BLOCK_ROWS, QUERY_ROWS, HELD = 2048, 512, 400_000


@dataclass(frozen=True)
class Centroids:
    """Centroids, the neighbours of each in the graph, and where a search begins."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    # lists a query looks into: of the ``beam`` nearest found, those within this ratio of the last one of the first
    ratio: float = np.inf
    beam: int = LEAST_PROBES

    def nearest(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances of about the ``beam`` nearest centroids, nearest first; -1 fills up."""
        found = [self._search(vectors[at:at + 256], min(beam, len(self.points))) for at in range(0, len(vectors), 256)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        norms = (self.points ** 2).sum(1)
        own = (x ** 2).sum(1)[:, None]
        ids = np.tile(self.entries, (len(x), 1))
        far = own + norms[ids] - 2 * x @ self.points[self.entries].T
        done = np.zeros(ids.shape, bool)
        rows = np.arange(len(x))[:, None]
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            open_ = np.where(done | ~np.isfinite(far), np.inf, far)
            pick = np.argsort(open_, axis=1, kind="stable")[:, :max(EXPAND, beam // 16)]
            use = np.isfinite(open_[rows, pick])
            if not use.any():
                return np.where(np.isfinite(far), ids, -1), far
            done[rows, pick] = True
            near = self.graph[ids[rows, pick]]
            near = np.where(use[:, :, None], near, -1).reshape(len(x), -1)
            safe = np.maximum(near, 0)
            more = own + norms[safe] - 2 * np.einsum("bd,bnd->bn", x, self.points[safe])
            more[near < 0] = np.inf
            ids, far, done = np.hstack([ids, safe]), np.hstack([far, more]), np.hstack([done, near < 0])
            # of one centroid met twice the first, which knows whether it was expanded, stays
            by_id = np.argsort(np.where(np.isfinite(far), ids, len(self.points)), axis=1, kind="stable")
            ranked = ids[rows, by_id]
            again = np.zeros(ids.shape, bool)
            again[:, 1:] = (ranked[:, 1:] == ranked[:, :-1]) & np.isfinite(far[rows, by_id][:, :-1])
            lost = np.zeros(ids.shape, bool)
            lost[rows, by_id] = again
            far = np.where(lost, np.inf, far)


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> Centroids:
    """Balanced k-means on the sample, and the graph of its centroids."""
    random = np.random.default_rng(seed)
    points = sample[random.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = _home(sample, points)
        sizes = np.bincount(home, minlength=len(points))
        sums = np.stack([np.bincount(home, sample[:, d], len(points)) for d in range(sample.shape[1])], 1)
        points = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], points)
        # an empty list takes a member of one of the fullest
        full = np.argsort(-sizes, kind="stable")
        for to, source in zip(np.flatnonzero(sizes == 0), full, strict=False):
            if sizes[source] > 2 * len(sample) / len(points):
                points[to] = sample[random.choice(np.flatnonzero(home == source))]
    points = np.unique(points, axis=0)
    near = np.stack([np.argsort(((points - p) ** 2).sum(1), kind="stable")[1:DEGREE + 1] for p in points])
    graph = np.full((len(points), DEGREE), -1)
    graph[:, :near.shape[1]] = near
    # a ring besides, so that every centroid can be reached
    graph = np.hstack([graph, np.roll(np.arange(len(points)), 1)[:, None]])
    return Centroids(points, graph, random.choice(len(points), min(ENTRIES, len(points)), replace=False))


def calibrated(centroids: Centroids, sample: np.ndarray, largest: float, k: int) -> Centroids:
    """The centroids with the ratio that the sample's own neighbours ask for, and a beam that holds all lists within it."""
    trials = sample[:TRIALS]
    scores = [trials[at:at + 32] @ sample.T for at in range(0, len(trials), 32)]
    best = []
    for block, some in enumerate(scores):
        some[np.arange(len(some)), block * 32 + np.arange(len(some))] = -np.inf
        best.append(np.argsort(-some, axis=1, kind="stable")[:, :min(k, len(sample) - 1)])
    best = np.concatenate(best)
    if not best.size:
        return replace(centroids, beam=len(centroids.points))
    points = np.hstack([trials, np.zeros((len(trials), 1))])
    far = (points ** 2).sum(1)[:, None] + (centroids.points ** 2).sum(1) - 2 * points @ centroids.points.T
    far = np.sqrt(np.maximum(0, far))
    base = np.sort(far, axis=1)[:, [min(LEAST_PROBES, far.shape[1]) - 1]]
    lists, ok = _lists_of(centroids, _lifted(sample[best.ravel()], largest))
    row = np.repeat(np.arange(len(trials)), best.shape[1])
    asked = np.where(ok, far[row[:, None], lists], np.inf).min(1)
    ratio = float(np.quantile(asked / np.maximum(base[row, 0], np.finfo(float).tiny), WITHIN, method="higher"))
    rank = np.concatenate([(far[n] <= asked[row == n, None]).sum(1) for n in range(len(trials))])
    return replace(centroids, ratio=ratio, beam=max(LEAST_PROBES, int(np.quantile(rank, COVERED, method="higher"))))


def _fitted(sample: np.ndarray, largest: float, lists: int, k: int) -> Centroids:
    """Centroids of the sample, where it is large enough without the vectors on trial: these would be nearer than others are."""
    rest = sample[TRIALS:] if len(sample) > 4 * TRIALS else sample
    return calibrated(fit(_lifted(rest, largest), lists), sample, largest, k)


def _lists_of(centroids: Centroids, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists nearest to each vector, and which of them it goes to."""
    ids, far = centroids.nearest(lifted, 4 * COPIES)
    ids, far = ids[:, :COPIES], np.sqrt(np.maximum(0, far[:, :COPIES]))
    return ids, (ids >= 0) & (far <= BOUNDARY * far[:, :1])


def _home(sample: np.ndarray, points: np.ndarray) -> np.ndarray:
    half = (points ** 2).sum(1) / 2
    return np.concatenate([np.argmax(sample[at:at + 4096] @ points.T - half, axis=1) for at in range(0, len(sample), 4096)])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _valid(vector: Column) -> Column:
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(plain & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector (doubles) of the rows that take part, one for each id."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & _valid(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))


def search(table: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id", vector: str = "embedding", lists: int | None = None,
           exact: bool = False) -> DataFrame:
    """The k nearest found for each row that ``is_query`` (a condition on ``id``) picks: query_id, rank, id, score."""
    spark = table.sparkSession
    rows = stored(usable(table, id_column, vector), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, largest, least, most = rows.agg(F.count("*"), F.max(norm), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if least != most:
        raise ValueError(f"vectors have {least} to {most} components")
    lists = lists or max(1, min(MAX_LISTS, n // LIST_ROWS))
    step = max(1, n // (SAMPLE_PER_LIST * lists))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE_PER_LIST * lists)
    some = sample.select("vector").toArrow()["vector"].combine_chunks()
    picked = _matrix(some) if len(some) else _matrix(rows.limit(1).select("vector").toArrow()["vector"].combine_chunks())
    centroids = spark.sparkContext.broadcast(_fitted(picked, largest, lists, k))
    members = stored(rows.mapInArrow(_assign(centroids, largest), _MEMBER), "lists")
    blocks = stored(members.groupBy("list").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("blocks")), "blocks")
    queries = rows.where(is_query).withColumn("floor", F.lit(None).cast("double"))
    if exact:
        return _matched(queries.mapInArrow(_probe(centroids, "all"), _PROBE), members, blocks, k)
    near = stored(_matched(queries.mapInArrow(_probe(centroids, "near"), _PROBE), members, blocks, k), "near")
    floors = near.groupBy("query_id").agg(F.min("score").alias("_score"), F.count("*").alias("_n")).where(F.col("_n") >= k)
    floors = floors.select(F.col("query_id").alias("id"), F.col("_score").alias("floor"))
    bounded = queries.drop("floor").join(floors, "id", "left").select("id", "floor", "vector")
    far = _scores(bounded.mapInArrow(_probe(centroids, "far"), _PROBE), members, blocks, k)
    found = stored(_ranked(near.select("query_id", "id", "score").unionByName(far), k), "found")
    short = found.groupBy("query_id").agg(F.count("*").alias("found")).where(F.col("found") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    rest = stored(queries.join(short, "id", "left_anti"), "rest")
    if n > 1 and not rest.isEmpty():
        everywhere = _matched(rest.mapInArrow(_probe(centroids, "all"), _PROBE), members, blocks, k)
        found = found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(everywhere)
    return found


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    last = np.sqrt(np.maximum(0, largest - (vectors ** 2).sum(1)))
    return np.hstack([vectors, last[:, None]])


_MEMBER, _PROBE = "list int, id long, vector array<double>", "list int, id long, floor double, vector array<double>"


def _rows_of(batch: pa.RecordBatch, row: np.ndarray, lists: np.ndarray, *columns: str) -> pa.RecordBatch:
    taken = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *[taken.column(c) for c in columns]], ["list", *columns])


def _assign(centroids, largest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, own = _lists_of(centroids.value, _lifted(_matrix(batch.column("vector")), largest))
                row, at = np.nonzero(own)
                yield _rows_of(batch, row, ids[row, at], "id", "vector")

    return run


def _probe(centroids, which: str):
    """Queries with their lists: the ``near`` ones, the ``far`` ones within the ratio, or ``all`` there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            columns = ("id", "floor", "vector")
            if which == "all":
                n = len(centroids.value.points)
                yield _rows_of(batch, np.repeat(np.arange(len(x)), n), np.tile(np.arange(n), len(x)), *columns)
                continue
            ids, far = centroids.value.nearest(np.hstack([x, np.zeros((len(x), 1))]), centroids.value.beam)
            far = np.sqrt(np.maximum(0, far))
            first = np.arange(ids.shape[1]) < LEAST_PROBES
            keep = (ids >= 0) & (first if which == "near" else ~first & (far <= centroids.value.ratio * far[:, [min(LEAST_PROBES, far.shape[1]) - 1]]))
            row, at = np.nonzero(keep)
            yield _rows_of(batch, row, ids[row, at], *columns)

    return run


def _matched(probes: DataFrame, members: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    return _ranked(_scores(probes, members, blocks, k), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    best = scores.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _scores(probes: DataFrame, members: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Queries meet the blocks of their lists; each task keeps the k best it has seen of each query, if not below its floor."""
    sizes = F.broadcast(blocks)  # one row per list
    placed = members.join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", F.lit(None).cast("double").alias("floor"), "vector")
    asked = probes.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "floor", "vector")
    met = placed.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "kind", "id")
    return met.mapInArrow(_best(k), "query_id long, id long, score double")


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        place, ids, vectors = None, [], []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("list", "block", "kind")], 1)
            bounds = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1), [True]]))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                part = batch.slice(a, b - a)
                if place != tuple(where[a, :2]):
                    place, ids, vectors = tuple(where[a, :2]), [], []
                own, x = part.column("id").to_numpy(), _matrix(part.column("vector"))
                floor = part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                if where[a, 2] == 0:
                    ids.append(own)
                    vectors.append(x)
                elif ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for at in range(0, len(own), QUERY_ROWS):
                        some = slice(at, at + QUERY_ROWS)
                        held.append(_top(own[some], x[some], floor[some], ids[0], vectors[0], k))
                        rows += len(held[-1][0])
                    if rows > HELD:
                        held = [_merged(held, k)]
                        rows = len(held[0][0])
                        if rows > HELD // 2:
                            yield _batch(held[0])
                            held, rows = [], 0
        if held:
            yield _batch(_merged(held, k))

    return run


def _top(queries: np.ndarray, x: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The k best of one block for each query. Scores of those are summed in one fixed order, so that equal pairs get
    equal scores wherever they meet."""
    rough = x @ vectors.T
    rough[queries[:, None] == ids[None, :]] = -np.inf
    cut = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(x), -np.inf)
    cut = np.maximum(cut, floor)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
    row, at = np.nonzero((rough >= (cut - slack)[:, None]) & (rough > -np.inf))
    score = np.zeros(len(row))
    for d in range(x.shape[1]):
        score += x[row, d] * vectors[at, d]
    return _merged([(queries[row], ids[at], score)], k)


def _merged(held, k: int):
    query, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    again = np.zeros(len(query), bool)
    again[1:] = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1])
    query, ids, score = query[~again], ids[~again], score[~again]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[nth < k], ids[nth < k], score[nth < k]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query_id", "id", "score"])
