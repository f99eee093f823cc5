"""Substring dedup by super-k-mers: exact windows of words that occur more than once.

The minimiser of a window is the smallest hash of its runs of ``M`` words. Consecutive windows with the same
minimiser travel together, as one packed string (their words, joined by spaces), to the bucket of the
minimiser; equal windows have equal minimisers, so all places of a window meet in one bucket. There the
hashes of all windows are sorted, and windows of equal hash compared by a 32-byte digest of their words.

What keeps buckets even:

- runs of words found in many documents of a bounded sample come last in the order of hashes, so a frequent
  phrase is the minimiser only of windows that hold nothing rarer. The sample moves work, never results;
- a packed string found twice among ``HELD_BYTES`` of text is known to repeat. It is answered there and
  sent once, without its places; so of a passage with very many copies a task sends few strings;
- packed strings hold at most ``RUN`` windows;
- buckets grow in number with the bytes of all texts. A bucket is read string by string: what it keeps of them is
  their compressed form and 24 bytes for each window, so one of many times the usual size is no harm.

Null and blank texts have no words. Documents shorter than a window keep all words. Rows are told apart by
doc_id and a hash of the text; rows equal in both are copies of each other, and their windows repeat.
Columns of the input called like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import every_nth, let_go, put, shielded, slices, text_bytes, text_key, with_fields

WINDOW, M, RUN = 35, 4, 256
# Bytes of text whose strings are looked through for equal ones and compressed together, and that are packed at a time:
# hashing takes some 60 bytes for each of these.
HELD_BYTES, BATCH_BYTES = 4 << 20, 256 << 10
# Buckets for each shuffle partition at least, and bytes of text for one bucket at most.
BUCKETS, BUCKET_BYTES = 16, 1 << 20
# Of zstd.
LEVEL = 3
# Documents that are looked at for frequent runs, and in how many of them a run counts as frequent.
SAMPLE, FREQUENT = 10_000, 20

_ONE = np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up, cls.down = (np.multiply.accumulate(np.concatenate([[_ONE], np.full(n - 1, b % (1 << 64), np.uint64)]))
                                    for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]

    @classmethod
    def forget(cls) -> None:
        """Workers serve other operators after this one."""
        cls.up = cls.down = np.ones(1, np.uint64)


class Words:
    """Words in one buffer, separated by single spaces, with hashes of any slice of it."""

    def __init__(self, buffer: bytes) -> None:
        self.buffer = buffer
        raw = np.frombuffer(buffer, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if len(raw) else gaps
        self.ends = np.append(gaps, len(raw)) if len(raw) else gaps
        up, self._down = _Powers.get(len(raw) + 1)
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + _ONE) * up[:-1], dtype=np.uint64)])

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each slice of bytes; equal slices have equal ones."""
        return _mixed((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def slice(self, first: int, last: int) -> bytes:
        """The words from number ``first`` to number ``last``, inclusive."""
        return self.buffer[self.starts[first]:self.ends[last]]


def _runs(words: Words, m: int = M) -> np.ndarray:
    """The hash of each run of ``m`` words, without its highest bit."""
    h = words.hashes(words.starts, words.ends)
    n = max(0, len(h) - m + 1)
    total = np.zeros(n, np.uint64)
    for i in range(m):
        total += h[i:i + n] * _WEIGHTS[i]
    return _mixed(total) >> _ONE


def _minimisers(runs: np.ndarray, frequent: np.ndarray, window: int, m: int = M) -> np.ndarray:
    """The minimiser of each window: the smallest hash of its runs, frequent ones last."""
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        runs = np.where(frequent[place] == runs, runs | (_ONE << np.uint64(63)), runs)
    width, least = 1, runs
    while width < window - m + 1:
        step = min(width, window - m + 1 - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    return least


def _pieces(texts: list[bytes], limit: int, window: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(document, number of its first word, words). Long documents come in parts that overlap by a window less a word."""
    for row, text in enumerate(texts):
        words = text.split()
        step = max(window, limit // 8)
        if len(words) <= 2 * step:
            yield row, 0, words
            continue
        for at in range(0, len(words) - window + 1, step):
            yield row, at, words[at:at + step + window - 1]


def _batches(pieces, limit: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    held, size = [], 0
    for piece in pieces:
        if held and size >= limit // 8:
            yield held
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield held


class _Packed:
    """The packed strings of some pieces of documents."""

    def __init__(self, pieces: list[tuple[int, int, list[bytes]]], frequent: np.ndarray, window: int) -> None:
        pieces = [p for p in pieces if len(p[2]) >= window]
        self.words = Words(b" ".join(w for p in pieces for w in p[2]))
        counts = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
        before = np.cumsum(counts) - counts
        least = _minimisers(_runs(self.words), frequent, window)
        piece = np.repeat(np.arange(len(pieces)), counts)
        # windows that lie in one piece, and where a new packed string begins among them
        at = np.flatnonzero(piece[:len(least)] == piece[window - 1:window - 1 + len(least)])
        new = np.ones(len(at), bool)
        new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(at)))
        parts = -(-sizes // RUN)
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = np.repeat(at[begin], parts) + offset * RUN
        self.windows = np.minimum(RUN, np.repeat(sizes, parts) - offset * RUN)
        self.last = self.first + self.windows + window - 2
        self.key = least[self.first] if len(self.first) else least[:0]
        self.row = np.array([p[0] for p in pieces], np.int64)[piece[self.first]] if len(self.first) else np.zeros(0, np.int64)
        self.word = self.first - before[piece[self.first]] + np.array([p[1] for p in pieces], np.int64)[piece[self.first]] if len(self.first) else self.first

    def string(self, n: int) -> bytes:
        return self.words.slice(self.first[n], self.last[n])


_BUCKETED = "bucket long, strings binary, rows binary"
_PLACES = "doc_id long, key long, start long, stop long"


class _Held:
    """Packed strings on their way to buckets, each once, and the places of those that are known to repeat."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.buckets: list[int] = []
        self.places: list[tuple] = []
        self.known: list[tuple] = []
        self.size = 0

    def add(self, packed: _Packed, ids: list[int], none: list[bool], keys: list[int], buckets: int) -> None:
        bucket = (_mixed(packed.key) % np.uint64(buckets)).tolist()
        for n, (row, word, windows) in enumerate(zip(packed.row.tolist(), packed.word.tolist(), packed.windows.tolist(), strict=True)):
            place = (ids[row], none[row], keys[row], word, windows)
            string = packed.string(n)
            one = self.at.setdefault(string, len(self.places))
            if one == len(self.places):
                self.buckets.append(bucket[n])
                self.places.append((*place, 0))
            else:
                if not self.places[one][5]:
                    self.known.append(self.places[one][:5])
                    self.places[one] = (*self.places[one][:5], 1)
                self.known.append(place)
        self.size += len(packed.words.buffer)

    def rows(self, shrink, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row for each bucket; known places are spread below 0 by document."""
        out: dict[str, list] = {"bucket": [], "strings": [], "rows": []}

        def put_row(bucket: int, strings: bytes, places: list) -> None:
            out["bucket"].append(bucket)
            out["strings"].append(shrink.compress(strings) if strings else b"")
            out["rows"].append(shrink.compress(np.array(places, "<i8").tobytes()))

        for at in range(0, len(self.known), 4096):
            some = self.known[at:at + 4096]
            put_row(-1 - some[0][2] % buckets, b"", [(*p, 1) for p in some])
        strings, bucket = list(self.at), np.array(self.buckets, np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            some = order[a:b].tolist()
            put_row(int(bucket[some[0]]), b"\n".join([strings[n] for n in some]), [self.places[n] for n in some])
        if out["bucket"]:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int64()), "strings": pa.array(out["strings"], pa.binary()),
                                              "rows": pa.array(out["rows"], pa.binary())})


def _pack(frequent: np.ndarray, buckets: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=LEVEL)
        held = _Held()
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, none = batch.column("doc_id").fill_null(0).to_pylist(), batch.column("doc_id").is_null().to_pylist()
            keys = batch.column("key").to_pylist()
            for pieces in _batches(_pieces(text_bytes(batch), BATCH_BYTES, window), BATCH_BYTES):
                packed = _Packed(pieces, frequent, window)
                if len(packed.key):
                    held.add(packed, ids, none, keys, buckets)
                if held.size >= HELD_BYTES:
                    yield from held.rows(shrink, buckets)
                    held = _Held()
        yield from held.rows(shrink, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from rows(batches)  # what it held is gone when it ends
        _Powers.forget()
        let_go()  # a worker that waits must not hold what the next stage needs

    return run


def _places(places: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(places[:, 0], mask=places[:, 1].astype(bool)), "key": pa.array(places[:, 2]),
                     "start": pa.array(start), "stop": pa.array(stop)})


def _count(window: int):
    """Sort the windows of a bucket; return where runs of repeated ones lie in documents."""
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        grow = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(grow.decompress(r), "<i8").reshape(-1, 6) for r in table["rows"].to_pylist()]
        places = np.concatenate(parts)
        if table["bucket"][0].as_py() < 0:
            return _places(places, places[:, 3], places[:, 3] + places[:, 4] + window - 1)
        blobs = table["strings"]

        def read(part: int) -> tuple[Words, np.ndarray]:
            """The words of a part's strings, and the number of each window's first word among them."""
            words = Words(grow.decompress(blobs[part].as_py()).replace(b"\n", b" "))
            windows = parts[part][:, 4]
            first = np.cumsum(windows + window - 1) - (windows + window - 1)
            nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            return words, np.repeat(first, windows) + nth

        found = []
        for part in range(len(parts)):
            words, at = read(part)
            found.append(words.hashes(words.starts[at], words.ends[at + window - 1]))
        hashes = np.concatenate(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        del found
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        equal = np.zeros(len(hashes), bool)
        same = ranked[1:] == ranked[:-1]
        equal[order[1:][same]] = equal[order[:-1][same]] = True
        del order, ranked, same
        owner = np.repeat(np.arange(len(places)), places[:, 4])
        twice = places[owner, 5].astype(bool)
        seen: dict[bytes, int] = {}
        for part, begin in enumerate((np.cumsum(sizes) - sizes).tolist()):
            some = np.flatnonzero(equal[begin:begin + sizes[part]])
            if not len(some):
                continue
            words, at = read(part)
            for n in some.tolist():
                one = seen.setdefault(hashlib.sha256(words.slice(at[n], at[n] + window - 1)).digest(), begin + n)
                if one != begin + n:
                    twice[begin + n] = twice[one] = True
        _Powers.forget()
        # a string that its task found twice stands for places that are answered already
        hit = np.flatnonzero(twice & (places[owner, 5] == 0))
        if not len(hit):
            return _places(places[:0], places[:0, 3], places[:0, 3])
        nth = hit - (np.cumsum(places[:, 4]) - places[:, 4])[owner[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(hit)) - 1
        row = places[owner[hit[begin]]]
        return _places(row, row[:, 3] + nth[begin], row[:, 3] + nth[last] + window)

    return run


def frequent_runs(docs: DataFrame, rows: int, sample: int = SAMPLE, frequent: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the runs of words in ``frequent`` or more documents of a sample of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            for text in text_bytes(batch):
                found = np.unique(_runs(Words(b" ".join(text.split()))))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["run"])

    some = every_nth(docs.select("doc_id", "text"), rows, sample).mapInArrow(run, "run long")
    found = some.groupBy("run").count().where(F.col("count") >= frequent).select("run").toPandas()
    return np.sort(found["run"].to_numpy(np.int64).view(np.uint64))


def repeated_places(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Runs of words covered by repeated windows: doc_id, key, and word numbers start (inclusive) and stop (exclusive).

    Runs of one document may touch or overlap.
    """
    spark = docs.sparkSession
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = buckets or max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))
    frequent = frequent_runs(docs, rows)
    packed = keyed.mapInArrow(_pack(frequent, buckets, window), _BUCKETED)
    return packed.groupBy("bucket").applyInArrow(_count(window), _PLACES)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_layout: bool = False, text: str = "text") -> DataFrame:
    """The documents with repeated windows cut out of the text, and n_words and n_removed.

    The words that stay are joined by one space; with ``keep_layout`` the white space between words that were
    neighbours stays as it was. A text of which nothing stays is empty.
    """
    plain, undo = shielded(docs, "doc_id", text)
    renamed = plain.select("doc_id", F.col(text).alias("text"))
    places = repeated_places(renamed, window).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("_places"))
    places = places.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_places")
    own = plain.withColumn("_own", text_key(text))
    joined = own.join(places, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_key")), "left").drop("_doc", "_key", "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BATCH_BYTES):
            texts, n_words, n_removed = [], [], []
            for whole, cut in zip(text_bytes(batch, text), batch.column("_places").to_pylist(), strict=True):
                words = whole.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for place in cut or ():
                    gone[place["start"]] += 1
                    gone[place["stop"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                texts.append((_laid_out if keep_layout else _joined)(whole, words, gone))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
            at = batch.schema.get_field_index(text)
            out = batch.set_column(at, pa.field(text, pa.string()), pa.array([t.decode() for t in texts], pa.string()))
            out = out.drop_columns(["_places"])
            yield put(out, n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()))
        let_go()

    schema = with_fields(joined.drop("_places").schema, ("n_words", "long"), ("n_removed", "long"))
    out = joined.mapInArrow(run, schema)
    return undo(out, "n_words", "n_removed")


def _joined(whole: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _laid_out(whole: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    if not gone.any():
        return whole
    kept, at, begin = [], 0, None
    for word, cut in zip(words, gone.tolist(), strict=True):
        at = whole.index(word, at)
        if cut:
            if begin is not None:
                kept.append(whole[begin:end])
            begin = None
        elif begin is None:
            begin = at
        at = end = at + len(word)
    if begin is not None:
        kept.append(whole[begin:end])
    return b"\n".join(kept)
