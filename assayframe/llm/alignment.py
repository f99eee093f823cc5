"""Aligning the tokens of two tokenizers, with external spill counting of the pairs that end together.

A task encodes its texts with both tokenizers. Byte offsets at which a token of each ends cut a text into groups;
the two tokens that end there are a link. The links of a batch of texts are one run: its different pairs sorted by
radix of the B id, then by B id, then by A id (side-major), with their numbers, compressed by zstd; and a body that
says which of these pairs each text holds, and how often.

- Counting up: the runs of a radix partition are merged by a heap, at most some ``FAN_IN`` at a time, to one sorted run
  with the sums; runs of runs are merged likewise until one is left for each radix. That one holds the count of every pair
  corpus-wide, and as a B id's pairs stand together, its maximum is known when they have passed.
- Streaming back: each merge is walked once more. A run's pairs are a part of those of the run it went into, so the counts
  of that one give its own, in order, down to the runs of texts. There they meet the body, and a text's sums are added up.

A pair that every text holds is one entry in each run, so no pair and no B id is a large group; runs are of bounded
size (one text may be longer). Radix partitions grow in number with the texts, merged runs with the vocabularies only.

Texts are cut at spaces before other text, where neither tokenizer's tokens go on (no piece of B holds a space after
other text; that is checked), so tokens, groups and links of each different piece are worked out once per worker.

A text has no tokens if it is null or empty, or if the joined tokens of either tokenizer are not the bytes of a space and
the text; all its numbers are 0 and its groups ''. Repeated rows count as often as they occur and get equal results; an
empty table gives an empty one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, stored

# Bytes of text of one run, and of all texts for one radix partition.
RUN_BYTES, RADIX_BYTES = 2 << 20, 32 << 20
# Runs that are merged at a time, on average.
FAN_IN = 64
# A worker forgets its pieces when it has seen so many different ones.
KNOWN_PIECES = 250_000
# An A id takes so many bits of a pair's key.
A_BITS = 24

_ODD_SPACE = re.compile(r" (?=\s)| \Z")
_BETWEEN = re.compile(r"(?<=\S)(?= )")
_RUN = "run long, radix int, keys binary, counts binary, best binary, docs binary"


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others,
    in order, for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers, and what a worker knows of the pieces of texts it has seen."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        to_byte = byte_characters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in to_byte for c in token):
                self.bytes_a[i] = bytes(to_byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("tokens of the second tokenizer go on over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        # an id as text, and what follows it: another of its side, the other side, the next group
        self.written = np.array([f"{i}{end}" for i in range(max(len(self.bytes_a), len(pieces))) for end in ",|;"], object)
        self._forget()

    def _forget(self) -> None:
        """Per piece: n_a, n_b, n_groups, whether both tokenizers give its bytes; its groups as text; its links."""
        self.numbers: dict[str, int] = {}
        self.facts = np.zeros((0, 4), np.int64)
        self.groups: list[str] = []
        self.links: list[np.ndarray] = []

    def _learn(self, pieces: list[str]) -> None:
        """``pieces`` begin with a space, which B adds itself. All are aligned at once, as one text."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        if " " in pieces:  # nothing to add a space to
            b[pieces.index(" ")] = [self.b.piece_to_id("▁")]
        wholes = [p.encode() for p in pieces]
        good = np.ones(len(pieces), bool)
        if any(b"".join([known[i] for ids in side for i in ids]) != b"".join(wholes) for side, known in ((a, self.bytes_a), (b, self.bytes_b))):
            good[:] = [all(b"".join([known[i] for i in ids]) == whole for ids, known in ((x, self.bytes_a), (y, self.bytes_b)))
                       for x, y, whole in zip(a, b, wholes, strict=True)]
        kept = np.flatnonzero(good).tolist()
        links, texts, n_groups = self._aligned([a[n] for n in kept], [b[n] for n in kept], [len(wholes[n]) for n in kept])
        first = len(self.numbers)
        self.numbers.update((p, first + n) for n, p in enumerate(pieces))
        none = np.zeros(0, np.int64)
        facts = np.zeros((len(pieces), 4), np.int64)
        facts[:, 0], facts[:, 1], facts[:, 3] = list(map(len, a)), list(map(len, b)), good
        facts[kept, 2] = n_groups
        self.facts = np.concatenate([self.facts, facts])
        if len(kept) < len(pieces):
            of = dict(zip(kept, zip(links, texts, strict=True), strict=True))
            links, texts = ([of.get(n, (none, ""))[k] for n in range(len(pieces))] for k in (0, 1))
        self.links += links
        self.groups += texts

    def _aligned(self, a: list[list[int]], b: list[list[int]], sizes: list[int]) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """Of some pieces: the keys of their links, their groups as text, each with ';' after it, and how many."""
        def side(ids: list[list[int]], known: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = [i for x in ids for i in x]
            return counts, np.array(flat, np.int64), np.cumsum(np.fromiter((len(known[i]) for i in flat), np.int64, len(flat)))

        (n_a, ids_a, ends_a), (n_b, ids_b, ends_b) = side(a, self.bytes_a), side(b, self.bytes_b)
        both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        keys = ids_b[at_b] << A_BITS | ids_a[at_a]
        stops = np.searchsorted(both, np.cumsum(np.array(sizes, np.int64)), "right")
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        # tokens in the order they are written: group by group, A before B
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 2
        order = np.argsort(np.concatenate([2 * np.searchsorted(both, ends_a), 2 * np.searchsorted(both, ends_b) + 1]), kind="stable")
        written = self.written[np.concatenate([ids_a * 3 + last_a, ids_b * 3 + last_b])[order]].tolist()
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        texts = ["".join(written[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return [keys[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], texts, stops - starts

    def encode(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int], str, np.ndarray]]:
        """Per text: n_a, n_b, n_groups; the digest of its groups; the keys of its links."""
        none = ((0, 0, 0), "", np.zeros(0, np.int64))
        if len(self.numbers) > KNOWN_PIECES:
            self._forget()
        cuts = []
        for text in texts:
            whole = " " + (text or "")
            cuts.append(_BETWEEN.split(whole) if _ODD_SPACE.search(whole) else [" " + p for p in whole[1:].split(" ")])
        new = [p for p in dict.fromkeys(p for cut in cuts for p in cut) if p not in self.numbers]
        if new:
            self._learn(new)
        for text, cut in zip(texts, cuts, strict=True):
            if not text:
                yield none
                continue
            at = [self.numbers[p] for p in cut]
            n_a, n_b, n_groups, good = self.facts[at].sum(axis=0).tolist()
            if good == len(at):
                yield (n_a, n_b, n_groups), _digest([self.groups[n] for n in at]), np.concatenate([self.links[n] for n in at])
            else:
                yield self._whole(text) or none

    def _whole(self, text: str) -> tuple[tuple[int, int, int], str, np.ndarray] | None:
        """A text with an odd piece: only all its bytes together decide."""
        whole = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        (links,), texts, (n_groups,) = self._aligned([a], [b], [len(whole)])
        return (len(a), len(b), int(n_groups)), _digest(texts), links


def _digest(groups: list[str]) -> str:
    return hashlib.sha256("".join(groups)[:-1].encode()).hexdigest()


def _squeezed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(array.astype("<i8").tobytes())


def _grown(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return _squeezed(np.diff(keys, prepend=0))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_grown(blob))


def _radix(keys: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of a pair, by its B id alone."""
    b = (keys >> A_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((b >> np.uint64(32)) % np.uint64(partitions)).astype(np.int64)


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups_sha256", pa.string()), ("n_links", pa.int64()), ("n_pairs", pa.int64())])
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _runs(path_a: str, path_b: str, partitions: int):
    """Texts to runs: a row for each radix with its pairs, and the body in a row of radix -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = kept(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", RUN_BYTES):
            rows, held = [], []
            for doc_id, (counts, digest, links) in zip(batch.column("doc_id").to_pylist(), pair.encode(batch.column("text").to_pylist()), strict=True):
                keys, times = np.unique(links, return_counts=True)
                rows.append((doc_id, *counts, digest, len(links), len(keys)))
                held.append((keys, times))
            every = np.concatenate([k for k, _ in held])
            times = np.concatenate([t for _, t in held])
            keys, slot = np.unique(every, return_inverse=True)
            totals = np.zeros(len(keys), np.int64)
            np.add.at(totals, slot, times)
            radix = _radix(keys, partitions)
            order = np.argsort(radix, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, totals, radix = keys[order], totals[order], radix[order]
            starts = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1]])) if len(radix) else np.zeros(0, np.int64)
            stops = np.append(starts[1:], len(radix))
            body = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _DOCS, strict=True)], schema=_DOCS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(body)
            spans = list(zip(starts.tolist(), stops.tolist(), strict=True)) if len(radix) else []
            yield _rows([number] * (len(spans) + 1), [-1, *[int(radix[s]) for s, _ in spans]],
                        [_squeezed(place[slot]), *[_steps(keys[s:e]) for s, e in spans]],
                        [_squeezed(times), *[_squeezed(totals[s:e]) for s, e in spans]], [b""] * (len(spans) + 1),
                        [sink.getvalue().to_pybytes(), *[b""] * len(spans)])
            number += 1

    return run


def _rows(run, radix, keys, counts, best, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(run, pa.int64()), pa.array(radix, pa.int32()), *[pa.array(x, pa.binary()) for x in (keys, counts, best, docs)]],
        ["run", "radix", "keys", "counts", "best", "docs"])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A k-way merge by a heap: keys in order, their sums, and for each run the places of its keys in the result."""
    ways = [zip(keys.tolist(), [n] * len(keys), counts.tolist(), strict=True) for n, (keys, counts) in enumerate(runs)]
    keys: list[int] = []
    sums: list[int] = []
    places: list[list[int]] = [[] for _ in runs]
    last = None
    for key, n, count in heapq.merge(*ways):
        if key != last:
            keys.append(key)
            sums.append(0)
            last = key
        sums[-1] += count
        places[n].append(len(keys) - 1)
    return np.array(keys, np.int64), np.array(sums, np.int64), [np.array(p, np.int64) for p in places]


def _merge(last: bool):
    """All runs of one group to a single one; with ``last``, also whether a pair's count is the highest of its B id."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["run", "radix", "keys", "counts"]).to_pylist()
        keys, sums, _ = _merged([(_keys(r["keys"]), _grown(r["counts"])) for r in rows])
        best = b""
        if last:
            # side-major: the pairs of a B id stand together
            b = keys >> A_BITS
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            best = _squeezed(sums == np.repeat(np.maximum.reduceat(sums, starts), np.diff(np.append(starts, len(b)))))
        group = table.column("into")[0].as_py()
        return pa.Table.from_batches([_rows([group], [rows[0]["radix"]], [_steps(keys)], [_squeezed(sums)], [best], [b""])])

    return run


def _back(key: tuple, below: pa.Table, above: pa.Table) -> pa.Table:
    """The counts of the run that a group of runs went into, for each of them in the order of its pairs."""
    rows, whole = below.select(["run", "radix", "keys", "counts"]).to_pylist(), above.to_pylist()[0]
    _, _, places = _merged([(_keys(r["keys"]), _grown(r["counts"])) for r in rows])
    counts, best = _grown(whole["counts"]), _grown(whole["best"])
    return pa.Table.from_batches([_rows([r["run"] for r in rows], [r["radix"] for r in rows], [r["keys"] for r in rows],
                                        [_squeezed(counts[p]) for p in places], [_squeezed(best[p]) for p in places], [b""] * len(rows))])


def _added(key: tuple, bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """One run of texts: what its pairs count corpus-wide, added up by text."""
    body = bodies.to_pylist()[0]
    rows = sorted(answers.select(["radix", "counts", "best"]).to_pylist(), key=lambda r: r["radix"])
    count = np.concatenate([np.zeros(0, np.int64), *[_grown(r["counts"]) for r in rows]])
    best = np.concatenate([np.zeros(0, np.int64), *[_grown(r["best"]) for r in rows]])
    slot, times = _grown(body["keys"]), _grown(body["counts"])
    docs = pa.ipc.open_stream(body["docs"]).read_all()
    ends = np.cumsum(docs.column("n_pairs").to_numpy())

    def by_text(values: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
        return pa.array(sums[ends] - sums[np.concatenate([[0], ends[:-1]])])

    n_best, count_sum = by_text(best[slot] * times), by_text(count[slot] * times)
    columns = {name: docs.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**columns, "n_best": n_best, "count_sum": count_sum, "groups_sha256": docs.column("groups_sha256")})


def align(docs: DataFrame, path_a: str, path_b: str, run_bytes_per_radix: int = RADIX_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their B id),
    count_sum (of the links' counts), groups_sha256.

    ``path_a`` is a byte-level tokenizer file, ``path_b`` a sentencepiece model that puts a space before a text; every
    executor can open both.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = 8 + size // run_bytes_per_radix
    runs = stored(texts.mapInArrow(_runs(path_a, path_b, partitions), _RUN), "runs")
    bodies = runs.where("radix < 0")
    level = runs.where("radix >= 0")
    n_runs = bodies.count()
    levels = []
    while True:
        groups = max(1, -(-n_runs // fan_in))
        into = F.pmod(F.xxhash64("run"), F.lit(groups)) if not levels else F.col("run") % groups
        level = level.withColumn("into", into.cast("long"))
        merged = level.groupBy("radix", "into").applyInArrow(_merge(groups == 1), _RUN)
        levels.append(level)
        level = stored(merged, "merged")
        if groups == 1:
            break
        n_runs = groups
    for below in reversed(levels):
        above = level.withColumn("into", F.col("run"))
        level = below.groupBy("radix", "into").cogroup(above.groupBy("radix", "into")).applyInArrow(_back, _RUN)
        if below is not levels[0]:
            level = stored(level, "answers")
    return bodies.groupBy("run").cogroup(level.groupBy("run")).applyInArrow(_added, _OUT)
