"""Byte-level BPE by recursive queries: encoding and decoding.

Every worker holds a DuckDB database with the merge table of the vocabulary. The different words of a
batch become token-position rows; a recursive query joins each pair of neighbours with the merge table
and contracts each word's leftmost pair of minimum rank, all words side by side, until none is left.
Decoding joins token-position rows with the vocabulary and puts the bytes together in order.

Results are those of the tiktoken library: a word that is itself in the vocabulary is that one token.
A null text is an empty text; a word of over ``LONG_WORD`` bytes is contracted by the same rule with a
heap, since the recursion takes as many rounds as a word has merges. Repeated rows get equal results, an empty
table an empty one. Other columns pass through; columns of the input called like an output are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import kept, put, slices, with_fields
from .pieces import KNOWN_PIECES, PieceIds

LONG_WORD = 256
# Bytes of text, and number of tokens, that one query handles.
BATCH_BYTES, BATCH_TOKENS = 4 << 20, 250_000

# A word's tokens are the characters of a text, in their positions: the recursion unfolds them to rows, joins each pair of
# neighbours with the merge table, and puts the merged token in place of each word's leftmost pair of minimum rank.
_SHIFT, _SURROGATES = 256, 0xD800
_ENCODE = f"""
WITH RECURSIVE step(word, state) USING KEY (word) AS (
  SELECT word, state FROM seed
  UNION
  SELECT word, concat(substr(state, 1, (best & 65535) - 1),
    chr(((best >> 16) + {_SHIFT} + CASE WHEN best >> 16 >= {_SURROGATES - _SHIFT} THEN 2048 ELSE 0 END)::INT), substr(state, (best & 65535) + 2))
  FROM step JOIN (
    SELECT word, min(packed | pos) AS best
    FROM (SELECT word, substr(state, pos, 2) AS pair, pos FROM (SELECT word, state, unnest(range(1, length(state))) AS pos FROM step))
    JOIN merges USING (pair) GROUP BY word) USING (word)
)
SELECT state FROM step ORDER BY word
"""
_DECODE = "SELECT bytes FROM tokens JOIN vocabulary USING (token) ORDER BY pos"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: bytes of a token -> rank, which is also its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _states(tokens: np.ndarray, cuts: np.ndarray) -> list[str]:
    """Tokens as characters: a text for each stretch between cuts."""
    codes = tokens.astype(np.int64) + _SHIFT
    whole = (codes + 2048 * (codes >= _SURROGATES)).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class _Codec:
    """What a worker keeps of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: int = KNOWN_PIECES) -> None:
        import duckdb

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True
        lefts, rights, merged = [], [], []
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    lefts.append(left)
                    rights.append(right)
                    merged.append(rank)
        pairs = _states(np.array([lefts, rights], np.int64).T.reshape(-1), np.arange(0, 2 * len(lefts) + 1, 2))
        self.database = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        # the rank stands above 16 bits for the position of a pair
        self._load("merges", pair=pa.array(pairs, pa.string()), packed=pa.array(np.array(merged, np.int64) << 16))
        self._load("vocabulary", token=pa.array(list(ranks.values()), pa.int32()), bytes=pa.array(list(ranks), pa.binary()))
        self.pieces = PieceIds(self._encode_pieces, known, encode_run=self._encode_run)

    def _load(self, name: str, **columns) -> None:
        self.database.register("loading", pa.table(columns))
        self.database.sql(f"CREATE TABLE {name} AS SELECT * FROM loading")
        self.database.unregister("loading")

    def _query(self, name: str, query: str, **columns) -> pa.Table:
        self.database.register(name, pa.table(columns))
        out = self.database.sql(query).to_arrow_table()
        self.database.unregister(name)
        return out

    def _encode_pieces(self, pieces: Sequence[str]) -> list[Sequence[int]]:
        cut = [self.pattern.findall(p) for p in pieces]
        ids, lengths = self._encode_words([w for ws in cut for w in ws])
        flat, total = ids.tolist(), np.concatenate([[0], np.cumsum(lengths)])
        ends = total[np.cumsum([0, *map(len, cut)])].tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _encode_run(self, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces that are a space and a key, cut into words as one text, and how many each piece has.

        Only the first word of such a piece begins with the space. Should their number differ, pieces are cut one by one.
        """
        words = self.pattern.findall("".join([" " + k for k in keys]))
        starts = np.flatnonzero(np.fromiter(map(str.startswith, words, repeat(" ")), bool, len(words)))
        if len(starts) != len(keys):
            found = self._encode_pieces([" " + k for k in keys])
            return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        ids, lengths = self._encode_words(words)
        return ids, np.add.reduceat(lengths, starts) if len(starts) else lengths

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has. A word that comes again is worked out once."""
        number = {w: n for n, w in enumerate(dict.fromkeys(words))}
        ids, lengths = self._different_words([w.encode() for w in number])
        index = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        takes = lengths[index]
        return ids[_stretches(np.cumsum(lengths)[index] - takes, takes)], takes

    def _different_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rank = np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        whole, few, many = np.flatnonzero(rank >= 0), np.flatnonzero((rank < 0) & (size <= LONG_WORD)), np.flatnonzero((rank < 0) & (size > LONG_WORD))
        lengths = np.ones(len(words), np.int64)
        joined, lengths[few] = self._contract_words([words[n] for n in few.tolist()], size[few])
        long = [_contract(words[n], self.ranks) for n in many.tolist()]
        lengths[many] = list(map(len, long))
        starts, ids = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.uint32)
        ids[starts[whole]] = rank[whole]
        ids[_stretches(starts[few], lengths[few])] = joined
        for at, some in zip(starts[many].tolist(), long, strict=True):
            ids[at:at + len(some)] = some
        return ids, lengths

    def _contract_words(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        state = _states(self.bytes[np.frombuffer(b"".join(words), np.uint8)], np.concatenate([[0], np.cumsum(sizes)]))
        found = self._query("seed", _ENCODE, word=np.arange(len(words), dtype=np.int32), state=pa.array(state, pa.string()))["state"]
        tokens = np.frombuffer(_joined(found)[0].decode().encode("utf-32-le"), "<u4").astype(np.int64) - _SHIFT
        tokens -= 2048 * (tokens >= _SURROGATES - _SHIFT)
        return tokens, pc.utf8_length(found).to_numpy().astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.pieces.encode(texts)

    def decode(self, parts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. An id outside the vocabulary stops the run."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        if not lengths.sum():
            return [b""] * len(parts)
        token = np.concatenate(parts).astype(np.int32)
        if token.min() < 0 or token.max() >= len(self.known) or not self.known[token].all():
            raise ValueError("a token id is not in the vocabulary")
        found = self._query("tokens", _DECODE, pos=np.arange(len(token), dtype=np.int64), token=token)["bytes"]
        whole, cuts = _joined(found)
        ends = cuts[np.cumsum([0, *lengths])].tolist()
        return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _joined(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """The bytes of all values one after another, and where each begins and the last one ends."""
    values = column.cast(pa.large_binary()).combine_chunks()
    cuts = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    return values.buffers()[2].to_pybytes()[cuts[0]:cuts[-1]], cuts - cuts[0]


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Leftmost pair of minimum rank first, with a heap over a linked list."""
    size = len(word)
    after, before, end = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < size:
            stop = end[after[at]]
            rank = ranks.get(word[at:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, at, stop))

    for at in range(size - 1):
        offer(at)
    while heap:
        _, at, stop = heapq.heappop(heap)
        nxt = after[at]
        if end[at] == 0 or nxt >= size or end[nxt] != stop:
            continue
        end[at], end[nxt] = stop, 0
        after[at] = after[nxt]
        if after[at] < size:
            before[after[at]] = at
        offer(at)
        offer(before[at])
    out, at = [], 0
    while at < size:
        out.append(ranks[word[at:end[at]]])
        at = after[at]
    return out


def _codec(path: str, pattern: str, known: int = KNOWN_PIECES) -> _Codec:
    """One codec per worker and vocabulary; workers serve many tasks."""
    return kept(("bpe", path, pattern, known), lambda: _Codec(read_ranks(path), pattern, known))


def _encoded(batches: Iterator[pa.RecordBatch], codec: _Codec, text: str, batch_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, batch_bytes):
        ids = codec.encode(batch.column(text).fill_null("").to_pylist())
        yield put(batch, ids=pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                  n_tokens=pa.array([len(i) for i in ids], pa.int64()))


def _decoded(batches: Iterator[pa.RecordBatch], codec: _Codec, batch_tokens: int = BATCH_TOKENS) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "ids", 4 * batch_tokens):
        parts, owner = [], []
        for row, ids in enumerate(batch.column("ids").fill_null(b"").to_pylist()):
            numbers = np.frombuffer(ids, "<u4")
            cuts = range(0, len(numbers), batch_tokens)
            parts += [numbers[c:c + batch_tokens] for c in cuts]
            owner += [row] * len(cuts)
        out: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
        for row, some in zip(owner, _in_turn(codec, parts, batch_tokens), strict=True):
            out[row].append(some)
        yield put(batch, decoded=pa.array([b"".join(x) for x in out], pa.binary()))


_IDS, _BYTES = (("ids", "binary"), ("n_tokens", "long")), (("decoded", "binary"),)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (the token ids as little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``path`` is a rank file that every executor can open; ``pattern`` cuts a text into words.
    """
    return docs.mapInArrow(lambda batches: _encoded(batches, _codec(path, pattern), text), with_fields(docs.schema, *_IDS))


def decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes that the column ``ids`` stands for; null ids give no bytes."""
    return docs.mapInArrow(lambda batches: _decoded(batches, _codec(path, pattern)), with_fields(docs.schema, *_BYTES))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", batch_bytes: int = BATCH_BYTES,
               batch_tokens: int = BATCH_TOKENS, known: int = KNOWN_PIECES) -> DataFrame:
    """Encode and decode in one worker: what ``decode(encode(...))`` gives, with one codec in memory for each task.

    ``batch_bytes`` of text are encoded and ``batch_tokens`` decoded at a time, and a worker knows about ``known`` pieces:
    fewer take less memory and more time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, known)
        yield from _decoded(_encoded(batches, codec, text, batch_bytes), codec, batch_tokens)

    return docs.mapInArrow(run, with_fields(docs.schema, *_IDS, *_BYTES))


def _in_turn(codec: _Codec, parts: list[np.ndarray], batch_tokens: int) -> Iterator[bytes]:
    """Decode so many parts at a time that their tokens fit one query."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > batch_tokens:
            yield from codec.decode(held)
            held, size = [], 0
        held.append(part)
        size += len(part)
    yield from codec.decode(held)
