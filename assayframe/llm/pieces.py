"""Cutting texts into pieces that a byte-level tokenizer encodes independently, and putting ids together.

The pre-tokenizing pattern never joins a character that is no white space with white space after it,
and a space directly before other text always begins a token. So a text may be cut at each such space,
and each different piece needs to be encoded only once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# In the syntax of Arrow. It may find more texts than hold such a space: these are cut with patterns, to the same pieces.
_ODD_TEXT = r" [\s\x0B\x1C-\x1F\x{85}\p{Z}]| \z"
_ODD_SPACE = regex.compile(r" (?=\s)| \Z")
_COARSE = regex.compile(r" ?\S+|\s+(?!\S)|\s+")

# A worker that has seen so many different pieces (some 100 MB) keeps only those that came up several times.
KNOWN_PIECES, SEVERAL = 400_000, 3


class PieceIds(dict):
    """Numbers of the pieces seen, and their token ids one after another.

    A key that is a string stands for a space and that string; a tuple holds a piece as it is. Texts with one of the
    strings in ``whole`` are never cut: to the tokenizer these are tokens wherever they stand. ``encode_run``, if given,
    encodes pieces that all begin with a space and have no other one as the text they make one after another: it returns
    all ids and how many each piece has.
    """

    def __init__(self, encode: Callable[[Sequence[str]], Sequence[Sequence[int]]], known: int = KNOWN_PIECES, whole: Sequence[str] = (),
                 encode_run: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        super().__init__()
        self._encode, self._known, self._encode_run = encode, known, encode_run
        self._whole = regex.compile("|".join(map(regex.escape, whole))) if whole else None
        self._odd = "|".join([*map(regex.escape, whole), _ODD_TEXT])
        self._new: list = []
        self._done = self._used = 0
        self._flat = np.zeros(1024, np.uint32)
        self._starts, self._lengths, self._uses = (np.zeros(1024, np.int64) for _ in range(3))

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self._new.append(key)
        return number

    def _forget(self) -> None:
        """Keep the pieces that came up several times, the most frequent half of what may be known at most."""
        uses = self._uses[:self._done]
        stay = np.flatnonzero(uses >= SEVERAL)
        if len(stay) > self._known // 2:
            stay = np.sort(stay[np.argsort(uses[stay], kind="stable")[-(self._known // 2):]])
        keys = list(self)
        keys = [keys[n] for n in stay.tolist()]
        lengths, flat = self._lengths[stay], self._gather(stay)
        self.clear()
        self.update(zip(keys, range(len(keys)), strict=True))
        self._done, self._used = len(keys), len(flat)
        self._flat = flat
        self._lengths, self._uses = lengths, np.zeros(len(keys), np.int64)
        self._starts = np.cumsum(lengths) - lengths

    def _learn(self) -> None:
        if not self._new:
            return
        if self._encode_run is None:
            self._add(self._found(self._new))
        else:
            whole = [n for n, k in enumerate(self._new) if type(k) is not str]
            found = self._found([self._new[n] for n in whole])
            run = np.delete(np.arange(len(self._new)), whole)
            self._place(run, *self._encode_run([k for k in self._new if type(k) is str]), np.array(whole, np.int64), *_joined(found))
        self._new.clear()

    def _found(self, keys: list) -> list[Sequence[int]]:
        """The ids of each key, worked out word by word."""
        # a key of two is a text that is not cut
        pieces = [" " + k if isinstance(k, str) else k[-1] for k in keys]
        cut = [_COARSE.findall(p) if "\n" in p and len(k) != 2 or not p else (p,) for k, p in zip(
            [k if isinstance(k, tuple) else () for k in keys], pieces, strict=True)]
        words = list(dict.fromkeys(w for ws in cut for w in ws))
        ids = dict(zip(words, self._encode(words), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in cut]

    def _add(self, found: Sequence[Sequence[int]]) -> None:
        self._place(np.arange(len(found)), *_joined(found))

    def _place(self, *parts: np.ndarray) -> None:
        """Of the pieces not yet placed: which ones, their ids one after another and their lengths, and again so."""
        size, count = self._used + sum(map(len, parts[1::3])), self._done + sum(map(len, parts[::3]))
        if size > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(size, np.uint32)])
        if count > len(self._starts):
            self._starts, self._lengths, self._uses = (
                np.concatenate([x, np.zeros(count, np.int64)]) for x in (self._starts, self._lengths, self._uses))
        for which, ids, lengths in zip(parts[::3], parts[1::3], parts[2::3], strict=True):
            self._flat[self._used:self._used + len(ids)] = ids
            self._lengths[self._done + which] = lengths
            self._starts[self._done + which] = self._used + np.cumsum(lengths) - lengths
            self._used += len(ids)
        self._done = count

    def _keys(self, text: str) -> list:
        if self._whole and self._whole.search(text):
            return [("", text)]
        if _ODD_SPACE.search(text):
            return [(p,) for p in _COARSE.findall(text)]
        keys = text.split(" ")
        if keys[0]:
            keys[0] = (keys[0],)
        else:
            del keys[0]
        return keys

    def _numbers(self, texts: Sequence[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts one after another, and how many each text has.

        Arrow cuts the texts and finds their different words, so only these are looked up.
        """
        column = pa.array(texts, pa.large_string())
        is_odd = pc.match_substring_regex(column, self._odd)
        odd, plain = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (is_odd, pc.invert(is_odd)))
        split = pc.split_pattern(column.take(pa.array(plain)), " ")
        cuts, words = split.offsets.to_numpy(), split.values
        # what stands before the first space is a piece as it is, unless empty
        heads = words.take(pa.array(cuts[:-1])).to_numpy(zero_copy_only=False)
        headed = np.fromiter(map(bool, heads), bool, len(heads))
        behind = np.ones(len(words), bool)
        behind[cuts[:-1]] = False
        coded = words.filter(pa.array(behind)).dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self), len(self) + len(new))
        self._new += different[new].tolist()
        self.update(zip(different[new], number[new].tolist(), strict=True))
        others = [self._keys(texts[n]) for n in odd.tolist()]
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(cuts) - ~headed
        counts[odd] = list(map(len, others))
        counts += end is not None
        ends = np.cumsum(counts)
        starts = ends - counts
        numbers, word = np.zeros(counts.sum(), np.int64), np.ones(counts.sum(), bool)
        first = starts[plain[headed]]
        numbers[first] = np.fromiter((self[(h,)] for h in heads if h), np.int64, len(first))
        word[first] = False
        for at, keys in zip(starts[odd].tolist(), others, strict=True):
            numbers[at:at + len(keys)] = [self[k] for k in keys]
            word[at:at + len(keys)] = False
        if end is not None:
            numbers[ends - 1] = self[("", "", end)]
            word[ends - 1] = False
        numbers[word] = number[coded.indices.to_numpy()]
        return numbers, counts

    def encode_all(self, texts: Sequence[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, as unsigned 32-bit integers, and how many each text has.

        With ``end`` that id follows each text.
        """
        if len(self) > self._known:
            self._forget()
        if end is not None and ("", "", end) not in self:
            self[("", "", end)] = len(self)
            self._add([[end]])
        numbers, counts = self._numbers(texts, end)
        self._learn()
        uses = np.bincount(numbers, minlength=self._done)
        self._uses[:self._done] += uses[:self._done]
        total = np.concatenate([[0], np.cumsum(self._lengths[numbers])])
        ends = np.cumsum(counts)
        return self._gather(numbers), total[ends] - total[ends - counts]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        ids, sizes = self.encode_all(texts)
        ends = np.cumsum(sizes)
        return [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.arange(total) + np.repeat(self._starts[numbers] - (ends - lengths), lengths)]


def _joined(found: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their lengths."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths
