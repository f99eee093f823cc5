"""Words that the tokenizer gets as few texts."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assayframe.llm import bpe, tokenfiles
from assayframe.llm.pieces import PieceIds
from assayframe.llm.queries import END_ID
from tests.llm.test_operators import reference_encoding


def test_words_new_to_a_worker_are_given_to_the_library_as_few_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    given = []

    def encode(texts):
        given.extend(texts)
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    words = [f"w{n}x\n\u00a0\u3000{n * n}é." for n in range(1200)] + ["\u0120", "\u0085a", "\x1cb", "c\t"]
    ids, lengths = tokenfiles._run_encoder(tokenizer, encode)(words)
    want = encode([" " + w for w in words])
    assert ids.tolist() == [i for each in want for i in each] and lengths.tolist() == [len(each) for each in want]

    given.clear()
    run = tokenfiles._run_encoder(tokenizer, encode)
    ids, lengths = run([f"word{n}" for n in range(1200)])
    assert len(given) == 3 and len(lengths) == 1200 and lengths.sum() == len(ids)
    # a word with a space in it cannot be told apart: such words are encoded one by one
    assert run(["a b", "c"])[1].tolist() == [2, 1]
    assert [len(x) for x in run([])] == [0, 0]

    texts = ["", " ", "a  b", "new words\nhere andagain", "new words\nhere andagain ", "x<|endoftext|> y z", "\u00a0 q", "new  "]
    pieces = tokenfiles._encoder(path)[0]
    ids, lengths = pieces.encode_all(texts, END_ID)
    want = [[*each, END_ID] for each in encode(texts)]
    assert ids.tolist() == [i for each in want for i in each] and lengths.tolist() == [len(each) for each in want]


def test_byte_bpe_gives_new_words_to_the_database_as_one_run(monkeypatch):
    """Each piece was cut and put together by itself, which took more time than the queries."""
    codec = bpe._Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    given = []
    one_by_one = codec._encode_pieces
    monkeypatch.setattr(codec.pieces, "_encode", lambda pieces: given.extend(pieces) or one_by_one(pieces))
    texts = [" the xqzzv blorptang, the\nxqzzv\tend", " x" * 300, " " + "abé" * 200, " don't xqzzv\r\n blorptang 日本語ก"]
    want = reference_encoding()
    found = codec.encode(texts)
    assert not given
    assert [i.tolist() for i in found] == [want.encode_ordinary(t) for t in texts]
    assert codec.decode(found) == [t.encode() for t in texts]
    odd = ["", " ", "two  spaces", "end ", "\n a", "a  b", "\t \n x y"]
    assert [i.tolist() for i in codec.encode(odd)] == [want.encode_ordinary(t) for t in odd]
    assert codec.decode([np.zeros(0, np.uint32), found[0], np.zeros(0, np.uint32)]) == [b"", texts[0].encode(), b""]


def test_byte_bpe_with_a_pattern_that_joins_words_cuts_pieces_one_by_one():
    codec = bpe._Codec({bytes([b]): b for b in range(256)} | {b" a": 256}, r"[ab ]+|[^ab ]+")
    ids, lengths = codec._encode_run(["a", "ab", "c"])
    assert ids.tolist() == [256, 256, 98, 32, 99]
    assert lengths.tolist() == [1, 2, 2]


def test_only_the_different_words_of_a_batch_become_python_strings():
    """Every word of every text was one, and was looked up by itself."""
    pieces = PieceIds(lambda words: [[len(w)] for w in words], whole=["<|end|>"])
    texts = ["one two three " * 100_000 + "four", "", " five", "six", "a  b c", "x<|end|> y", "\u3000 z", " \x85 "]
    pieces.encode_all(["warm up"])  # loads modules
    tracemalloc.start()
    ids, lengths = pieces.encode_all(texts, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths.tolist() == [300_002, 1, 2, 2, 5, 2, 3, 2]
    assert ids[:5].tolist() == [3, 4, 6, 4, 4] and ids[300_000:].tolist() == [5, 0, 0, 5, 0, 3, 0, 1, 1, 2, 2, 0, 10, 0, 1, 2, 0, 3, 0]
    assert peak < 25_000_000
    # known and new words, heads and odd texts in one batch, in any order
    again, sizes = pieces.encode_all([texts[n] for n in (5, 2, 0, 4)] + ["two new"], 0)
    assert sizes.tolist() == [2, 2, 300_002, 5, 3] and again[-3:].tolist() == [3, 4, 0]
