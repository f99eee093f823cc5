"""Token alignment against both libraries and plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from assayframe.llm import alignment, queries

DATA = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(n) for n in (queries.TOKENIZER_FILE, queries.PIECE_FILE)]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b \n c\t "), (5, "\n"), (6, "one"), (7, "has ▁ in it"), (8, "x▁ b c"), (9, "é 😀 ﬁ ü\x00 \x1c 　 z"),
    (10, "<|endoftext|> <s> </s> <unk> <0x41>"), (11, "same words here"), (11, "same words here"), (None, "no id"), (12, "x" * 3000), (13, "the the the"),
    (14, "the the the cat"), (15, " trailing "), (16, "a  b  c"), (17, "word " * 5000), (18, "퟿ é \r\n  x"),
]


def plain(rows):
    """The contract word for word: offsets of all tokens, then counts over all texts."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    back = alignment.byte_characters()
    assert len(back) == len(set(back.values())) == 256
    found, count = [], Counter()
    for doc_id, text in rows:
        whole = " " + (text or "")
        tokens = [(e, bytes(back[c] for c in t)) for e, t in zip(*(lambda x: (x.ids, x.tokens))(a.encode(whole, add_special_tokens=False)))]
        pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        if not text or any(b"".join(x for _, x in side) != whole.encode() for side in (tokens, pieces)):
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = []
        for side in (tokens, pieces):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        # no token is empty, so of each tokenizer one token ends at an offset
        first, second = dict(ends[0]), dict(ends[1])
        links = [(first[e], second[e]) for e in both]
        cut, at = [], [0, 0]
        for high in both:
            group = []
            for n, side in enumerate(ends):
                start = at[n]
                while at[n] < len(side) and side[at[n]][0] <= high:
                    at[n] += 1
                group.append([str(i) for _, i in side[start:at[n]]])
            cut.append(group)
        groups = ";".join("|".join(",".join(side) for side in group) for group in cut)
        count.update(links)
        found.append((doc_id, len(tokens), len(pieces), len(both), links, hashlib.sha256(groups.encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((d, n_a, n_b, n_groups, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha)
                   for d, n_a, n_b, n_groups, links, sha in found), key=str)


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, run string, n_a int").repartition(3)
    assert rows_of(alignment.align(docs, *PATHS)) == plain(ODD)
    assert alignment.align(docs.where("false"), *PATHS).count() == 0


def test_query(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    assert rows_of(queries.op12_alignment(spark, DATA)) == plain(list(zip(docs.doc_id.tolist(), docs.text.tolist())))


@pytest.mark.parametrize("fan_in", [2, 3])
def test_many_runs_and_merges(spark, fan_in, monkeypatch):
    """Runs of few texts, merged over several levels, give the same."""
    docs = pd.read_parquet(f"{DATA}/documents.parquet").head(40)
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(alignment.align(frame, *PATHS, run_bytes_per_radix=20_000, fan_in=fan_in)) == plain(rows)
