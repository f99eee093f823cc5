"""The prefix trie against a plain one, on odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assayframe.llm import tries
from assayframe.llm.common import WORD

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, conv string, at string, seq string"
EVERY, MOST = 20, 3


def plain(rows):
    def symbol(role, text):
        whole = (role or "").encode()
        return hashlib.sha256(str(len(whole)).encode() + b":" + whole + (text or "").encode()).digest(), len((text or "").split())

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, *symbol(role, text)))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (MOST + 1)
        base = c - (c % EVERY if c >= 0 else -(-c % EVERY))
        convs[c] = own.get(base, [])[:h] + v[h:]
    members = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    out = []
    for node, of in members.items():
        children = [x for x in below[node] if len(x) == len(node) + 1]
        leaves = [x for x in below[node] if len(below[x]) == 1]
        saved = sum((len(members[x]) - 1) * x[-1][1] for x in below[node] if x)
        ends = ",".join(str(c) for c in sorted(c for c in of if len(convs[c]) == len(node)))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "c", "a", "s") for r in rows], SCHEMA).repartition(parts)
    head = F.crc32(F.col("conv").cast("string")) % (MOST + 1)
    found = tries.nodes(*tries.rebuilt(frame, EVERY, head, MOST))
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)


def odd():
    rows = [(None, 1, "user", "lost"), (0, None, "user", "null turn"), (0, 0, None, None), (0, 0, "", ""), (0, 0, "user", "tie"), (0, 0, "user", "tie"),
            (-3, 0, "a", "b"), (-25, 5, "user", "x y  z"), (7, 1, "us", "er1"), (7, 2, "use", "r1"), (1 << 40, 1, "user", "far")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"hello {t}") for c in range(20, 60) for t in range(c % 7)]
    rows += [(c, 0, "user", "the same") for c in range(100, 130)]  # all short: with a head of their own gone, some have no turn
    rng = random.Random(5)
    rows += [(c, t, "user", f"{rng.randrange(2)} w") for c in range(200, 230) for t in range(rng.randrange(1, 20))]
    return rows


def test_odd_conversations(spark):
    rows = odd()
    got = built(spark, rows)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)  # some have no turn


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(21, 0, "a", "b")], [(40, 0, "a", "b c")]], ids=["empty", "no id", "turnless", "one turn"])
def test_small_tables(spark, rows):
    assert built(spark, rows, 1) == plain(rows)


def test_long_and_hot_conversations(spark, monkeypatch):
    """One conversation holds most rows; one first turn is shared by most; lists of members come in many chunks."""
    monkeypatch.setattr(tries, "CHUNK_BYTES", 24 * 3)
    rows = [(20, t, "user", f"step {t % 5}") for t in range(700)] + [(c, 0, "user", "hi") for c in range(1000, 1300)]
    rows += [(c, 1, "user", f"own {c % 11}") for c in range(1000, 1300)]
    assert built(spark, rows) == plain(rows)


def test_words_are_those_of_the_library():
    assert WORD == r"[^\x20\x09-\x0D]+"
