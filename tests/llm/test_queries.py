"""The registered queries over the smallest given tables: against SQL, the public libraries or brute force."""

from __future__ import annotations

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from assayframe.llm import bpe, mixing, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def run(spark, name):
    return queries.queries()[name](spark, DATA).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    database = duckdb.connect()
    for table in os.listdir(DATA):
        database.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{table}')")
    want = database.execute(queries.oracle_sql()[name]).fetchdf()
    got = run(spark, name)[list(want.columns)]
    plain = [sorted(tuple(None if pd.isna(x) else x for x in row) for row in frame.itertuples(index=False, name=None)) for frame in (got, want)]
    assert len(plain[0]) == len(plain[1]) and all(a == b for a, b in zip(*plain))


def test_sql_of_license_notices(spark, tmp_path):
    """Wrapped and competing notices: the SQL and the operator are one definition."""
    from .test_operators import NOTICES

    # the SQL takes minutes on the very long one
    notices = [(t, labels) for t, labels in NOTICES if len(t or "") < 10_000]
    rows = pd.DataFrame({"doc_id": range(len(notices)), "text": [t for t, _ in notices]})
    rows.to_parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_license_scan(spark, str(tmp_path)).toPandas()
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = database.execute(queries.oracle_sql()["op5_license_scan"]).fetchdf()
    plain = [sorted(tuple(None if pd.isna(x) else x for x in row) for row in f[list(want.columns)].itertuples(index=False, name=None)) for f in (got, want)]
    assert plain[0] == plain[1] and dict(zip(want.doc_id, want.labels)) == {i: ",".join(v) for i, (_, v) in enumerate(notices)}


def test_tokens(spark, documents):
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANK_FILE))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op2_byte_bpe").set_index("doc_id")
    for doc_id, text in zip(documents.doc_id, documents.text):
        ids = encoding.encode_ordinary(text)
        row = got.loc[doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER_FILE))
    got, start = run(spark, "op8_token_files").set_index("doc_id"), 0
    for doc_id, text in sorted(zip(documents.doc_id, documents.text)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got.loc[doc_id]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(documents):
    """doc_id -> (fingerprint, smallest doc_id reachable), by all pairs."""
    prints = [fingerprint(t) for t in documents.text]
    ids, root = documents.doc_id.tolist(), dict(zip(documents.doc_id, documents.doc_id))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            least = min(root[ids[j]] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 4)
            if least < root[ids[i]]:
                root[ids[i]], changed = least, True
    return {d: (p, root[d]) for d, p in zip(ids, prints)}


def test_simhash(spark, documents):
    want = linked(documents)
    got = run(spark, "op6_simhash")
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got.itertuples()} == want and len(got) == len(want)


def test_neighbours(spark):
    table = pd.read_parquet(f"{DATA}/embeddings.parquet")
    vectors = np.vstack(table.embedding).astype(float)
    got = run(spark, "op10_neighbours")
    hits = 0
    for at in np.flatnonzero(table.vec_id % 20 == 0):
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        mine = got[got.query_id == table.vec_id[at]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        hits += len(set(table.vec_id[np.lexsort((table.vec_id, -scores))[:20]]) & set(mine.vec_id))
    assert hits >= 0.9 * len(got) and len(got) == 20 * (table.vec_id % 20 == 0).sum()


def test_classifiers_on_the_labels(spark):
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    toxic = run(spark, "op1_toxicity").merge(labels, on="doc_id")
    assert not toxic[(toxic.toxic_y == 0)].toxic_x.any()
    quality = run(spark, "op3_quality").merge(labels, on="doc_id")
    assert quality[quality.quality == 1].kept.mean() >= 0.9
    assert quality[quality.quality == 0].kept.mean() <= 0.5


def test_toxic_labels_are_found(spark):
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    toxic = run(spark, "op1_toxicity").merge(labels, on="doc_id")
    assert toxic[toxic.toxic_y == 1].toxic_x.mean() >= 0.6 and toxic.severity.nunique() > 1


def test_pipeline_stages(spark, documents):
    """Each stage against a plain version of it over what the stage before has kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = corpus_pipeline.perplexity.judge(docs, queries.trusted_ids(spark, DATA)).toPandas()
    (_, quality), (_, near), (_, passages), (_, mixture), (_, tokens) = corpus_pipeline.STAGES

    one = corpus_pipeline.stored(quality(spark, docs, DATA))
    assert one.columns == docs.columns and set(one.toPandas().doc_id) == set(judged[judged.kept].doc_id)

    two = corpus_pipeline.stored(near(spark, one, DATA))
    groups = linked(one.toPandas().sort_values("doc_id").reset_index(drop=True))
    assert two.columns == docs.columns and sorted(two.toPandas().doc_id) == sorted({root for _, root in groups.values()})

    three = corpus_pipeline.stored(passages(spark, two, DATA))
    words = {r.doc_id: r.text.encode().split() for r in two.toPandas().itertuples()}
    counts = collections.Counter(tuple(w[i:i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for doc_id, w in words.items():
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        if not w or len(gone) < len(w):
            want[doc_id] = [x for j, x in enumerate(w) if j not in gone]
    got = three.toPandas()
    assert {r.doc_id: r.text.encode().split() for r in got.itertuples()} == want and three.columns == docs.columns
    assert (got.n_chars == got.text.str.len()).all()

    four = corpus_pipeline.stored(mixture(spark, three, DATA))
    copies = {r.doc_id: r.copies for r in mixing.sample(three).select("doc_id", "copies").collect() if r.copies}
    assert four.columns == docs.columns and dict(collections.Counter(four.toPandas().doc_id)) == copies

    five = tokens(spark, four, DATA).toPandas()
    assert five.exact.all() and len(five) == four.count() and (five.ids.str.len() == 4 * five.n_tokens).all()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(root):
        if "llm" not in folder and ".git" not in folder:
            for name in files:
                if name.endswith(".py") and name not in ("corpus_pipeline.py", "__spark_entry__.py"):
                    with open(os.path.join(folder, name)) as text:
                        assert not re.search(r"^\s*(from|import) .*\bllm\b", text.read(), re.M), name


def test_queries_are_registered(spark):
    import __spark_entry__

    numbers = sorted(int(m[1]) for m in map(re.compile(r"op(\d+)_").match, __spark_entry__.queries()) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
