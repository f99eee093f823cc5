"""What workers keep from task to task."""

from __future__ import annotations

import gc
import weakref

import numpy as np
import pyarrow as pa

import corpus_pipeline
from assayframe.llm import bpe, common, pieces, substrings


def test_what_a_worker_kept_is_gone_at_once_even_if_it_refers_to_itself():
    class Large:
        pass

    def make():
        large = Large()
        large.itself = large
        return large

    gc.disable()
    try:
        there = weakref.ref(common.kept("large", make))
        assert there() is not None
        common.let_go()
        assert there() is None
    finally:
        gc.enable()


def test_stages_of_the_pipeline_send_small_batches_to_workers(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    def stage(spark, docs, sf_dir):
        return docs.mapInArrow(sizes, "size long")

    docs = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id as string), 500) AS text")
    try:
        sent = [r["size"] for r in corpus_pipeline._sparing(stage)(spark, docs, "").collect()]
    finally:
        spark.conf.unset(corpus_pipeline.SENT)
    assert len(sent) > 1 and max(sent) < 2 * corpus_pipeline.SENT_BYTES
    assert {f.__qualname__ for _, f in corpus_pipeline.STAGES} == {"_sparing.<locals>.run"}


def test_what_packing_held_is_gone_before_the_worker_lets_go(monkeypatch):
    made, alive = [], []

    class Words(substrings.Words):
        def __init__(self, buffer):
            super().__init__(buffer)
            made.append(weakref.ref(self))

    monkeypatch.setattr(substrings, "Words", Words)
    monkeypatch.setattr(substrings, "let_go", lambda: alive.append(sum(w() is not None for w in made)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e f " * 50, "g h i " * 50], "key": [1, 2]})
    assert list(substrings._pack(np.zeros(0, np.uint64), 16, 35)(iter([batch])))
    assert made and alive == [0, 0]


def test_the_last_stage_of_the_pipeline_keeps_fewer_pieces(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(corpus_pipeline.bpe, "round_trip", lambda docs, *a, **k: asked.update(k) or docs.selectExpr("*", "0L AS n_tokens", "text AS ids", "text AS decoded"))
    docs = spark.createDataFrame([(1, "en", "a", "b")], "doc_id long, lang string, source string, text string")
    corpus_pipeline.tokens(spark, docs, "")
    codec = bpe._Codec({bytes([b]): b for b in range(256)}, r"\S+|\s+", asked["known"])
    assert codec.pieces._known == asked["known"] < pieces.KNOWN_PIECES
    assert asked["batch_tokens"] < bpe.BATCH_TOKENS and asked["batch_bytes"] < bpe.BATCH_BYTES
    # fewer at a time give the same
    parts = codec.encode(["ab " * 9, "", "c"])
    assert list(bpe._in_turn(codec, parts, 5)) == list(bpe._in_turn(codec, parts, 100)) == [b"ab " * 9, b"", b"c"]
