"""Language identification: held-out accuracy, odd rows, and the model against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from assayframe.llm import languages, queries

DATA = "/root/testdata/sf0.001"
TEXTS = [("en", "the house and the garden"), ("en", "that thing is there"), ("de", "das haus und der garten"), ("de", "nicht hier"),
         ("fr", "la maison et le jardin"), (None, "no label"), ("de", None), ("xx", "123 !!")]
ODD = [(1, None), (2, ""), (3, " 12 !?\n"), (4, "the"), (5, "GARTEN"), (5, "GARTEN"), (None, "le jardin"), (6, "a"), (7, "日本語"), (8, "the garden " * 60_000), (9, "\x00 😀"), (10, "ß")]


@pytest.fixture(scope="module")
def model(spark):
    return languages.train(spark.createDataFrame([(lang, text, "clash") for lang, text in TEXTS], "lang string, text string, n string")).cache()


def found(frame):
    return sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in frame.collect()), key=str)


def test_counts(model):
    rows = {r["lang"]: r for r in model.collect()}
    assert {k: r["texts"] for k, r in rows.items()} == {"en": 2, "de": 3, "fr": 1, "xx": 1}
    for lang, row in rows.items():
        counts = Counter(int(g) for known, text in TEXTS if known == lang for part in languages.grams(text or "") for g in part)
        total = sum(counts.values()) + languages.SMOOTH * languages.BUCKETS
        want = np.full(languages.BUCKETS, math.log(languages.SMOOTH / total))
        for bucket, n in counts.items():
            want[bucket] = math.log((n + languages.SMOOTH) / total)
        assert np.allclose(np.frombuffer(row["logs"], "<f4"), want, atol=1e-5)


def test_grams_of_long_texts_are_whole(monkeypatch):
    text = "Straße  und, weg " * 300
    whole = np.sort(np.concatenate(list(languages.grams(text))))
    monkeypatch.setattr(languages, "PIECE", 100)
    assert (np.sort(np.concatenate(list(languages.grams(text)))) == whole).all()


@pytest.mark.parametrize("block", [128, 1, 3])
def test_odd_texts(spark, model, block):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, lang_pred string, n int").repartition(3)
    got = found(languages.predict(docs, model, languages=block))
    assert len(got) == len(ODD) and all(0 <= score <= 1 for *_, score in got)
    of = dict((d, p) for d, p, _ in got)
    assert [of[n] for n in (1, 2, 3, 9)] == ["und"] * 4 and all(s == 0 for d, p, s in got if p == "und")
    assert (of[4], of[5], of[None], of[8]) == ("en", "de", "fr", "en") and len([1 for d, *_ in got if d == 5]) == 2
    assert got == found(languages.predict(docs, model))
    assert languages.predict(docs.where("false"), model, languages=block).count() == 0


def test_nothing_learned(spark):
    none = languages.train(spark.createDataFrame([], "lang string, text string"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    assert {p for _, p, _ in found(languages.predict(docs, none))} == {"und"}


def test_query_on_texts_held_out(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    got = queries.op11_language_id(spark, DATA).toPandas()
    assert len(got) == len(docs) and (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred.to_numpy() == docs.lang.loc[held.doc_id].to_numpy()).mean() >= 0.98
