"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, over line ends too, as long as a text of which the template is a share of
``THRESHOLD`` (a template of 8 words: 10). It begins at a word of the template. It matches if it holds at least that
share of the template's different words, among them every word that tells the template from its kin (``needed``: a
version, `mit`, `sa`), and none that speaks for another one (``barred``: `nc` in a text of CC BY-SA). So of notices that
differ in one word only the right one is found, and words that merely stand somewhere in a text are no match. The join
is exact and never compares a block with a template it cannot match:

- words are ordered by how many documents hold them, rarest first;
- length filter: texts with fewer words of every template than it asks for are left out before they are looked at by place;
- prefix filter: a template of n words that must share k has its first n - k + 1 words as prefix, and the rarest shared
  word of a matching block is one of them; places of these words meet templates in an equi-join on the word;
- positional filter: around such a place, at most a block's length away, must stand k - 1 different words that come after
  it in the template's order;
- what remains is verified block by block.

A text is cut into words once; what the joins carry is one short stretch of words for each place of a prefix word, so a
very long text costs what its words cost. Templates are the caller's list, at most ``MAX_TEMPLATES``, so what is
broadcast does not grow with the documents.
Null and blank texts have no words and no labels. Rows are told apart by doc_id and a hash of the text;
rows equal in both get equal results. An empty table gives an empty one. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

THRESHOLD = 0.8
MAX_TEMPLATES = 1000

# What is no part of a word (after A-Z became a-z), phrases and the label of each.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice, its label, words that a block must hold, and words that it must not hold."""

    label: str
    text: str
    needed: str = ""
    barred: str = ""

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(_all_words(self.text)))

    def least(self, threshold: float) -> int:
        """Different words that a block must share."""
        return math.ceil(threshold * len(self.words) - 1e-9)

    def run(self, threshold: float) -> int:
        """Words of a block."""
        return math.ceil(len(_all_words(self.text)) / threshold - 1e-9)


# Notices that license authors ask to be copied, by SPDX-like label.
TEMPLATES = (
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu 3", "lesser affero library"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu 2", "lesser affero library"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation", "gnu", "lesser affero library"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files", "permission granted"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met", "redistribution binary"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4", "sa nd"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4", "nc nd"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative attribution 4",
             "noncommercial sharealike noderivatives noderivs nc sa nd"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text as written. Null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _phrase_places(phrases: Mapping[str, str]) -> Column:
    """(start, label) of every place where a phrase's words stand in a row in ``_lower``; null has none."""
    at = F.sequence(F.lit(0), F.size("_lower") - 1)
    kind = "array<struct<start:int,label:string>>"
    each = [_starts(at, phrase.split(), label) for phrase, label in phrases.items()]
    return F.when(F.size("_lower") > 0, F.flatten(F.array(*each)).cast(kind)).otherwise(F.array().cast(kind))


def _starts(at: Column, phrase: Sequence[str], label: str) -> Column:
    """(start, label) of every place in ``at`` where the words of ``_lower`` are those of the phrase."""
    def stands(start: Column) -> Column:
        every = F.get("_lower", start).eqNullSafe(F.lit(phrase[0]))
        for i, word in enumerate(phrase[1:], 1):
            every = every & F.get("_lower", start + i).eqNullSafe(F.lit(word))
        return every

    return F.transform(F.filter(at, stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _all_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _list(words_: Sequence[str]) -> Column:
    return F.lit(list(words_)) if words_ else F.array().cast("array<string>")


def _read(docs: DataFrame, templates: Sequence[Template], threshold: float, phrases: Mapping[str, str], text: str) -> DataFrame:
    """The documents, cut into words once: doc_id, key, n_words, places of phrases, the words of templates that a text
    holds, and all its words if these are enough for a template. Stored."""
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates, not 1 to {MAX_TEMPLATES}")
    vocabulary = sorted({w for t in templates for w in t.words})
    whole = F.coalesce(F.col(text), F.lit(""))
    found = "(?i)" + "|".join((GAP + "+").join(p.split()) for p in phrases)
    # letters beyond A-Z may become ASCII ones here, never the other way, so this only lets some texts pass in vain
    cut = docs.select("doc_id", text_key(text).alias("key"), whole.alias("_text"), words(F.lower(whole)).alias("_words"))
    cut = cut.select("doc_id", "key", "_text", F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", _list(vocabulary)).alias("held"))
    enough = F.lit(False)
    for t in templates:
        met = (F.size(F.array_intersect("held", _list(t.words))) >= t.least(threshold)) & (F.size(F.array_except(_list(t.needed.split()), F.col("held"))) == 0)
        enough = enough | met
    phrased = F.rlike("_text", F.lit(found)) if phrases else F.lit(False)
    cut = cut.select("doc_id", "key", "n_words", "held", "_text", enough.alias("_enough"), phrased.alias("_phrased"))
    cut = cut.withColumn("_lower", F.when(F.col("_enough") | F.col("_phrased"), words(lower_ascii(F.col("_text")))))
    places = _phrase_places(phrases) if phrases else F.array().cast("array<struct<start:int,label:string>>")
    return stored(cut.select("doc_id", "key", "n_words", "held", places.alias("places"), F.when(F.col("_enough"), F.col("_lower")).alias("words")), "licenses")


def _word_order(read: DataFrame, templates: Sequence[Template]) -> list[str]:
    """The words of all templates, those that the fewest documents hold first. One row per word comes back."""
    counts = {r["word"]: r["count"] for r in read.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    return sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))


_PREFIX = "word string, template int, label string, wanted array<string>, after array<string>, least int, run int, needed array<string>, barred array<string>"


def _matches(read: DataFrame, templates: Sequence[Template], threshold: float) -> DataFrame:
    rank = {w: n for n, w in enumerate(_word_order(read, templates))}
    prefixes = []
    for number, t in enumerate(templates):
        ws, least = sorted(t.words, key=rank.get), t.least(threshold)
        for place, word in enumerate(ws[:len(ws) - least + 1]):
            prefixes.append((word, number, t.label, ws, ws[place + 1:], least, t.run(threshold), t.needed.split(), t.barred.split()))
    table = F.broadcast(read.sparkSession.createDataFrame(prefixes, _PREFIX))
    first, longest = _list(sorted({p[0] for p in prefixes})), max(p[6] for p in prefixes)

    # a place of a prefix word with the words around it: at most two blocks of the longest template
    def stretch(i: Column) -> Column:
        start = F.greatest(F.lit(0), i - (longest - 1))
        return F.struct(i.alias("at"), F.get("words", i).alias("word"), start.alias("start"), F.slice("words", start + 1, i - start + longest).alias("near"))

    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(first, F.get("words", i)))
    each = read.where(F.size("words") > 0).select("doc_id", "key", F.explode(F.transform(at, stretch)).alias("_place")).select("doc_id", "key", "_place.*")
    met = each.join(table, "word")
    low = F.greatest(F.lit(0), F.col("at") - F.col("run") + 1)
    met = met.withColumn("_low", low).withColumn("near", F.slice("near", low - F.col("start") + 1, F.col("at") - low + F.col("run")))
    met = met.where(F.size(F.array_intersect("near", "after")) >= F.col("least") - 1)

    def block(i: Column) -> Column:
        inside = F.slice("near", i + 1, F.col("run"))
        right = (F.size(F.array_except(F.col("needed"), inside)) == 0) & ~F.arrays_overlap(inside, "barred")
        return F.struct((F.col("_low") + i).alias("start"), F.when(right, F.size(F.array_intersect(inside, "wanted"))).otherwise(0).alias("shared"))

    begins = F.filter(F.sequence(F.lit(0), F.col("at") - F.col("_low")), lambda i: F.array_contains("wanted", F.get("near", i)))
    blocks = F.filter(F.transform(begins, block), lambda b: b["shared"] >= F.col("least"))
    found = met.select("doc_id", "key", "template", "label", F.size("wanted").alias("_n"), F.explode(blocks).alias("_block"))
    found = found.select("doc_id", "key", "template", "label", F.col("_block.start").alias("start"), (F.col("_block.shared") / F.col("_n")).alias("score"))
    # a block with several prefix words was met at each of them
    return found.groupBy("doc_id", "key", "template", "label", "start").agg(F.max("score").alias("score"))


def template_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Every block and template that meet: doc_id, key (hash of the text), template, label, start (its first word, from 0), score."""
    return _matches(_read(docs, templates, threshold, {}, text), templates, threshold)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, places (phrases), labels (both ways, distinct, sorted), score (best containment)."""
    read = _read(docs, templates, threshold, PHRASES, text)
    found = _matches(read, templates, threshold).groupBy("doc_id", "key").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_labels", "_score")
    joined = read.drop("words", "held").join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_union(F.transform("places", lambda p: p["label"]), F.coalesce("_labels", none))
    return joined.select("doc_id", "n_words", "places", F.array_sort(labels).alias("labels"), F.coalesce("_score", F.lit(0.0)).alias("score"))
