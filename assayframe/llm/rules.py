"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule names the features that it reads. ``cascade`` tests rules as one CASE expression: a document that a rule rejects is
not tested by the rules behind it. Features that the caller asks for, or that several rules read, are columns worked out
once for every document; any other feature stands inside the branch of the one rule that reads it, so documents
rejected before never pay for it.

The order is by rejections per unit of cost, both measured on a sample of bounded size. The cost of a rule is the time of
several passes over the raw texts of the sample, the features that are columns anyway given, less the time of passes
that only read. The order changes the cost and the name of the rule that rejects, never the verdict; as times
differ a little, rules of about the same worth may change places from run to run.

A null or blank text has no words; all its counts are 0. Repeated windows are found by 64-bit hashes
within one document. Rows are judged alone, so repeated rows get equal results and an empty table an empty
one. Columns of the input called like an output are replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, every_nth, shielded, stored, word_array

WINDOW = 8
# So many documents, about, are tried to estimate costs and rejections, and so often in one timing.
SAMPLE, PASSES = 2000, 4


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    n = F.size(words)
    return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more in their text."""
    def covered(ordered: Column) -> Column:
        # equal neighbours in the order of hashes are repeats
        same = lambda x, i: F.get(ordered, i)["h"].eqNullSafe(x["h"])
        twice = F.filter(ordered, lambda x, i: same(x, i + 1) | same(x, i - 1))
        return _given(F.array_sort(F.transform(twice, lambda x: x["i"])), lambda starts: F.aggregate(
            # least() skips nulls: the last window, which has no next one, counts in full
            F.zip_with(F.slice(starts, 2, F.size(starts)), starts, lambda b, a: F.least(F.lit(WINDOW), b - a)),
            F.lit(0), lambda total, gap: total + gap))

    # only documents with a repeated window are sorted
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes),
                  _given(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).otherwise(0)


def _times(pattern: str) -> Callable[[Column], Column]:
    return lambda whole: F.regexp_count(whole, F.lit(pattern))


# What features are counted from, what that is made of, and how. Lines are those with a word.
SOURCES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "whole": ("text", lambda text: F.coalesce(text, F.lit(""))),
    "words": ("text", word_array),
    "lines": ("whole", lambda whole: F.filter(F.split(whole, "\n"), lambda line: F.rlike(line, F.lit(WORD)))),
    "windows": ("words", _windows),
}
# The features that rules can read: what each is counted from, and how.
FEATURES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "n_words": ("words", F.size),
    "word_chars": ("words", lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w))),
    "n_repeat_words": ("windows", _repeat_words),
    "n_lines": ("lines", F.size),
    "n_dup_lines": ("lines", lambda lines: F.size(lines) - F.size(F.array_distinct(lines))),
    "n_symbols": ("whole", _times("[#*$%&|<>]")),
    "n_exclamations": ("whole", _times("!")),
    "n_letters": ("whole", _times(r"\p{L}")),
    "n_capitals": ("whole", _times(r"\p{Lu}")),
    "n_words_with_letter": ("whole", _times(r"\p{L}[^\x20\x09-\x0D]*")),
    "n_bullets": ("whole", _times(r"(?m)^[ \t]*[-*•]")),
    "n_cut_off": ("whole", _times(r"(?m)(…|\.\.\.)[ \t]*$")),
}
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the test from the features in ``needs``, in that order; it is true or false, never null."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


# Fewer than 20 words, or over 30 % of the words in windows that repeat.
BASE = Rule("base", ("n_words", "n_repeat_words"), lambda n, repeated: (n < 20) | (repeated * 100 > n * 30))


def default_rules() -> list[Rule]:
    """Rules for running text. Shares are of words or lines; a document without words has none."""
    return [
        Rule("symbols", ("n_symbols", "n_words"), lambda symbols, n: symbols * 10 > n * 2),
        Rule("word_length", ("word_chars", "n_words"), lambda chars, n: (chars > n * 16) | (chars < n * 2)),
        Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda again, lines: again * 10 > lines * 3),
        Rule("exclamations", ("n_exclamations", "n_words"), lambda marks, n: marks * 10 > n * 3),
        Rule("capitals", ("n_capitals", "n_letters"), lambda capitals, letters: capitals * 2 > letters),
        Rule("words_without_letters", ("n_words_with_letter", "n_words"), lambda lettered, n: lettered * 10 < n * 6),
        Rule("bullets", ("n_bullets", "n_lines"), lambda bullets, lines: bullets * 10 > lines * 9),
        Rule("cut_off_lines", ("n_cut_off", "n_lines"), lambda cut, lines: cut * 10 > lines * 3),
    ]


def features(docs: DataFrame, text: str = "text", names: Sequence[str] = OUTPUTS) -> DataFrame:
    """Add these features as columns."""
    out, have = docs, {"text": F.col(text)}

    def source(kind: str) -> Column:
        nonlocal out
        if kind not in have:
            of, make = SOURCES[kind]
            made = make(source(of))
            out = out.withColumn(f"the {kind} of {text}", made)
            have[kind] = F.col(f"`the {kind} of {text}`")
        return have[kind]

    counted = {name: FEATURES[name][1](source(FEATURES[name][0])).cast("long") for name in names}
    return (out.withColumns(counted) if counted else out).drop(*[f"the {kind} of {text}" for kind in have])


def _counted(kind: str, text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a source, without columns for what lies between."""
    of, make = SOURCES[kind]
    made = make(text) if of == "text" else _counted(of, text, make)
    return body(made) if kind == "whole" else _given(made, body)


def test_of(rule: Rule, have: Sequence[str], text: str = "text") -> Column:
    """The rule's test: features in ``have`` are columns, others are counted on the spot."""
    def feature(name: str) -> Column:
        if name in have:
            return F.col(name)
        kind, count = FEATURES[name]
        return _counted(kind, F.col(text), count).cast("long")

    return rule.rejects(*map(feature, rule.needs))


def measured(sample: DataFrame, rules: Sequence[Rule], have: Sequence[str] = OUTPUTS, text: str = "text") -> list[Rule]:
    """The rules in order of rejections per second over a sample of documents."""
    some = stored(features(sample.select(text), text, have), "sample")
    often = some.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))
    tests = {r.name: test_of(r, have, text) for r in rules}
    shares = some.agg(*[F.coalesce(F.avg(t.cast("double")), F.lit(0.0)).alias(name) for name, t in tests.items()]).first()

    def seconds(test: Column) -> float:
        taken = []
        for _ in range(2):
            begun = time.perf_counter()
            often.agg(F.count_if(test)).collect()
            taken.append(time.perf_counter() - begun)
        return min(taken)

    idle = seconds(F.octet_length(text) < 0)
    worth = {name: shares[name] / max(seconds(test) - idle, 1e-3) for name, test in tests.items()}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(docs: DataFrame, rules: Sequence[Rule], have: Sequence[str] = OUTPUTS, text: str = "text") -> DataFrame:
    """Add rejected_by: the first rule in this order that rejects the document, else null. Features in ``have`` are columns of
    ``docs``."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(test_of(rule, have, text), F.lit(rule.name)).otherwise(first)
    return docs.withColumn("rejected_by", first)


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", outputs: Sequence[str] = OUTPUTS, base: Rule = BASE) -> DataFrame:
    """Add the features in ``outputs``, base_failed (where they have all that ``base`` reads), rejected_by and kept.

    The base rule goes first where its features are outputs, as it is free then; else its place is measured too.
    """
    rules = default_rules() if rules is None else list(rules)
    docs, undo = shielded(docs, "doc_id", text)
    free = set(base.needs) <= set(outputs)
    dealt = rules if free else [base, *rules]
    uses = Counter(name for rule in dealt for name in rule.needs)
    have = [name for name in FEATURES if name in outputs or uses[name] > 1]
    ordered = measured(every_nth(docs, docs.count(), SAMPLE), dealt, have, text)
    out = cascade(features(docs, text, have), [base, *ordered] if free else ordered, have, text).withColumn("kept", F.col("rejected_by").isNull())
    if free:
        out = out.withColumn("base_failed", test_of(base, have, text))
    return undo(out, *outputs, *(["base_failed"] if free else []), "rejected_by", "kept")
