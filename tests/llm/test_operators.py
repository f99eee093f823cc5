"""Each operator of ``assayframe.llm`` on odd rows, and against a plain version in Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from assayframe.llm import bpe, licenses, mixing, neighbours, perplexity, rules, simhash, substrings, tokenfiles, toxicity
from assayframe.llm.common import spread_join
from assayframe.llm.components import components
from assayframe.llm.queries import END_ID, RANK_FILE, TOKENIZER_FILE

PASSAGE = " ".join(f"w{i}" for i in range(60))
# The columns after n_chars clash with outputs or helpers.
CLASHES = ["ids", "size", "key", "kept", "places", "rank", "n", "_in", "_source", "_before", "_ranges", "_doc", "_key", "_places", "_n", "_lang"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = " ".join(f"long{i % 977}" for i in range(9000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "en", "a"), (4, "one", "en", "a"),
    (5, "Ein   Wort\n\nnoch  eins   　 ß 12 345!!", "de", None), (6, PASSAGE + " end", "en", "b"),
    (7, "begin " + PASSAGE, "en", "b"), (7, "begin " + PASSAGE, "en", "b"), (8, "it " * 200, "en", "b"),
    (9, LONG, "en", "c"), (10, LONG + " more", "en", "c"), (None, "no id here", "fr", "c"), (None, "no id here", "fr", "c"),
    (None, None, None, None), (11, "x" * 5000, "en", "c"), (12, "<|endoftext|> it's é\x00ñ 😀 don't", "es", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, *(c[:1] for c in CLASHES)) for r in ODD], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def texts():
    return [r[1] or "" for r in ODD]


def by_id(rows, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in rows), key=str)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def reference_encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(RANK_FILE))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(odd, empty):
    path = public_tokenizers.path(RANK_FILE)
    out = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    want = reference_encoding()
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.encode_ordinary(text)
        assert r["n_tokens"] == len(want.encode_ordinary(text)) and bytes(r["decoded"]) == text.encode() and r["key"] == "k"
    assert bpe.decode(bpe.encode(empty, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).count() == 0


def test_one_pass_gives_what_two_give(odd):
    path = public_tokenizers.path(RANK_FILE)
    one = bpe.round_trip(odd, path, public_tokenizers.PATTERN)
    two = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert one.columns == two.columns and sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_bpe_on_random_space_and_long_words():
    codec, want = bpe._codec(public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN), reference_encoding()
    chance = random.Random(5)
    some = ["".join(chance.choice(" \n\tab1é, 'st. ") for _ in range(chance.randint(0, 40))) for _ in range(2000)]
    some += ["".join(chance.choice("abcdefgh") for _ in range(300)) for _ in range(20)]
    assert [i.tolist() for i in codec.encode(some)] == [want.encode_ordinary(t) for t in some]


def test_bpe_refuses_unknown_ids():
    codec = bpe._codec(public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    with pytest.raises(ValueError, match="vocabulary"):
        codec.decode([np.array([60000], np.uint32)])


def test_token_files(odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER_FILE)
    tokenizer = Tokenizer.from_file(path)
    rows = tokenfiles.read(tokenfiles.write(odd, path, END_ID)).orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ODD), key=lambda i: -1 if i is None else i)
    want = collections.Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (END_ID,)) for r in ODD)
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    assert tokenfiles.read(tokenfiles.write(empty, path, END_ID)).count() == 0


def test_mixing(spark, odd, empty):
    rows = mixing.sample(odd).collect()
    assert by_id(rows, "size") == sorted(((r[0], len(words(r[1]))) for r in ODD), key=str)
    assert by_id(mixing.sample(odd.repartition(7)).collect(), "source_size", "target", "copies") == by_id(rows, "source_size", "target", "copies")
    assert all(0 <= r["copies"] <= 3 for r in rows) and mixing.sample(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd.drop("size")).count() == sum(r["copies"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(total)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 100).cast("int")).alias("text"),
                                      F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.sample(many).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] + 100 for r in got)


def test_mixing_targets_refill_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, None: 0, "e": 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(k, 1, v) for k, v in sizes.items()], "source string, n long, source_size long")).collect()}
    order = sorted((k for k in sizes if k), key=str.encode) + [None]
    weight, left, open_, want = dict(zip(order, [5, 2, 1] * 2)), sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        above = {k for k in open_ if level * weight[k] > 3 * sizes[k]}
        want |= {k: 3 * sizes[k] for k in above} if above else {k: level * weight[k] for k in open_}
        left -= sum(3 * sizes[k] for k in above)
        open_ = open_ - above if above else set()
    assert got == pytest.approx(want)


def test_rules(odd, empty):
    out = {(r["doc_id"], r["text"]): r for r in rules.judge(odd).collect()}
    assert rules.judge(empty).count() == 0
    for _, text, *_ in ODD:
        ws = words(text)
        windows = collections.Counter(tuple(ws[i:i + 8]) for i in range(len(ws) - 7))
        covered = {j for i in range(len(ws) - 7) if windows[tuple(ws[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = next(v for k, v in out.items() if k[1] == text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws)) and (r["kept"] == (r["rejected_by"] is None))


def test_cascade_order_never_changes_the_verdict(odd):
    counted = rules.features(odd)
    one, two = (by_id(rules.cascade(counted, r).select("doc_id", F.col("rejected_by").isNull().alias("ok")).collect(), "ok")
                for r in (rules.default_rules(), rules.default_rules()[::-1]))
    assert one == two


def test_features_of_one_rule_are_counted_in_its_branch(odd):
    """A verdict alone is the same as with all counts; rules behind one that rejects do not run."""
    full = by_id(rules.judge(odd).select("doc_id", "kept").collect(), "kept")
    alone = rules.judge(odd, outputs=())
    assert by_id(alone.select("doc_id", "kept").collect(), "kept") == full
    assert not {"base_failed", "n_repeat_words"} & (set(alone.columns) - set(odd.columns))
    broken = rules.Rule("broken", ("n_letters",), lambda n: F.raise_error(F.lit("tested")).cast("boolean") | (n < 0))
    every = rules.Rule("every", ("n_exclamations",), lambda n: n >= 0)
    counted = rules.features(odd, names=())
    assert {r[0] for r in rules.cascade(counted, [every, broken], have=()).select("rejected_by").collect()} == {"every"}
    with pytest.raises(Exception, match="tested"):
        rules.cascade(counted, [broken, every], have=()).select("rejected_by").collect()


def test_rules_are_ordered_by_rejections_for_their_cost(spark):
    """Of rules that reject alike the cheap one goes first, of rules that cost alike the one that rejects more."""
    docs = spark.createDataFrame([(i, ("Word, another one; " * 400) + "!" * (i % 10)) for i in range(400)], "doc_id long, text string")
    dear = rules.Rule("a_dear", ("n_words_with_letter", "n_letters", "n_capitals"), lambda a, b, c: (a + b + c < 0) | (a > 0))
    cheap = rules.Rule("z_cheap", ("n_words",), lambda n: n > 0)
    never = rules.Rule("a_never", ("n_words",), lambda n: n < 0)
    assert [r.name for r in rules.measured(docs, [never, dear, cheap], have=["n_words"])] == ["z_cheap", "a_dear", "a_never"]


GPL = ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
       " * the Free Software Foundation, either version 3 of the License */\nint main()")
PERMISSION = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and\nassociated documentation files (the Software)"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
FAR = "released early\n" + "some other words stand here\n" * 9 + "under the bridge\n" + "and more of them\n" * 9 + "mit is a school"
CREATIVE = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
# texts and the labels that they should get
NOTICES = [
    ("Released under the MIT License.", ["mit"]), (None, []), ("", []), ("CC BY, cc-by; Apache   LICENSE the gnu general\npublic license", ["apache", "cc-by", "gpl"]),
    ("licensed under\nApache", []), ("aapache license mit licenses", []), (GPL, ["gpl"]), (PERMISSION, ["mit"]), (BSD, ["bsd"]), (FAR, []),
    ("x\nReleased under\nthe MIT\nLicense\ny", ["mit"]), ("Released under the BSD License", []), ("Licensed under CC BY-NC 4.0", ["cc-by", "cc-by-nc-4.0"]),
    ("Licensed under\nCC BY-SA 4.0.", ["cc-by", "cc-by-sa-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["cc-by"]),
    ("This work is licensed under the GNU General Public License, version 3", ["gpl", "gpl-3.0"]),
    ("This work is licensed under the GNU General Public\nLicense, version 2 " + "and so on " * 40, ["gpl", "gpl-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3", []), (CREATIVE.format(""), ["cc-by-4.0"]),
    (CREATIVE.format("-NonCommercial"), []), ("released " + "x " * 30 + "under the license " + "y " * 30 + "mit", []),
    ("word " * 30000 + "Released under the MIT License " + "the license under " * 10000, ["mit"]), ("\u212aey \u0130 mit\u00df MIT LICENSE", ["mit"]),
]


def plain_scan(text):
    """n_words, places, labels and score of a text, block by block."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, v) for p, v in licenses.PHRASES.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split())
    labels, best = {v for _, v in places}, 0.0
    for t in licenses.TEMPLATES:
        wanted, run = set(t.words), t.run(licenses.THRESHOLD)
        for i in (i for i, w in enumerate(ws) if w in wanted):
            block = set(ws[i:i + run])
            share = len(wanted & block) / len(wanted)
            if share >= licenses.THRESHOLD and block >= set(t.needed.split()) and not block & set(t.barred.split()):
                labels.add(t.label)
                best = max(best, share)
    return len(ws), places, sorted(labels), best


def test_license_scan_against_every_block(spark):
    chance = random.Random(8)
    pool = sorted({w for t in licenses.TEMPLATES for w in t.words + t.barred.split()})
    mixed = []
    for t in [t for t in licenses.TEMPLATES for _ in range(12)]:
        ws = t.text.split()
        for _ in range(chance.randrange(4)):
            ws[chance.randrange(len(ws))] = chance.choice([*pool, "other", ""])
        mixed.append(" ".join(chance.choices(pool, k=chance.randrange(40))) + chance.choice(" \n") + chance.choice([" ", "\n"]).join(ws) + " " + " ".join(chance.choices(pool, k=9)))
    data = list(enumerate([t for t, _ in NOTICES] + mixed)) + [(0, NOTICES[0][0]), (0, NOTICES[0][0]), (None, "mit license"), (None, None)]
    out = licenses.scan(spark.createDataFrame(data, "doc_id long, text string").withColumn("words", F.lit(1))).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), r["labels"], round(r["score"], 9)) for r in out)
    assert got == sorted((str(i), n, places, labels, round(best, 9)) for i, t in data for n, places, labels, best in [plain_scan(t)])
    found = {r["doc_id"]: r["labels"] for r in out}
    assert [found[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]
    assert sum(1 for _, _, _, _, score in got if score >= 0.8) > 50
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_blocks_begin_where_they_match(spark):
    docs = spark.createDataFrame(list(enumerate([GPL, FAR, "x\nReleased under\nthe MIT\nLicense\ny"])), "doc_id long, text string")
    first = {(r["doc_id"], r["label"]): r["start"] for r in licenses.template_matches(docs).groupBy("doc_id", "label").agg(F.min("start").alias("start")).collect()}
    assert first == {(0, "gpl"): 0, (2, "mit"): 1}
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(docs, licenses.TEMPLATES * 101)


def test_simhash_against_all_pairs(odd, empty, spark):
    chance = random.Random(2)
    near = [" ".join(f"n{i}" for i in range(120)).replace(f"n{chance.randrange(120)} ", "other ", 1) for _ in range(40)]
    rows = [(i, t) for i, t, *_ in ODD] + [(100 + i, t) for i, t in enumerate(near)]
    out = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()

    def fingerprint(text):
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    want = [(doc_id, prints[i], min((x for x in ids[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]
    assert sorted(((r["doc_id"], r["simhash"] % (1 << 64), r["component_id"]) for r in out), key=str) == sorted(want, key=str)
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({find(i) for i in range(len(ODD))}) and simhash.deduplicated(empty).count() == 0
    assert simhash.groups(empty).count() == 0


def test_search_within_a_list_joins_what_all_pairs_join():
    chance = np.random.default_rng(1)
    base = chance.integers(0, 1 << 63, 6, dtype=np.uint64)
    members = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << chance.integers(0, 64, (50, 3)).astype(np.uint64), axis=1) for b in base]))
    a, b = simhash._search(members)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(members)

    def parts(links):
        name = {int(m): int(m) for m in members}
        for x, y in links:
            old, new = name[int(x)], name[int(y)]
            name = {k: new if v == old else v for k, v in name.items()}
        return len(set(name.values()))

    every = [(x, y) for i, x in enumerate(members) for y in members[:i] if int(x ^ y).bit_count() <= 4]
    assert parts(zip(a, b)) == parts(every)


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(20)] + [(500, 501 + i) for i in range(50)] + [(7, 7), (900, 901), (901, 900), (905, 903), (905, 901), (None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 500 for i in range(500, 551)} | {i: 900 for i in (900, 901, 903, 905)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, window=substrings.WINDOW):
    counts = collections.Counter(tuple(words(t)[i:i + window]) for _, t in rows for i in range(len(words(t)) - window + 1))
    out = []
    for doc_id, text in rows:
        ws = words(text)
        gone = {j for i in range(len(ws) - window + 1) if counts[tuple(ws[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=str)


def test_substrings_against_all_windows(odd, empty, monkeypatch):
    want = removed([(i, t) for i, t, *_ in ODD])
    assert by_id(substrings.without_repeats(odd).collect(), "n_words", "n_removed", "text") == want
    assert substrings.without_repeats(empty).count() == 0
    laid = substrings.without_repeats(odd, keep_layout=True)
    assert [(i, n, g, " ".join(words(t))) for i, n, g, t in by_id(laid.collect(), "n_words", "n_removed", "text")] == want


def test_long_documents_in_parts_and_frequent_runs_change_nothing():
    chance = random.Random(3)
    rows = [(i, " ".join(chance.choice("abcd") + chance.choice("ab") for _ in range(chance.randint(30, 400))) + " " + PASSAGE * (i % 3)) for i in range(30)]
    for limit, frequent in ((1 << 22, 0), (300, 5), (4000, 200)):
        known = [substrings._runs(substrings.Words(" ".join(words(t)).encode())) for _, t in rows]
        often = np.sort(np.concatenate(known)[:frequent])
        found = collections.Counter()
        for pieces in substrings._batches(substrings._pieces([t.encode() for _, t in rows], limit, 35), limit):
            packed = substrings._Packed(pieces, often, 35)
            for n in range(len(packed.key)):
                for i in range(packed.windows[n]):
                    found[packed.row[n], packed.word[n] + i, packed.words.slice(packed.first[n] + i, packed.first[n] + i + 34)] += 1
        want = {(d, i, " ".join(words(t)[i:i + 35]).encode()) for d, t in rows for i in range(len(words(t)) - 34)}
        assert set(found) == want and set(found.values()) == {1}


def test_perplexity_of_a_kneser_ney_model(spark):
    train_texts = ["abracadabra abracadabra", "abc abd abe", "the cat sat on the mat", "the mat sat"] * 2
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(train_texts)], "doc_id long, text string, lang string")
    model = perplexity.train(docs)
    asked = ["abracadabra", "the dog", "zzz", "", None]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(asked)] + [(9, "abc", None)], "doc_id long, text string, lang string")
    one = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(rows, model).collect()}
    many = {r["doc_id"]: r["perplexity"] for r in perplexity.perplexities(rows, model, entries=20).collect()}
    assert len(perplexity.passes(model, 20)) > 2 and one == pytest.approx({k: v for k, v in many.items()})
    want = plain_kneser_ney([t.encode() for t in train_texts])
    for i, text in enumerate(asked):
        grams = perplexity._grams([(text or "").encode()])[0].tolist()
        assert one[i] == pytest.approx(math.exp(-sum(math.log(want(g)) for g in grams) / len(grams)) if grams else 0.0)
    assert one[9] is None
    # the probabilities after a context add up to 1
    shards = perplexity.Shards(model.groupBy("lang", "order", "context").applyInArrow(perplexity._packed, perplexity._PACKED).toArrow(), {"en": set(range(256))})
    context = int(perplexity._grams([b"abra"])[0][-1]) << 8
    after = np.array([(context | b) & ((1 << 40) - 1) for b in range(256)], np.int64)
    assert np.exp(shards.log_probabilities("en", after)).sum() == pytest.approx(1.0)


def plain_kneser_ney(trusted, order=perplexity.ORDER):
    tables = {order: collections.Counter(g for t in trusted for g in perplexity._grams([t])[0].tolist())}
    for n in range(order - 1, 0, -1):
        tables[n] = collections.Counter(g & ((1 << 8 * n) - 1) for g in tables[n + 1])
    cuts = {}
    for n, table in tables.items():
        c = collections.Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else None
        cuts[n] = [0.0] + [min(i, max(0.1, i - (i + 1) * y * c[i + 1] / c[i])) if y is not None and c[i] else 0.5 for i in (1, 2, 3)]

    def probability(gram, n=order):
        if n == 0:
            return 1 / 256
        low = gram & ((1 << 8 * n) - 1)
        lower = probability(gram, n - 1)
        after = [c for g, c in tables[n].items() if g >> 8 == low >> 8]
        if not after:
            return lower
        cut = lambda c: cuts[n][min(c, 3)]
        own = tables[n].get(low, 0)
        return (own - cut(own)) / sum(after) + sum(map(cut, after)) / sum(after) * lower

    return probability


def test_quality_classifier(spark, odd, empty):
    chance = random.Random(4)
    good = [" ".join(chance.choice(["the", "cat", "sat", "on", "a", "mat", "and", "ran"]) for _ in range(40)) for _ in range(300)]
    bad = ["".join(chance.choice("#%$&*!XQZ") for _ in range(150)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in perplexity.judge(docs, spark.range(250).select(F.col("id").alias("doc_id"))).collect()}
    assert sum(out[i] for i in range(250, 300)) >= 45 and not any(out[i] for i in range(300, 320))
    none = spark.createDataFrame([(None,)], "doc_id long")
    assert all(r["kept"] and r["threshold"] is None for r in perplexity.judge(odd, none).collect())
    assert perplexity.judge(empty, none).count() == 0
    assert perplexity.judge(odd, spark.createDataFrame([(4,), (9,), (12,)], "doc_id long")).count() == len(ODD)


def test_toxicity_on_held_out_documents(spark, odd, empty):
    chance = random.Random(6)
    plain, rude = [f"p{i}" for i in range(300)], ["grob", "mies", "fies", "doof"]
    rows = [(i, " ".join(chance.choice(plain) for _ in range(40)) + (" " + " ".join(chance.sample(rude, 1 + i % 4)) if i % 7 == 0 else ""), int(i % 7 == 0)) for i in range(1400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 900] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = range(900, 1400)
    assert sum(out[i]["toxic"] == (i % 7 == 0) for i in held) >= 0.98 * len(held)
    mean = [np.mean([out[i]["severity"] for i in held if i % 7 == 0 and i % 4 == n]) for n in range(4)]
    assert mean[0] < mean[3] and np.all(np.diff(model.thresholds) >= 0)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert {r["grade"] for r in toxicity.score(odd, toxicity.train(empty, labels)).collect()} == {0}


def ordinal_loss(weights, thresholds, x, grade):
    """Mean negative log-likelihood of the grades plus the L1 penalty, written out."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        above = [1.0, *(1 / (1 + math.exp(t - sum(w * v for w, v in zip(weights, row, strict=True)))) for t in thresholds), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(x) + toxicity.PENALTY * sum(map(abs, weights))


def test_ordinal_fit_reaches_the_best_by_search():
    """The loss is convex, so moves along each axis, halved where none helps, end at its minimum."""
    chance = np.random.default_rng(8)
    x = chance.integers(0, 2, (150, 3)).astype(float)
    grade = np.digitize(x @ [2.0, -1.5, 0.0] + chance.logistic(size=150), [0.5, 2.0])
    point, step = [0.0, 0.0, 0.0, 0.0, 1.0], 0.5
    best = ordinal_loss(point[:3], point[3:], x, grade)
    while step > 2e-4:
        moved = False
        for i in range(5):
            for d in (step, -step):
                trial = [*point[:i], point[i] + d, *point[i + 1:]]
                if trial[3] < trial[4] and (loss := ordinal_loss(trial[:3], trial[3:], x, grade)) < best:
                    point, best, moved = trial, loss, True
        step = step if moved else step / 2
    scale = np.zeros(toxicity.DIMENSIONS)
    scale[[5, 70, 900]] = 1.0
    rows = [np.array([5, 70, 900])[r > 0] for r in x]
    model = toxicity.fit(rows, grade, scale, grades=3)
    assert ordinal_loss(model.weights[[5, 70, 900]], model.thresholds, x, grade) <= best + 1e-5
    assert np.allclose(model.weights[[5, 70, 900]], point[:3], atol=0.05) and np.allclose(model.thresholds, point[3:], atol=0.05)
    assert np.count_nonzero(model.weights) <= 3


def test_toxicity_counted_by_spark_is_that_of_plain_loops(spark):
    """Places, their log-odds, grades, weights and severities of a small table, worked out a second time without Spark."""
    chance = random.Random(2)
    rows = [(i, " ".join(chance.choices([f"w{j}" for j in range(40)], k=12) + chance.choices(["vile", "vilest", "mean"], k=i % 3)), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    places = [[p for w in sorted(set(re.findall(r"[^\W_]+", t.lower()))) for p in toxicity.word_places(w)] for _, t, _ in rows]
    toxic = np.array([t for *_, t in rows])
    counts = [np.array([sum(p in have for have, t in zip(map(set, places), toxic, strict=True) if t == mark) for p in sorted(set().union(*places))]) for mark in (1, 0)]
    odds, marking = toxicity.selected(*counts, int(toxic.sum()), int((toxic == 0).sum()))
    scale, marks = np.zeros(toxicity.DIMENSIONS), set()
    for p, o, m in zip(sorted(set().union(*places)), odds, marking, strict=True):
        scale[p] = o
        marks |= {p} if m else set()
    grade = toxicity.graded(np.array([len(marks & set(p)) for p in places]), toxic > 0)
    plain = toxicity.fit([np.array(p) for p in places], grade, scale)
    assert np.allclose(model.weights, plain.weights, atol=1e-6) and np.allclose(model.thresholds, plain.thresholds, atol=1e-6)
    assert np.count_nonzero(plain.weights)
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for (i, *_), have in zip(rows, places, strict=True):
        above = 1 / (1 + np.exp(plain.thresholds - plain.weights[have].sum()))
        assert out[i]["severity"] == pytest.approx(above.sum(), abs=1e-5) and out[i]["toxic"] == (above[0] >= 0.5)


def test_words_of_toxic_documents_only_are_features():
    bad, good = np.array([5, 4, 50, 0, 3, 11, 2]), np.array([0, 0, 0, 40, 24, 76, 0])
    few, _ = toxicity.selected(bad[[0, 1, 4, 5]], good[[0, 1, 4, 5]], 11, 76)
    assert (few[:2] > 0).all() and (few[2:] == 0).all()
    even, _ = toxicity.selected(bad[[2, 3, 6]], good[[2, 3, 6]], 100, 100)
    assert even[0] > 0 > even[1] and even[2] == 0
    assert not toxicity.selected(bad * 0, good * 0, 0, 0)[0].any()


def test_neighbours_reach_brute_force(spark):
    chance = np.random.default_rng(3)
    centers = chance.normal(size=(30, 16))
    x = np.round(centers[chance.integers(0, 30, 3000)] + 0.4 * chance.normal(size=(3000, 16)), 4)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [None] + [1.0] * 15), (5003, [float("nan")] + [1.0] * 15), (5004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (7, [9.0] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    out = neighbours.search(table, F.col("id") % 20 == 0).collect()
    every = {(r["query_id"], r["rank"]): r["id"] for r in neighbours.search(table, F.col("id") % 20 == 0, exact=True).collect()}
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        hits += len({i for _, i, _ in got[q]} & set(best.tolist()))
        assert [every[q, r] for r in range(1, 21)] == best.tolist()
        assert [r for r, *_ in got[q]] == list(range(1, 21)) and all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in got[q])
    assert set(got) == set(range(0, 3000, 20)) and hits >= 0.9 * 20 * len(got)


def test_neighbours_of_few_equal_and_no_vectors(spark):
    some = spark.createDataFrame([(i, [1.0, 2.0]) for i in (20, 3, 40, 5)], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["id"]) for r in neighbours.search(some, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3), (20, 2, 5), (20, 3, 40), (40, 1, 3), (40, 2, 5), (40, 3, 20)]
    assert neighbours.search(some.where("false"), F.col("id") % 20 == 0).count() == 0
    assert neighbours.search(some.limit(1), F.lit(True)).count() == 0


def test_spread_join_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    assert sorted((r["v"], r["first"]) for r in spread_join(rows, facts, "k", "n", "v").collect()) == [(i, 0 if i < 2000 else i) for i in range(3000)]


def test_digest_of_the_query_is_that_of_the_kept_words(odd):
    out = substrings.without_repeats(odd).select("doc_id", F.sha2("text", 256).alias("h"), "text").collect()
    assert all(r["h"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in out)
