"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text, one for each language.

Units are the bytes of the UTF-8 text, so every language has the same alphabet and nothing is unknown; a model of
``ORDER`` bytes sees a few letters. Each document is preceded by ``ORDER - 1`` bytes that mark its start.

Counts are taken over all trusted documents: each batch adds up its own, and one shuffle by language and n-gram adds
those up. Lower orders count the different bytes an n-gram follows; discounts come from counts of counts, by
language and order. All this is grouped and joined by Spark.

Scoring needs, for a unit, only entries that share the unit before it. So the model falls into shards by language and
that byte, and shards are packed into passes of at most ``ENTRIES`` entries: what one pass sends to all tasks is
bounded by that, whatever the size of the model (a single shard excepted). Each pass scores the units of its shards,
and the sums of a document are added up. Models of natural languages take one pass.

A document is kept if its perplexity is at most the ``QUANTILE`` of trusted documents of its language that were held
out of the model. Null and blank texts have no units and perplexity 0, so they are kept; a null language is one of its
own. Where a language has no trusted text, perplexity and threshold are null and its documents are kept. Rows are
judged alone; repeated rows get equal results, and an empty table an empty one. Columns of the input called like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, new_folder, put, shielded, slices, small, stored, text_bytes, text_key, with_fields

ORDER, START = 5, 2
# Small counts can give a discount of 0; then a context would leave nothing to what it has not seen.
LEAST_DISCOUNT = 0.1
# Entries of the model that one pass sends to all tasks (16 bytes each).
ENTRIES = 4_000_000
# One trusted document in so many is held out to set the threshold, which is this quantile of them.
HELD_OUT, QUANTILE = 5, 0.99
BATCH_BYTES = 1 << 20
# Entries are packed by their first byte, so that no task packs all of an order; short ones are few and stay together.
_FIRST = "CASE WHEN order - CAST(context AS INT) > 2 THEN shiftright(gram, 8 * (order - CAST(context AS INT) - 1)) ELSE 0L END"


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch with the numbers of its rows; null is ''."""
    names = batch.column("lang").fill_null("").to_pylist()
    for name in dict.fromkeys(names):
        yield name, np.array([n for n, x in enumerate(names) if x == name])


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, first byte highest, and the number of bytes of each text."""
    pad = bytes([START]) * (ORDER - 1)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(raw):
        return raw, sizes
    grams = np.zeros(max(0, len(raw) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        grams = (grams << np.uint64(8)) | raw[i:i + len(grams)]
    # grams that end in the start marks of the next text do not count
    text = np.repeat(np.arange(len(texts)), sizes)
    return grams[np.arange(sizes.sum()) + text * (ORDER - 1)], sizes


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all documents given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = text_bytes(batch)
            for name, rows in _languages(batch):
                codes, grams = pd.factorize(_grams([texts[r] for r in rows])[0].view(np.int64))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams, "n": np.bincount(codes, minlength=len(grams))})

    each = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _low(gram: Column, n: int) -> Column:
    """The last ``n`` bytes of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _discounts(table: DataFrame) -> DataFrame:
    """D1, D2 and D3 of each language, from the counts of its counts."""
    n = [F.count_if(F.col("n") == i).cast("double").alias(f"_n{i}") for i in (1, 2, 3, 4)]
    of = table.groupBy("lang").agg(*n)
    y = F.try_divide("_n1", F.col("_n1") + 2 * F.col("_n2"))

    def discount(i: int) -> Column:
        exact = i - (i + 1) * y * F.try_divide(F.col(f"_n{i + 1}"), F.col(f"_n{i}"))
        return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), F.coalesce(exact, F.lit(0.5)))).alias(f"d{i}")

    return of.select(F.col("lang").alias("_lang"), discount(1), discount(2), discount(3))


def train(trusted: DataFrame) -> DataFrame:
    """The model: lang, shard (byte before the predicted one, -1 for all), order, context (whether the entry is the
    weight that a context gives to the order below), gram, value, first (by which entries are packed).

    Each order is written by itself, and no table that grows with the text is broadcast: a plan of all orders at once
    has the broadcasts of all in the driver.
    """
    level = counts(trusted).where("n > 0")
    path = new_folder(trusted.sparkSession, "model")
    for order in range(ORDER, 0, -1):
        level = stored(level, f"order{order}")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # one row per language
        own = level.join(F.broadcast(_discounts(level)), F.col("lang") == F.col("_lang")).withColumn("_d", F.least(d, F.col("n").cast("double")))
        own = own.withColumn("_context", F.shiftright("gram", 8))
        sums = own.groupBy("lang", "_context").agg(F.sum("n").alias("_total"), F.sum("_d").alias("_mass"))
        seen = own.join(sums.hint("merge"), ["lang", "_context"])
        alpha = seen.select("lang", (F.shiftright("gram", 8).bitwiseAND(F.lit(255)) if order > 1 else F.lit(-1).cast("long")).alias("shard"),
                            F.lit(order).alias("order"), F.lit(False).alias("context"), "gram", ((F.col("n") - F.col("_d")) / F.col("_total")).alias("value"))
        weight = sums.select("lang", (_low(F.col("_context"), 1) if order > 1 else F.lit(-1).cast("long")).alias("shard"),
                             F.lit(order).alias("order"), F.lit(True).alias("context"), F.col("_context").alias("gram"), (F.col("_mass") / F.col("_total")).alias("value"))
        entries = alpha.unionByName(weight).withColumn("first", F.expr(_FIRST))
        entries.write.mode("append").parquet(path)
        if order > 1:
            level = level.groupBy("lang", _low(F.col("gram"), order - 1).alias("gram")).agg(F.count("*").alias("n"))
    return trusted.sparkSession.read.schema(entries.schema).parquet(path)


_PACKED = "lang string, order int, context boolean, first long, grams binary, values binary"


def _packed(part: pa.Table) -> pa.Table:
    """The entries of one language, order, kind and first byte in one row, sorted: 16 bytes each, whoever loads them."""
    grams, values = part["gram"].to_numpy(), part["value"].to_numpy()
    order = np.argsort(grams, kind="stable")
    return pa.table({"lang": part["lang"][:1], "order": part["order"][:1], "context": part["context"][:1], "first": part["first"][:1],
                     "grams": pa.array([grams[order].astype("<i8").tobytes()], pa.binary()),
                     "values": pa.array([values[order].astype("<f8").tobytes()], pa.binary())})


class Shards:
    """Some shards of a model, as sorted arrays by language, order and kind."""

    def __init__(self, packed: pa.Table, held: dict[str, set[int]]) -> None:
        """``held`` has the shards by language."""
        self.held = held
        packed = packed.sort_by([(c, "ascending") for c in ("lang", "order", "context", "first")])
        keys = list(zip(*[packed[c].to_pylist() for c in ("lang", "order", "context")], strict=True))
        self.parts = {}
        for key in dict.fromkeys(keys):
            # entries of one first byte are sorted, and first bytes come in order: so are all entries
            start, n = keys.index(key), keys.count(key)
            self.parts[key] = tuple(
                np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in packed[c].slice(start, n)]) for c, kind in (("grams", "<i8"), ("values", "<f8")))

    def _find(self, key: tuple, grams: np.ndarray, default: float) -> np.ndarray:
        if key not in self.parts:
            return np.full(len(grams), default)
        known, values = self.parts[key]
        place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        return np.where(known[place] == grams, values[place], default)

    def log_probabilities(self, name: str, grams: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram, after the bytes before it."""
        p = np.full(len(grams), 1 / 256)
        for order in range(1, ORDER + 1):
            low = grams & ((1 << (8 * order)) - 1)
            p = self._find((name, order, False), low, 0.0) + self._find((name, order, True), low >> 8, 1.0) * p
        return np.log(p)


def passes(model: DataFrame, entries: int = ENTRIES) -> list[list[tuple[str, int]]]:
    """The shards (language, byte) of each pass. At most 256 rows per language are looked at.

    Bytes that the model has never seen before another are shards without entries: they need scoring too.
    """
    sizes = {(r["lang"], r["shard"]): r["count"] for r in model.where("shard >= 0").groupBy("lang", "shard").count().collect()}
    out: list[list[tuple[str, int]]] = []
    held = entries
    for name in sorted({name for name, _ in sizes}):
        for shard in range(256):
            size = sizes.get((name, shard), 0)
            if not out or held + size > entries:
                out.append([])
                held = 0
            out[-1].append((name, shard))
            held += size
    return out


def _score(shards, partial: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model: Shards = shards.value
        for batch in slices(batches, "text", BATCH_BYTES):
            texts, sums, units = text_bytes(batch), np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, np.int64)
            for name, rows in _languages(batch):
                if name not in model.held:
                    continue
                grams, sizes = _grams([texts[r] for r in rows])
                codes, different = pd.factorize(grams.view(np.int64))
                logs = model.log_probabilities(name, different) if len(different) else np.zeros(0)
                mine = np.isin((different >> 8) & 255, list(model.held[name]))
                total = np.concatenate([[0.0], np.cumsum(np.where(mine, logs, 0.0)[codes])])
                count = np.concatenate([[0], np.cumsum(mine.astype(np.int64)[codes])])
                ends = np.cumsum(sizes)
                sums[rows], units[rows] = total[ends] - total[ends - sizes], count[ends] - count[ends - sizes]
            if partial:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), batch.column("lang"), pa.array(sums, from_pandas=True), pa.array(units)],
                                                 ["doc_id", "_key", "lang", "_sum", "_units"])
            else:
                yield put(batch, _sum=pa.array(sums, from_pandas=True), _units=pa.array(units))

    return run


class Passes:
    """A model cut into passes, each sent to all tasks when asked for; a model of one pass is sent once."""

    def __init__(self, model: DataFrame, entries: int = ENTRIES) -> None:
        self.model, self.parts, self._only = model, passes(model, entries), None

    def load(self, pairs: list[tuple[str, int]]):
        if self._only is not None:
            return self._only
        names: dict[str, list[int]] = {}
        for name, shard in pairs:
            names.setdefault(name, []).append(shard)
        wanted = F.lit(False)
        for name, held in names.items():
            wanted = wanted | ((F.col("lang") == name) & F.col("shard").isin(-1, *held))
        table = self.model.where(wanted).groupBy("lang", "order", "context", "first").applyInArrow(_packed, _PACKED).toArrow()
        shards = Shards(table, {name: set(held) for name, held in names.items()})
        found = self.model.sparkSession.sparkContext.broadcast(shards), list(names)
        if len(self.parts) <= 1:
            self._only = found
        return found


def perplexities(docs: DataFrame, model: DataFrame | Passes, entries: int = ENTRIES) -> DataFrame:
    """Add ``perplexity``, per byte. ``docs`` has doc_id, lang and text."""
    cut = model if isinstance(model, Passes) else Passes(model, entries)
    parts, load = cut.parts, cut.load
    docs = docs.drop("perplexity")

    value = F.when(F.col("_units") > 0, F.exp(-F.col("_sum") / F.col("_units"))).when(F.col("_sum").isNotNull(), 0.0).alias("perplexity")
    if len(parts) <= 1:
        shards, _ = load(parts[0] if parts else [])
        scored = docs.mapInArrow(_score(shards, False), with_fields(docs.schema, ("_sum", "double"), ("_units", "long")))
        return scored.select(*[F.col(f"`{c}`") for c in docs.columns], value)
    keyed = docs.select("doc_id", text_key().alias("_key"), "lang", "text")
    some = None
    for pairs in parts:
        shards, names = load(pairs)
        one = keyed.where(F.coalesce("lang", F.lit("")).isin(names)).mapInArrow(_score(shards, True), "doc_id long, _key long, lang string, _sum double, _units long")
        some = one if some is None else some.unionByName(one)
    # a row that is repeated adds as often to both sums
    sums = some.groupBy("doc_id", "_key", "lang").agg(F.sum("_sum").alias("_sum"), F.sum("_units").alias("_units"))
    sums = sums.select(F.col("doc_id").alias("_doc"), F.col("_key").alias("_text"), F.col("lang").alias("_lang"), "_sum", "_units")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_key() == F.col("_text")) & F.col("lang").eqNullSafe(F.col("_lang"))
    return docs.join(sums, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], value)


def thresholds(held_out: DataFrame, model: DataFrame | Passes, quantile: float = QUANTILE, entries: int = ENTRIES) -> DataFrame:
    """Per language: the quantile of the perplexities of trusted documents that the model has not seen."""
    scored = perplexities(held_out.select("doc_id", "lang", "text"), model, entries)
    return scored.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))


def judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, entries: int = ENTRIES) -> DataFrame:
    """Add perplexity, threshold and kept. ``trusted_ids`` has the doc_ids of trusted documents."""
    docs, undo = shielded(docs, "doc_id", "lang", "text")
    ids = trusted_ids.select(F.col("doc_id").alias("_doc")).distinct()
    trusted = stored(docs.select("doc_id", "lang", "text").join(small(ids), F.col("doc_id") == F.col("_doc"), "left_semi"), "trusted")
    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_OUT)) == 0
    model = Passes(train(trusted.where(~held)), entries)
    limits = stored(thresholds(trusted.where(held), model, quantile, entries), "thresholds")
    scored = perplexities(docs, model, entries)
    # one row per language
    out = scored.join(F.broadcast(limits), F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").drop("_lang")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return undo(out.withColumn("kept", kept), "perplexity", "threshold", "kept")
