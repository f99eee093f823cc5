"""From raw documents to token ids: the operators of ``assayframe.llm`` one after another.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import bpe, mixing, perplexity, simhash, substrings
from assayframe.llm.common import stored
from assayframe.llm.queries import RANK_FILE, trusted_ids


# Executors still hold the memory of the stages before, so the last one takes small batches and its workers know fewer pieces:
# with 100,000 of them, the time doubles.
BATCH_BYTES, BATCH_TOKENS, KNOWN_PIECES = 512 << 10, 120_000, 200_000
# Bytes of rows that go to a worker at a time. Without it that is 10,000 rows: 25 MB of texts, held by the JVM in a buffer that
# grows by doubling, and again by the worker, though operators cut it up into 1 to 4 MB. Results do not depend on it.
SENT, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile of trusted documents."""
    judged = perplexity.judge(docs, trusted_ids(spark, sf_dir))
    return judged.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand elsewhere; documents of which no word is left go."""
    cut = substrings.without_repeats(docs, keep_layout=True)
    left = cut.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.char_length("text").cast("long")
    columns = [F.col(f"`{c}`") if c != "n_chars" else F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")).alias(c) for c in docs.columns]
    return left.select(*columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; ``exact`` says that decoding gives the text back."""
    path = public_tokenizers.path(RANK_FILE)
    back = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, batch_bytes=BATCH_BYTES,
                          batch_tokens=BATCH_TOKENS, known=KNOWN_PIECES)
    same = F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("decoded")
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("exact"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sparing(stage: Stage) -> Stage:
    """The stage with batches of ``SENT_BYTES``, a setting of the session that stays: Spark reads it when the result is asked for."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(SENT, str(SENT_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _sparing(quality)),
    ("near duplicates", _sparing(near_duplicates)),
    ("repeated passages", _sparing(repeated_passages)),
    ("mixing", _sparing(mixture)),
    ("byte-level BPE", _sparing(tokens)),
]

# The language model and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
