"""Token ids as flat binary files with 64-bit offsets, and reading them back by memory map.

Documents are range-partitioned by doc_id and sorted; each task encodes its documents and writes one
``.bin`` file (ids, 16 bit where the vocabulary allows, else 32 bit, little-endian), one ``.off`` file
(n + 1 offsets into it, 64 bit) and one ``.doc`` file (doc ids, 64 bit). The manifest has one row per
part; prefix sums over it give each part the number of its first token. Files are named by task attempt,
and only those of the attempts that ended well are in the manifest, so lost executors do no harm.

Order: ascending doc_id, nulls first, rows of one id in the order of a hash of their text. A null text is
an empty one: only the end id. An empty table gives a manifest without rows. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, new_folder, slices, stored, text_key
from .pieces import PieceIds

# Bytes of text that are encoded at a time, and of one part at most, on average.
BATCH_BYTES, PART_BYTES = 4 << 20, 256 << 20
# Words new to a worker that are given to the library as one text.
RUN_WORDS = 500
# Where ids of all parts before one are added up, parts are rows: one per task that wrote.
_PART = "part long, file string, wide boolean, n_docs long, n_null long, n_tokens long"

def _encoder(path: str) -> tuple[PieceIds, bool]:
    """One encoder per worker, and whether its ids need 32 bits. Strings of special tokens are these, as in the library."""
    def make() -> tuple[PieceIds, bool]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        encode = lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return PieceIds(encode, whole=added, encode_run=_run_encoder(tokenizer, encode)), tokenizer.get_vocab_size() > 1 << 16

    return kept(("tokenizer", path), make)


def _run_encoder(tokenizer, encode):
    """Encodes words with a space before each as few texts: a call for each word costs more than the word.

    Only a token at the start of such a word begins with the space (byte-level it is its first character), so these tell
    the words apart. Should their number differ, the words are encoded one by one.
    """
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    begins[[n for token, n in vocabulary.items() if token.startswith("\u0120")]] = True

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        texts = [words[at:at + RUN_WORDS] for at in range(0, len(words), RUN_WORDS)]
        for some, found in zip(texts, encode([" " + " ".join(t) for t in texts]), strict=True):
            found = np.array(found, np.uint32)
            starts = np.flatnonzero(begins[found])
            if len(starts) == len(some) and starts[0] == 0:
                ids.append(found)
                lengths.append(np.diff(starts, append=len(found)))
            else:
                each = encode([" " + w for w in some])
                ids += [np.array(e, np.uint32) for e in each]
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *lengths])

    return run


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _qualified(spark, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the token files; returns the manifest: part, file, wide, n_docs, n_null, n_tokens, first_token.

    ``path`` is a tokenizer file with byte-level pre-tokenizing; ``end_id`` ends each document. ``folder`` is on storage that
    all executors reach; without a scheme it means the cluster's default file system.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder) if folder else new_folder(spark, "tokens")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, wide = _encoder(path)
        store, root = _store(folder)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        offsets, ids, nulls, n_docs, total = np.zeros(1, "<i8"), 0, 0, 0, 0
        with store.open_output_stream(f"{name}.bin") as out, store.open_output_stream(f"{name}.off") as off, \
                store.open_output_stream(f"{name}.doc") as doc:
            off.write(offsets.tobytes())
            for batch in slices(batches, "text", BATCH_BYTES):
                ids, lengths = pieces.encode_all(batch.column("text").fill_null("").to_pylist(), end_id)
                out.write(ids.astype("<u4" if wide else "<u2").tobytes())
                off.write((total + np.cumsum(lengths)).astype("<i8").tobytes())
                doc.write(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                total += int(lengths.sum())
                n_docs += batch.num_rows
                nulls += batch.column("doc_id").null_count
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "wide": [wide], "n_docs": [n_docs],
                                              "n_null": [nulls], "n_tokens": [total]})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("_key"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # parts grow in number with the texts, beyond the session's number of shuffle partitions
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    placed = keyed.repartitionByRange(parts, "doc_id", "_key").sortWithinPartitions("doc_id", "_key").drop("_key")
    parts = stored(placed.mapInArrow(run, _PART), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """The documents in the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids.

    ``ids`` are little-endian unsigned 32-bit integers, whatever the width in the file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield from _read_part(part)

    # with a number given, Spark does not put these few rows into one task
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.repartition(tasks, "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _mapped(store: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(name, kind, "r") if os.path.getsize(name) else np.zeros(0, kind)
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read(), kind)


def _read_part(part: dict) -> Iterator[pa.RecordBatch]:
    store = _store(part["file"])[0]
    ids = _mapped(store, part["file"] + ".bin", "<u4" if part["wide"] else "<u2")
    offsets = _mapped(store, part["file"] + ".off", "<i8")
    docs = _mapped(store, part["file"] + ".doc", "<i8")
    at = 0
    while at < len(docs):
        # as many documents as hold this many ids, one at least
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        cut = offsets[at:to + 1]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(docs[at:to], mask=np.arange(at, to) < part["n_null"]),
            "start": pa.array(part["first_token"] + cut[:-1]), "n_tokens": pa.array(np.diff(cut)),
            "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        })
        at = to
