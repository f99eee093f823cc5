"""The registered queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, languages, licenses, mixing, neighbours, perplexity, rules, simhash, substrings, tokenfiles, toxicity, tries

RANK_FILE, TOKENIZER_FILE, PIECE_FILE = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that people found good."""
    return _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "grade", "toxic")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    docs = _table(spark, sf_dir).select("doc_id", "text")
    back = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(_table(spark, sf_dir).select("doc_id", "lang", "text"), trusted_ids(spark, sf_dir))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = mixing.sample(_table(spark, sf_dir).select("doc_id", "source", "text"))
    return sampled.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


_OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:4])::BIGINT AS place
  FROM documents),
sources AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sources),
level AS (
  SELECT *, sum(source_size) OVER () AS everything, sum(w) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER up, 0) AS caps_before, coalesce(sum(w) OVER up, 0) AS weights_before
  FROM weighed WINDOW up AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) * (weights - weights_before) <= CAST(everything - caps_before AS DOUBLE) * w AS capped FROM level),
targets AS (
  SELECT source, n, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((everything - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()) * w AS DOUBLE)
    / CAST(weights - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS DOUBLE) END AS target
  FROM capped),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.source,
    row_number() OVER (PARTITION BY s.source ORDER BY s.place * least(65536, n // 4096 + 1) // 65536, s.size, s.doc_id) AS nth
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || md5('{mixing.SEED}:' || coalesce(source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM placed),
counted AS (SELECT *, CAST(floor(nth * rate + u) - floor((nth - 1) * rate + u) AS BIGINT) AS copies FROM rated)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, copies * size AS taken, copies FROM counted
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(_table(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    manifest = tokenfiles.write(docs, public_tokenizers.path(TOKENIZER_FILE), END_ID)
    return tokenfiles.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _template(t: licenses.Template) -> str:
    lists = ", ".join(f"{x!r}::VARCHAR[]" for x in (t.words, t.needed.split(), t.barred.split()))
    return f"('{t.label}', {lists}, {t.least(licenses.THRESHOLD)}, {t.run(licenses.THRESHOLD)})"


_GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP5 = rf"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM texts),
worded AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_GAP}') AS ws FROM numbered),
phrases(phrase, label) AS (VALUES {", ".join(f"({p.split()!r}, '{v}')" for p, v in licenses.PHRASES.items())}),
places AS (
  SELECT r, i AS start, label FROM (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM worded) JOIN phrases ON ws[i + 1:i + len(phrase)] = phrase),
templates(label, words, needed, barred, least, run) AS (VALUES {", ".join(_template(t) for t in licenses.TEMPLATES)}),
held AS (
  SELECT r, ws, t.* FROM (SELECT r, ws, list_distinct(ws) AS own FROM worded) JOIN templates t ON len(list_intersect(own, words)) >= least),
blocks AS (
  SELECT r, label, words, needed, barred, least, ws[i:i + run - 1] AS block
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM held) WHERE list_contains(words, ws[i])),
matches AS (
  SELECT r, label, len(list_intersect(list_distinct(block), words)) / len(words) AS score FROM blocks
  WHERE len(list_intersect(list_distinct(block), words)) >= least AND list_has_all(block, needed) AND NOT list_has_any(block, barred)),
base AS (
  SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM places UNION SELECT r, label FROM matches) GROUP BY r),
best AS (SELECT r, max(score) AS score FROM matches GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""

_OP7 = r"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM numbered),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM worded)),
twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(least(8, coalesce(next - i, 8))) AS n FROM twice GROUP BY r),
counted AS (
  SELECT doc_id, text, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM worded LEFT JOIN repeats USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words * 2 OR word_chars > n_words * 16 OR word_chars < n_words * 2
    OR n_dup_lines * 10 > n_lines * 3 OR len(regexp_extract_all(text, '!')) * 10 > n_words * 3
    OR len(regexp_extract_all(text, '\p{Lu}')) * 2 > len(regexp_extract_all(text, '\p{L}'))
    OR len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) * 10 < n_words * 6
    OR len(regexp_extract_all(text, '(?m)^[ \t]*[-*\x{2022}]')) * 10 > n_lines * 9
    OR len(regexp_extract_all(text, '(?m)(\x{2026}|\.\.\.)[ \t]*$')) * 10 > n_lines * 3) AS kept
FROM based
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


_OP9 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM twice),
kept AS (
  SELECT r, string_agg(w, ' ' ORDER BY j) AS text FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM docs)
  ANTI JOIN gone USING (r, j) GROUP BY r),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = languages.train(docs.where(~held_out).select("lang", "text"))
    found = languages.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir).select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.path(PIECE_FILE))


# Turns of another conversation that begin one: that of the next lower multiple, and at most so many.
SHARED_BY, MOST_SHARED = 20, 3


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv").cast("string")) % (MOST_SHARED + 1)
    found = tries.nodes(*tries.rebuilt(_table(spark, sf_dir, "conversations"), SHARED_BY, head, MOST_SHARED))
    return found.withColumnRenamed("saved", "saved_tokens")


# CRC-32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))), 4294967295::BIGINT)"""
_OP13 = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sym) - 1 AS pos, sym, words FROM (
    SELECT conv_id, turn, sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS sym,
      len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list(sym ORDER BY pos) AS syms, list(words ORDER BY pos) AS ws FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, CAST({_CRC32.format("CAST(conv_id AS VARCHAR)")} AS BIGINT) % 4 AS h FROM own),
convs AS (
  SELECT o.conv_id, list_concat(coalesce(b.syms[1:h], []), o.syms[h + 1:]) AS syms, list_concat(coalesce(b.ws[1:h], []), o.ws[h + 1:]) AS ws
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {SHARED_BY}),
ways AS (
  SELECT conv_id AS c, d, len(syms) AS n, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, min(conv_id) OVER (PARTITION BY d, syms[1:d]) AS node
  FROM (SELECT *, unnest(range(0, len(syms) + 1)) AS d FROM convs)),
nodes AS (
  SELECT node, d, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM ways GROUP BY node, d),
children AS (
  SELECT p.node, p.d, count(DISTINCT q.node) AS n_children FROM ways p JOIN ways q ON p.c = q.c AND q.d = p.d + 1 GROUP BY ALL),
parents AS (SELECT DISTINCT q.node, q.d, p.node AS parent FROM ways p JOIN ways q ON p.c = q.c AND q.d = p.d + 1),
below AS (SELECT DISTINCT p.node, p.d, q.node AS below, q.d AS depth FROM ways p JOIN ways q ON p.c = q.c AND q.d >= p.d),
sums AS (
  SELECT b.node, b.d, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.node = b.below AND n.d = b.depth LEFT JOIN children c ON c.node = b.below AND c.d = b.depth GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN sums USING (node, d) LEFT JOIN children USING (node, d) LEFT JOIN parents USING (node, d)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_byte_bpe": op2_byte_bpe, "op3_quality": op3_quality, "op4_mixing": op4_mixing, "op5_license_scan": op5_license_scan,
            "op6_simhash": op6_simhash, "op7_quality_rules": op7_quality_rules, "op8_token_files": op8_token_files, "op9_substrings": op9_substrings,
            "op10_neighbours": op10_neighbours, "op11_language_id": op11_language_id, "op12_alignment": op12_alignment, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _OP4, "op5_license_scan": _OP5, "op7_quality_rules": _OP7, "op9_substrings": _OP9, "op13_prefix_trie": _OP13}
