"""The queries of this subpackage over the tables of a folder, and their SQL twins where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bitplanes, decontaminate, line_dedup, near_dup, packing, quality_model, quality_rules, secret_scan, sharding, simhash, spelling, substring_dedup, whitening
from ledgerloom.llm.shared import read_table, shared_root


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; only its path goes to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the one with the largest id. One row a document; null and empty texts are one empty line."""
    rows = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document, and whether it and its host pass. One row a document; a null text has no words, a null source is a host of its own."""
    return quality_rules.judged(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes. One row a document; a null text counts as no bytes, an empty table gives no rows."""
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), 24)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are at least 85 % alike. One row a document; a null or empty text is linked with nothing."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85, width=5)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern, and strings that their surroundings do not explain. One row a document; a null text has no spans."""
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 ids. A null or empty text is one piece, the end id."""
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back. One row a document; a null or empty text is the end id alone."""
    path = shared_folder(spark, "token-files")
    bitplanes.write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return bitplanes.document_checksums(spark, path)


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that another document repeats at a similarity of at least 0.8; texts without one have no row."""
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"), words=50, similarity=0.8)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document. One row a document; a null text has no words."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by a model trained outside the held-out fold. One row a document, null and empty texts too."""
    scored = quality_model.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), cut=0.3)
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 6 letters or more with their near words, form and root. One row a word; null texts have none."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), least_chars=6, least_count=5, ratio=5, every=199)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and components at 4 differing bits. One row a document; a text without words has fingerprint zero, linked like any other."""
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), width=4, most=4)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened vectors: one row a usable vector and component, up to 16. Null vectors and those with null or non-finite entries have none."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), most=16)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_sharding": op3_sharding,
    "op4_minhash": op4_minhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_bit_planes": op7_bit_planes,
    "op8_compact_windows": op8_compact_windows,
    "op9_decontamination": op9_decontamination,
    "op10_quality_model": op10_quality_model,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, common.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r""",
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
counts AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
rules AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
broken AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines AS is_broken FROM rules),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (is_broken) AS failed FROM broken GROUP BY source),
spread AS (SELECT sum(failed) / sum(n) AS mean, sum(n) AS total, count(*) AS k, sum(n * (failed / n) * (failed / n)) AS squares FROM hosts),
prior AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(squares / total - mean * mean - mean * (1 - mean) * k / total, 1e-12) - 1, 1.0), 10000.0) AS strength FROM spread),
verdict AS (SELECT source, (failed + strength * mean) / (n + strength) <= 0.5 AS host_kept FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM broken JOIN verdict ON broken.source IS NOT DISTINCT FROM verdict.source""",
}
