"""A corpus pipeline of five operators: what one stage keeps is all that the next one sees.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs`` (n_chars, where
there is one, follows the text); the last returns packed pieces. Stages are written as Parquet in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_dedup, near_dup, packing, quality_model
from ledgerloom.llm.registry import tokenizer_path
from ledgerloom.llm.shared import read_table, shared_root


def _with_text(columns: list[str], text) -> list:
    """The columns of a struct ``row``, with another text; n_chars counts its characters."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of all folds but the held-out one, rejects go."""
    scored = quality_model.quality_scores(docs, read_table(spark, sf_dir, "labels"), cut=0.3)
    return scored.where("predicted = 1").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in one of them. All documents stay."""
    rows = line_dedup.dedup_lines(docs, least_chars=20, least_docs=3)
    return rows.select(*_with_text(docs.columns, F.when(F.col("row.text").isNotNull(), F.col("kept_text"))))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Rows that repeat an id stay or go together."""
    verdict = near_dup.near_duplicates(docs, percent=80, width=5, rows=4, bands=25)
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("_gone"), "left_anti").select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows leave the texts; clean documents stay as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = decontaminate.with_occurrences(rows, read_table(spark, sf_dir, "benchmark"), F.col("row.text"), window=10)
    hit = F.size("found.spans") > 0
    cut = decontaminate.without_spans(F.when(hit, F.col("row.text")), F.when(hit, F.col("found.spans")))
    return found.select("row", F.coalesce(cut, F.col("row.text")).alias("cut")).select(*_with_text(docs.columns, F.col("cut")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as token pieces in sequences of at most 4096 ids."""
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sequence_packing", sequence_packing),
]

#: The model and the tokenizer cannot be said in SQL; tests/llm hold each stage against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each but the last is written to the cluster's shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
