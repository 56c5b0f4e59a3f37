"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import plain_strings, release
from ledgerloom.llm.words import pieces_of, word_codes

_AS_IS = np.arange(256, dtype=np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(words: pa.StringArray, seed: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _shapes(words: pa.StringArray) -> pa.StringArray:
    """Runs of capitals, small letters and digits as one sign each: ``Word,`` gives ``Xx,``."""
    for pattern, sign in (("[\\p{Lu}\\p{Lt}]+", "X"), ("[\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]+", "x"), ("\\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, sign)
    return words


def features(texts: pa.StringArray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all texts, offsets of each text's): five for each word.

    They are the word, the pair it makes with the word before it, its shape, the pair of shapes,
    and whether it repeats the word before it. A text's value of a feature is its share among
    the text's words. The first word's pairs are made with nothing.
    """
    words, codes, offsets = word_codes(texts, _AS_IS)
    plain, shape = _hashes(words, 1), _hashes(_shapes(words), 2)
    first = np.zeros(len(codes), bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    own, form = plain[codes], shape[codes]

    def before(x):
        y = np.roll(x, 1)
        y[first] = 0
        return y

    last = before(own)
    again = np.where(own == last, np.uint64(11), np.uint64(12)).astype(np.uint64)
    out = np.stack([_mixed(own), _mixed(own + last * _NEXT), _mixed(form), _mixed(form + before(form) * _NEXT), _mixed(again)], axis=1)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).reshape(-1), offsets * 5


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights of features, and the bias last. Each example: its hashed features, repeats included, and its label 0 or 1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    counted = []
    for ids, label in examples:
        at, count = np.unique(ids, return_counts=True)
        share = np.append(count * (5.0 / max(1, len(ids))), 1.0)
        counted.append((np.append(at, size - 1).astype(np.int64), share, label))
    for _ in range(epochs):
        for at, share, label in counted:
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ share, -35, 35))) - label) * share
            was = n[at]
            n[at] = was + gradient**2
            z[at] += gradient - (np.sqrt(n[at]) - np.sqrt(was)) / alpha * w
    return weights(np.arange(size))


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", bits: int = 20, epochs: int = 3, alpha: float = 1.0, beta: float = 0.05, l1: float = 0.0005, l2: float = 0.0001) -> np.ndarray:
    """Fit on a bounded table of texts with labels 0 and 1; the caller bounds it (see :func:`sample_of`).

    Features are made where the texts lie; one task then streams them through the online updates and
    hands only the weights (2**bits + 1 numbers) to the driver. Rows with a null label are left
    out, a null text has no words. With no rows, or one label only, the weights lean to what was
    seen: 0 everywhere scores every text 0.5.
    """
    size = (1 << bits) + 1

    def hashed(batches):
        for batch in batches:
            texts = plain_strings(batch.column("text"))
            for start, part in pieces_of(texts):
                ids, ends = features(part, bits)
                body = [ids[ends[k] : ends[k + 1]].tobytes() for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(part)), batch.column("label").slice(start, len(part)), pa.array(body, pa.binary())], names=["key", "label", "ids"])
        release()

    def fit(batches):
        examples = [(np.frombuffer(i.as_py(), np.uint32), y.as_py()) for b in batches for y, i in zip(b.column("label"), b.column("ids"))]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(examples, bits, epochs, alpha, beta, l1, l2).astype(np.float32).tobytes()], pa.binary())], names=["weights"])
        del examples
        release()

    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").withColumn("key", F.xxhash64("text"))
    found = rows.mapInArrow(hashed, "key long, label int, ids binary").repartition(1).sortWithinPartitions("key", "label").mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros(size, np.float32)


def sample_of(labels: DataFrame, most_rows: int, key_col: str = "doc_id") -> DataFrame:
    """About ``most_rows`` of the rows, or all if there are no more: those with the lowest hashes of their key.

    Needs one count and no sort; it picks the same rows on every run.
    """
    share = min(1.0, most_rows / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64(F.lit(17), key_col), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else labels


def score(spark, weights: np.ndarray, text: Column) -> Column:
    """The model's score of each whole text, 0 to 1 (higher: label 1 likelier); null and empty texts score by the bias alone."""
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(weights, np.float32))
    bits = (len(weights) - 1).bit_length() - 1

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, part in pieces_of(plain_strings(batch)):
                ids, ends = features(part, bits)
                sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
                n = np.diff(ends)
                logit = (sums[ends[1:]] - sums[ends[:-1]]) * 5.0 / np.maximum(1, n) + float(table[-1])
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield pa.array(np.concatenate(out))
            del batch, out
            release()

    return F.arrow_udf(scored, "double")(text)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, cut: float = 0.3, most_rows: int = 8_000) -> DataFrame:
    """Train on labels outside the held-out fold and score every document.

    A document's fold is crc32 of its id as text, modulo ``folds``; a null id has fold null and is
    never trained on. Training takes about ``most_rows`` labelled documents (a documented bound,
    chosen by hash of the id); scoring takes all rows and whole texts. Labels, ids and all other columns are no
    inputs of a score. Returns all columns of ``docs`` in a struct ``row``, then held_out, score and
    predicted (1 if the score is at least ``cut``). No labels: every score is 0.5.
    """
    spark = docs.sparkSession
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % folds
    usable = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold("key") != held_fold))
    chosen = sample_of(usable, most_rows, "key")
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    weights = train(texts.join(F.broadcast(chosen), "key"))  # about most_rows rows of two numbers
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.select(
        "row",
        F.coalesce(F.crc32(F.col(f"row.{id_col}").cast("string").cast("binary")) % folds == held_fold, F.lit(False)).alias("held_out"),
        score(spark, weights, F.col(f"row.{text_col}")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= cut).cast("int"))
