import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash

from ledgerloom.llm import quality_model as Q
from ledgerloom.llm.registry import op10_quality_model

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = op10_quality_model(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert len(bad) > 3 and np.mean([g > b for g in good for b in bad]) > 0.97


def test_labels_of_the_held_fold_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = (sorted((r.row.doc_id, r.score) for r in Q.quality_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd_docs, no_docs, odd_texts):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = Q.quality_scores(odd_docs, labels).collect()
    assert len(rows) == len(odd_texts) + 4 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].row.asDict().keys() == set(odd_docs.columns)
    assert Q.quality_scores(no_docs, labels).collect() == []
    assert {r.score for r in Q.quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_sparse_dot_product_by_hand():
    texts = pa.array(["", "one", "one one two"])
    ids, ends = Q.features(texts, 20)
    assert np.diff(ends).tolist() == [0, 5, 15]
    w = Q.ftrl([(ids[ends[2] : ends[3]], 1), (ids[ends[1] : ends[2]], 0)] * 5, 20, 4, 1.0, 0.05, 0.0, 0.0)
    logit = [sum(w[i] for i in ids[ends[k] : ends[k + 1]]) * 5 / max(1, ends[k + 1] - ends[k]) + w[-1] for k in range(3)]
    assert logit[2] > logit[1]


def plain_features(text, bits=20):
    """The features of a text with whole numbers, one word at a time, as shares among its words."""
    wide = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & wide
        return (x ^ (x >> 29)) & ((1 << bits) - 1)

    shares, last, last_form = {}, 0, 0
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    for word in words:
        shape = regex.sub(r"\p{N}+", "0", regex.sub(r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]+", "x", regex.sub(r"[\p{Lu}\p{Lt}]+", "X", word)))
        own, form = xxhash.xxh64_intdigest(word.encode(), 1), xxhash.xxh64_intdigest(shape.encode(), 2)
        for f in (own, (own + last * 0xC2B2AE3D27D4EB4F) & wide, form, (form + last_form * 0xC2B2AE3D27D4EB4F) & wide, 11 if own == last else 12):
            shares[mixed(f)] = shares.get(mixed(f), 0.0) + 1 / len(words)
        last, last_form = own, form
    return {**shares, "bias": 1.0}


def plain_training(examples, epochs=3, alpha=1.0, beta=0.05, l1=0.0005, l2=0.0001):
    """Follow-the-regularised-leader, proximal, one weight at a time."""
    z, n = {}, {}

    def weight(f):
        at = z.get(f, 0.0)
        return 0.0 if abs(at) <= l1 else -(at - math.copysign(l1, at)) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for shares, label in examples:
            now = {f: weight(f) for f in shares}
            error = 1 / (1 + math.exp(-sum(now[f] * x for f, x in shares.items()))) - label
            for f, x in shares.items():
                was = n.get(f, 0.0)
                n[f] = was + (error * x) ** 2
                z[f] = z.get(f, 0.0) + error * x - (math.sqrt(n[f]) - math.sqrt(was)) / alpha * now[f]
    return {f: weight(f) for f in z}


def test_scores_equal_a_plain_training(spark):
    rng = random.Random(3)
    pool = ["the", "The", "THE", "of", "12", "v2.0", "éa", "Éa", "日本", "x", "buy", "now!", "now!", "$$$", "naïve", "a-b"]
    texts = {i: rng.choice([" ", "\n", "\t "]).join(rng.choices(pool, k=rng.randint(0, 40))) for i in range(60)} | {60: None, 61: "", 62: "the the the"}
    labels = {i: int("buy" in (t or "")) for i, t in texts.items() if i % 4}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.row.doc_id: r.score for r in Q.quality_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    used = sorted((order[i], y, i) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5)
    weights = plain_training([(plain_features(texts[i]), y) for _, y, i in used])
    for i, text in texts.items():
        logit = sum(weights.get(f, 0.0) * x for f, x in plain_features(text).items())
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-5, text
