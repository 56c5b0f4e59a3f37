import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import names
from tests.test_dedup import levenshtein

MEASURES = {"ratio": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), "levenshtein": levenshtein}


def brute(rows, threshold, metric):
    found = {}
    for block in {b for b, _ in rows}:
        keys = sorted({k for b, k in rows if b == block and k})
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if 2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) and (s := MEASURES[metric](a, b)) >= threshold:
                    found[block, a, b] = round(s, 9)
    return found


@pytest.mark.parametrize("metric", ["ratio", "levenshtein"])
@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_all_pairs_and_no_others(spark, metric, threshold):
    rng = random.Random(5)
    stems = ["".join(rng.choice("ABCDÉ ") for _ in range(rng.randint(1, 22))) for _ in range(60)]
    rows = []
    for stem in stems * 3:
        text = list(stem)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(["", "A", "B", "EE"])
        rows.append((rng.choice("xy"), "".join(text)))
    rows += [("x", None), ("x", ""), ("x", "A"), ("x", "AB"), ("x", "ABA"), ("x", "AAAAAAAA"), ("x", "AAAAAAA")]
    got = {(r.block, r.a, r.b): round(r.score, 9) for r in names.similar_names(spark.createDataFrame(rows, "block string, key string"), ["block"], threshold=threshold, metric=metric).collect()}
    assert got == brute(rows, threshold, metric) and len(got) > 10


def test_candidates_of_a_large_block(spark):
    """20,000 names in one block: candidates follow the names, and some names are held against all others."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    keys = [f"{word(6)} {word(8)}" for _ in range(18_500)]
    keys = sorted({*keys, *(k[:4] + rng.choice("AEIOU") + k[5:] for k in keys[:1500])})
    frame = spark.createDataFrame([("all", k) for k in keys], "block string, key string")
    posted = names.rare_tokens(frame, ["block"], "key", 0.85).cache()
    shared = posted.groupBy("token").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert shared < 100 * len(keys)
    got = {(r.a, r.b) for r in names.similar_names(frame, ["block"]).collect()}
    assert len(got) >= 1300
    bags = {k: Counter(k) for k in keys}
    for a in keys[:30]:
        for b in keys:
            if a != b and 2 * sum((bags[a] & bags[b]).values()) >= 0.85 * (len(a) + len(b)):
                x, y = min(a, b), max(a, b)
                assert ((x, y) in got) == (MEASURES["ratio"](x, y) >= 0.85)


def test_no_names_and_thresholds(spark):
    frame = spark.createDataFrame([], "block string, key string")
    assert names.similar_names(frame, ["block"]).collect() == []
    with pytest.raises(ValueError):
        names.similar_names(frame.withColumn("key", F.lit("x")), ["block"], threshold=0.5)
