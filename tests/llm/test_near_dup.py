import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import near_dup as N
from ledgerloom.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (both and 100 * both >= 85 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), None if d is None else least[root(i)], d is None or d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(frame, **more):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame, **more).collect())


def family(rng, n_words, n_copies, edits):
    """Copies in a chain: each is an edited form of one made before."""
    made = [[f"w{rng.randint(0, 5000)}" for _ in range(n_words)]]
    while len(made) < n_copies:
        words = list(rng.choice(made[-3:]))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5000)}"
        made.append(words)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("block", [1 << 19, 4000])
def test_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(11)
    texts = [t for _ in range(4) for t in family(rng, rng.choice([60, 150]), 12, 2)] + family(rng, 100, 40, 3)
    texts += [texts[3].upper(), texts[3], " one two three ", "one two three", "ONE two\tthree four", None, "", " \n "]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[2]), (5, texts[60])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(frame) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows)
    assert N.near_duplicates(no_docs).collect() == []


def test_pruning_misses_as_rarely_as_asked():
    schedule = N.least_matches(0.85, 120, 24, 1e-6)
    assert schedule[-1][0] == 120 and [m for _, m in schedule] == sorted(m for _, m in schedule)
    rng = np.random.default_rng(0)
    left = np.zeros((20_000, 120), np.uint32)
    alike = (rng.random(left.shape) > 0.85).astype(np.uint32)
    apart = (rng.random(left.shape) > 0.5).astype(np.uint32)
    assert len(N.surviving(left, alike, schedule)) >= 19_990 and len(N.surviving(left, apart, schedule)) < 200


def test_signatures_estimate_similarity():
    a = " ".join(f"x{i}" for i in range(400))
    b = " ".join(f"x{i}" for i in range(60, 400))
    sets, offsets = N.shingle_sets(pa.array([a, b, ""]))
    rows = N.min_hashes(sets, offsets, 600)
    assert rows.shape == (2, 600) and abs((rows[0] == rows[1]).mean() - 336 / 396) < 0.06


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
