import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(items, linked):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    of = joined(prints, lambda x, y: x[0] is not None and y[0] is not None and (x[0] == y[0] or (x[1] ^ y[1]).bit_count() <= 4))
    least = {}
    for (d, _), r in zip(prints, of):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, f"{f:016x}", None if d is None else least[r]) for (d, f), r in zip(prints, of))


def got(frame, **more):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(frame, **more).collect())


def near_copies(rng, n_words, n_copies):
    words, out = [f"w{rng.randint(0, 900)}" for _ in range(n_words)], []
    for _ in range(n_copies):
        words[rng.randrange(n_words)] = f"W{rng.randint(0, 900)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("part", [8192, 3])
def test_equal_brute_force(spark, part):
    rng = random.Random(part)
    texts = [t for _ in range(12) for t in near_copies(rng, rng.choice([30, 80, 200]), 12)] + ["", None, "a", "A", "one two three", "one two three four"]
    rows = [(rng.randint(0, 400), t) for t in texts]
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len({d for d, _ in rows})
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), part=part) == expected


def test_odd_rows(odd_docs, no_docs):
    assert got(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert got(no_docs) == Counter()


@pytest.mark.parametrize("n", [10, 1 << 23, 1 << 33])
def test_masks_lose_no_pair(n):
    """Any four differing bits leave all bits of some mask equal."""
    chosen, rng = np.array(simhash.masks(n, 4), np.int64).view(np.uint64), random.Random(n)
    for _ in range(3000):
        differ = np.uint64(sum(1 << b for b in rng.sample(range(64), 4)))
        assert ((chosen & differ) == 0).any()


@pytest.mark.parametrize("part", [8192, 7])
def test_links_of_dense_prints(spark, part):
    """Chains, stars and far groups of fingerprints; parts of a bucket meet each other."""
    rng = random.Random(2)
    prints = []
    for _ in range(5):
        now = rng.getrandbits(64)
        for _ in range(40):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                now ^= 1 << b
            prints.append(now)
    prints = sorted(set(prints))
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)]
    links = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(rows, "rep long, fp long"), 4, part).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in links)
    numbers = list(range(len(prints)))
    same = lambda of: {frozenset(i for i in numbers if of[i] == r) for r in of}
    assert same(joined(numbers, lambda i, j: (i, j) in links or (j, i) in links)) == same(joined(numbers, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4))


def test_groups_give_spanning_links_only():
    prints = np.array([1 << (i % 64) for i in range(64)] + [0], np.uint64)
    assert len(simhash.spanning(prints, 4)) == 64
