import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontaminate as D


def brute(texts, items, window):
    """(n_words, hit words, item names) of each text, by comparing every window at every place."""
    out = []
    for text in texts:
        words = D.item_words(text)
        hit, names = set(), set()
        for name, body in items:
            own = D.item_words(body)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i : i + window]
                for at in range(len(words) - len(part) + 1):
                    if words[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        names.add(name)
        out.append((len(words), len(hit), sorted(names)))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    word = lambda: rng.choice("Alpha beta gamma delta 7 é-ü x".split())
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 3, 10, 12, 30])))) for i in range(4, 16)] + [("16", ""), ("17", " ,. "), ("18", "beta beta beta beta beta beta beta beta beta beta beta beta")]
    texts = [None, "", " . ", "beta " * 40]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(1, rng.choice(items)[1].upper())
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return texts, items


@pytest.mark.parametrize("window", [1, 3, 10])
def test_windows_equal_brute_force(case, window):
    texts, items = case
    n_words, spans, names = D.Phrases(items, window).find(pa.array([t or "" for t in texts]))
    got = [(int(n), sum(b - a for a, b in s), i) for n, s, i in zip(n_words, spans, names)]
    assert got == brute(texts, items, window)


def test_index_ranks_and_places():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 6, 500)
    symbols[-1] = 0
    index = D.FMIndex(symbols, 5)
    for n in (1, 2, 3):
        phrases = np.array(sorted({tuple(symbols[i : i + n]) for i in range(500 - n) if (symbols[i : i + n] > 0).all()}))
        alive, low, high = index.ranges(phrases)
        assert len(alive) == len(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(501 - n) if (symbols[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block,scan", [(D.BLOCK_BYTES, 8), (100, 8), (2000, 2)])
def test_query_over_odd_documents(spark, odd_docs, odd_texts, block, scan):
    items = [(3, odd_texts[30]), (12, odd_texts[31]), (100, "line one"), (101, None), (None, "a"), (12, "the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(odd_docs, bench, window=10, block_bytes=block, blocks_a_scan=scan).collect()
    want = brute(odd_texts, [(str(i), t) for i, t in items if i is not None and t], 10)
    assert len(rows) == len(odd_texts) + 4
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id] and r.contaminated == (r.n_hit > 0)
    assert sum(r.contaminated for r in rows) >= 4


def test_spans_leave_the_text(spark):
    rows = spark.createDataFrame([("Keep this, one TWO three. End", [(2, 5)]), ("one", [(0, 1)]), (None, None), ("all clean", [])], "text string, spans array<struct<start: long, stop: long>>")
    assert [r[0] for r in rows.select(D.without_spans(rows.text, rows.spans)).collect()] == ["Keep this, \n. End", "\n", None, "all clean"]


def test_no_rows(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(no_docs, none).collect() == []
    assert not any(r.contaminated for r in D.contamination(odd_docs, none).collect())
