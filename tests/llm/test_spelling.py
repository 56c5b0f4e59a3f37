import random
import re
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, every=199, least_chars=6, least_count=5, ratio=5):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}

    def near(w, v):
        if len(w) == len(v):
            return sum(x != y for x, y in zip(w, v)) == 1
        w, v = sorted((w, v), key=len)
        return len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))

    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    found = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, n[w], len(found[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def got(frame, **more):
    return Counter((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(frame, **more).collect())


def edited(rng, word):
    at, kind = rng.randrange(len(word)), rng.choice("idr")
    letter = rng.choice("abcé÷")
    return word[:at] + (letter + word[at:] if kind == "i" else word[at + 1 :] if kind == "d" else letter + word[at + 1 :])


def register(rng, n_docs):
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += ["anti" * 6 + x for x in ("", "a", "b", "ab")] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ééé" * 3, "ÉÉÉ" * 3]
    weights = [rng.choice([1, 2, 30]) for _ in words]
    rows = []
    for d in range(n_docs):
        chosen = rng.choices(words, weights, k=80)
        text = " ".join(edited(rng, w) if rng.random() < 0.3 else rng.choice([w, w.upper(), w.capitalize()]) for w in chosen)
        rows.append((d, re.sub(" ", lambda _: rng.choice([" ", ", ", "\n", "'", "7", "日"]), text)))
    return rows


@pytest.mark.parametrize("every", [199, 7])
def test_equal_brute_force(spark, every):
    rows = register(random.Random(every), 60)
    rows += [(3, None), (None, rows[0][1]), (5, ""), rows[0], rows[0], (9999, "chainword " * 200 + "chainwort " * 30 + "chainwortt " * 5)]
    expected = brute(rows, every)
    assert sum(1 for w in expected if w[3]) > 20 and any(w[5] not in (w[0], w[3]) for w in expected)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), every=every) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    expected = brute([(r.doc_id, r.text) for r in odd_docs.collect()], least_chars=4, least_count=2)
    assert got(odd_docs, least_chars=4, least_count=2) == expected and expected
    assert got(no_docs) == Counter()
    assert got(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")) == Counter()


def test_long_words_take_few_rounds(spark):
    """Rounds follow the partings of a path: words of thousands of letters need no round for each letter."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef") for _ in range(4000))
    forms = [base, base[:10] + "x" + base[10:], base[:3990] + "y" + base[3991:], base[:2000] + base[2001:], base + "z", "q" + base]
    rows = [(i, f"{base} {base} " + forms[i % 6]) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hot_prefixes(spark, monkeypatch):
    """A third of all words share the first letters: their node is joined on its own."""
    monkeypatch.setattr(spelling, "hot_keys", lambda sized, n="n", total=None: sized.where(f"{n} > 3").drop(n))
    rng = random.Random(9)
    words = ["prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(20)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_tables_that_grow_with_the_input_are_not_broadcast(spark, monkeypatch):
    """Only tables of hot keys, which are bounded, are sent to the driver; their joins are on nodes."""
    plans, plain = [], spelling.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "written", lambda df: plans.append(plan(df)) or plain(df))
    rows = register(random.Random(3), 20)
    out = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(plan(out))
    assert Counter((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in out.collect()) == brute(rows)
    assert [p for p in plans if re.search(r"BroadcastHashJoin \[(?!node)", p)] == []
    hot = [p for p in plans if "BroadcastHashJoin [node" in p]
    assert len(hot) > 2 and all("SortMergeJoin [node" in p for p in hot)
