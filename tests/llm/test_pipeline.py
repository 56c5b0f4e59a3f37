import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from ledgerloom.llm.decontaminate import item_words
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_tokens import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and what comes out of the last."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_of_documents_stay(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    for rows in stages[1:-1]:
        assert rows and list(rows[0].asDict()) == names and all(r.n_chars == len(r.text) for r in rows)


def test_classifier_drops_low_quality_only(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = by_id(stages[1])
    wrong = [d for d, q in labels.items() if (d in left) != bool(q)]
    assert len(left) < len(stages[0]) and len(wrong) <= 0.05 * len(labels)
    assert all(left[d] == r for d, r in by_id(stages[0]).items() if d in left)


def test_lines(stages):
    want = {d: text for d, _, _, text in lines_brute([(r.doc_id, r.text) for r in stages[1]])}
    assert {r.doc_id: r.text for r in stages[2]} == want


def test_one_of_each_group_stays(stages):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {r.doc_id: shingles(r.text) for r in stages[2]}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert {r.doc_id for r in stages[3]} == {d for d, g in group.items() if d == g}
    before = by_id(stages[2])
    assert all(before[r.doc_id] == r for r in stages[3])


def test_no_window_is_left(spark, stages):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = item_words(r.text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[len(words[i : i + 10])].add(tuple(words[i : i + 10]))

    def dirty(text):
        words = item_words(text)
        return any(tuple(words[i : i + n]) in own for n, own in windows.items() for i in range(len(words) - n + 1))

    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys() and any(dirty(r.text) for r in before.values())
    for d, r in before.items():
        assert after[d] == r if not dirty(r.text) else not dirty(after[d].text)


def test_packed_ids(stages):
    total = defaultdict(int)
    for r in stages[5]:
        total[r.doc_id] += r.length
        assert r.length <= 4096 and r.offset + r.length <= 4096
    assert total == {r.doc_id: len(plain("word_bpe_49k.json", r.text)) + 1 for r in stages[4]}


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, stages[5]))


def test_odd_rows_go_through(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == odd_docs.columns
        assert (docs.count() > 0) == (name == "odd")
