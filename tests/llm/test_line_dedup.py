import random
from collections import defaultdict

import pytest

from ledgerloom.llm.line_dedup import dedup_lines


def brute(rows, least_chars=20, least_docs=3):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[strip(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(k := strip(x)) < least_chars or len(docs[k]) < least_docs or i == max(docs[k], key=lambda d: -1 if d is None else d)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(frame, **more):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(frame, **more).collect()), key=str)


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_equal_brute_force(spark, batch):
    rng = random.Random(4)
    pool = ["  The common line of many documents\t", "the COMMON line of many documents", "short", "", "é" * 20, "Ünïcödé line with twenty codes", *(f"line number {i} of the pool, long" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(pool[: 3 + i % 33]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(i, "the common line of many documents\nown line of document number %d" % i) for i in range(200, 320)]
    rows += [(5, None), (6, "the common line of many documents"), (6, "the common line of many documents"), (None, "the common line of many documents"), (None, None), (None, "another null id, line number 3 of the pool, long")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert got(frame) == brute(rows)
        assert got(frame, least_chars=1, least_docs=2) == brute(rows, 1, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(odd_docs, odd_texts, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows)
    assert dedup_lines(odd_docs).select("row.*").columns == odd_docs.columns
    assert dedup_lines(no_docs).collect() == []
