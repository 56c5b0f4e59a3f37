import random

import pytest

from ledgerloom.operators import indexes
from ledgerloom.operators.search import SEARCHED, Search, ordered, search

SCHEMA = ", ".join(["id long", "size double", "status string", *(f"{c} string" for c in SEARCHED)])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Records in twelve files, each with names of its own."""
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("records"))
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh"[i // 50 % 6 :] + "É") for _ in range(4)) for _ in range(3)]
        rows.append((i, rng.choice([None, 1.0, 2.0, float(rng.randint(0, 90))]), rng.choice(["VALID", "INVALID"]), " ".join(words).title(), *[None] * (len(SEARCHED) - 2), rng.choice([None, "P1", f"P{i}"])))
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(12, "id").write.parquet(f"{path}/t")
    indexes.write_trigrams(spark, f"{path}/t", f"{path}/i")
    return path


@pytest.mark.parametrize("text", ["abc", "ABCD", "h f", "é", "p1", "P12", "a_c", "bc%fg", "zzzz", "", None, "%", "hhé"])
def test_trigrams_find_what_a_scan_finds(spark, table, text):
    spec = Search(text=text, status="ALL")
    ids = lambda rows: sorted(r.id for r in rows.select("id").collect())
    assert ids(indexes.indexed_search(spark, f"{table}/t", f"{table}/i", spec)) == ids(search(spark.read.parquet(f"{table}/t"), spec))


def test_fewer_files_are_read(spark, table):
    assert len(spark.read.parquet(f"{table}/t").inputFiles()) == 12
    read = indexes.indexed_search(spark, f"{table}/t", f"{table}/i", Search(text="abc", status="ALL")).inputFiles()
    assert 0 < len(read) < 12 and indexes.files_with(spark, f"{table}/i", "ab") is None and indexes.files_with(spark, f"{table}/i", "zzz") == []


@pytest.mark.parametrize("descending", [True, False])
def test_pages_by_ordinals(spark, table, tmp_path, descending):
    records, spec = spark.read.parquet(f"{table}/t"), Search(status="VALID", sort="size", descending=descending)
    indexes.write_ordinals(records, spec, str(tmp_path), ranges=7)
    want = [r.id for r in ordered(search(records, spec), spec).select("id").collect()]
    got = []
    for number in range(1, len(want) // 40 + 2):
        page = indexes.page_at(records, spec, str(tmp_path), number, 40).select("rank", "id").collect()
        got += [r.id for r in sorted(page)]
        assert sorted(r.rank for r in page) == list(range(40 * number - 39, 40 * number - 39 + len(page)))
    assert got == want
    assert indexes.page_at(records, spec, str(tmp_path), 10_000, 40).count() == 0


def test_no_top_k_on_the_driver(spark, table, tmp_path):
    records, spec = spark.read.parquet(f"{table}/t"), Search(status="ALL", sort="id")
    indexes.write_ordinals(records, spec, str(tmp_path), ranges=10)
    plan = indexes.page_at(records, spec, str(tmp_path), 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "PartitionFilters: [range" in plan.replace("isnotnull(range", "range")


def test_no_records(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/t")
    indexes.write_trigrams(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    assert indexes.indexed_search(spark, f"{tmp_path}/t", f"{tmp_path}/i", Search(text="abc")).collect() == []
