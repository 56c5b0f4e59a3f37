"""Each query against its SQL twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ledgerloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted([tuple(tidy(r[i]) if r[i] is not None else None for i in order) for r in values], key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_its_twin(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["header_row_detect", "sheet_profile", "near_dup_ratio", "enrich_fill"])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_excluded_headings_never_reach_the_data(spark):
    out = catalogue.QUERIES["map_columns"](spark, SF)
    assert out.where("extras LIKE '%X1234%' OR name LIKE '%X1234%'").count() == 0


def test_stored_records_follow_their_tables(spark, tmp_path):
    """Replacing a table under the same path is noticed."""
    for name in ("customer", "nation"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    whole = catalogue.records(spark, str(tmp_path)).count()
    assert catalogue.records(spark, str(tmp_path)).inputFiles() == catalogue.records(spark, str(tmp_path)).inputFiles()
    spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 20").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    assert 0 < catalogue.records(spark, str(tmp_path)).count() < whole
