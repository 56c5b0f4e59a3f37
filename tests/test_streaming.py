"""A stream of register files, held against its own rule and against a failed batch."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import views
from ledgerloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def people(spark):
    return views.register(spark, SF).drop("k", "copy")


def arrive(spark, root, name, rows):
    rows.coalesce(1).write.parquet(f"{root}/in/{name}")


def run(spark, root, schema):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    query = ingest.ingest_stream(rows, f"{root}/records", f"{root}/state", counters=f"{root}/counters", totals=f"{root}/totals")
    query.awaitTermination()
    return query


def test_identities_of_earlier_batches_are_duplicates(spark, tmp_path):
    rows = people(spark).where("source_row < 60")
    renamed = rows.withColumn("source_file", F.lit("again.csv"))
    arrive(spark, tmp_path, "a", rows)
    first = run(spark, tmp_path, rows.schema)
    arrive(spark, tmp_path, "b", renamed)
    arrive(spark, tmp_path, "c", renamed.where("source_row < 10").withColumn("source_file", F.lit("third.csv")))
    second = run(spark, tmp_path, rows.schema)
    records = spark.read.parquet(f"{tmp_path}/records")
    # brute force: a valid row whose identity a valid row of an earlier batch had
    found, known = records.select("batch_id", "identity_hash", "is_valid", "status").collect(), {}
    for r in found:
        if r.is_valid:
            known[r.identity_hash] = min(known.get(r.identity_hash, 99), r.batch_id)
    repeated = [r for r in found if r.is_valid and known[r.identity_hash] < r.batch_id]
    assert len(repeated) >= 60 and all(r.status == "DUPLICATE" for r in repeated)
    assert {r.batch_id for r in found} == {0, 1, 2} and len(found) == records.select("source_file", "source_row").distinct().count()
    # the totals that were observed are those of the table
    totals = {r.batch_id: (r.total, r.valid, r.incomplete, r.duplicate, r.invalid) for r in spark.read.parquet(f"{tmp_path}/totals").collect()}
    table = records.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ingest.STATUSES]).collect()
    assert totals == {r.batch_id: (r.n, *[r[s] for s in ingest.STATUSES]) for r in table}
    files = spark.read.parquet(f"{tmp_path}/counters").groupBy("batch_id").agg(F.sum("total").alias("total"), F.sum("duplicate").alias("duplicate")).collect()
    assert {r.batch_id: (r.total, r.duplicate) for r in files} == {b: (t[0], t[3]) for b, t in totals.items()}
    # progress tells what arrived; state holds each valid identity once
    seen = {p["batchId"]: (p["observedMetrics"]["arrived"]["rows"], p["observedMetrics"]["arrived"]["valid"]) for q in (first, second) for p in q.recentProgress if p["numInputRows"]}
    valid = {r.batch_id: r.n for r in records.groupBy("batch_id").agg(F.count_if("is_valid").alias("n")).collect()}
    assert seen == {b: (t[0], valid[b]) for b, t in totals.items()}
    assert second.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == len(known)


def test_a_failed_batch_finds_the_state_that_it_found_before(spark, tmp_path, monkeypatch):
    rows = people(spark).where("source_row < 30")
    arrive(spark, tmp_path, "a", rows)
    with monkeypatch.context() as broken:
        broken.setattr(ingest, "write_records", lambda *a, **k: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            run(spark, tmp_path, rows.schema)
    run(spark, tmp_path, rows.schema)
    records = spark.read.parquet(f"{tmp_path}/records")
    assert records.count() == rows.count()
    # the identities that the failed try had put down do not make its own rows duplicates
    valid = records.where("is_valid")
    assert valid.where("status <> 'DUPLICATE'").count() > 0
    assert valid.where("duplicate_flag IS NULL OR duplicate_flag <> 'duplicate_identity_hash'").select("identity_hash").distinct().count() == valid.select("identity_hash").distinct().count()


def test_an_identity_that_most_rows_share(spark, tmp_path):
    one = people(spark).where("source_row = 3").drop("source_row")
    rows = spark.range(3000).select(F.col("id").alias("source_row")).crossJoin(one).select(*people(spark).columns)  # one row by 3000
    arrive(spark, tmp_path, "a", rows.where("source_row < 1500"))
    arrive(spark, tmp_path, "b", rows.where("source_row >= 1500"))
    run(spark, tmp_path, rows.schema)
    records = spark.read.parquet(f"{tmp_path}/records")
    assert [r[0] for r in records.where("status <> 'DUPLICATE'").select("source_row").collect()] in ([0], [1500])


def test_a_batch_is_judged_with_adaptive_planning(spark, tmp_path, monkeypatch):
    rows, seen = people(spark).where("source_row < 10"), []
    monkeypatch.setattr(ingest, "_append", lambda checked, *a: seen.append((checked.sparkSession.conf.get("spark.sql.adaptive.enabled"), checked.count())))
    arrive(spark, tmp_path, "a", rows)
    run(spark, tmp_path, rows.schema)
    assert seen == [("true", rows.count())]
