"""Edits of stored records."""

from pyspark.sql import functions as F

from ledgerloom.operators import maintain


def test_no_record_table_is_broadcast_for_edits(spark):
    records = spark.range(40).select("id", *[F.lit("x").alias(c) for c in maintain.EDITABLE])
    edits = spark.createDataFrame([(1, "name", "Jane Doe", 1), (1, "name", "Ann Lee", 2), (2, "developer", "x", 1), (3, "project", None, 1), (99, "name", "Li Wu", 1)], "record_id long, field string, value string, ord long")
    found = maintain.changes(records, edits)
    assert sorted(found.collect()) == [(1, "name", "x", "Ann Lee"), (3, "project", "x", None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
