"""Synthetic registers."""

from pyspark.sql import functions as F

from ledgerloom.plans import catalogue, views


def test_a_register_of_one_small_file_is_cleaned_by_several_tasks(spark):
    rows = views.register(spark, "/root/testdata/sf0.001")
    held = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in held) == 180


def test_edit_values_are_cleaned_by_several_tasks(spark):
    rows = catalogue.QUERIES["edit_values"](spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
