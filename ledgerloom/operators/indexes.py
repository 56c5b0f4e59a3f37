"""Indexes beside a stored record table: trigrams for substring search, ordinals for deep pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.search import SEARCHED, SORTABLE, Search, search


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) > 2, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def write_trigrams(spark: SparkSession, table: str, index: str, columns: tuple[str, ...] = tuple(SEARCHED)) -> None:
    """Index a Parquet record table: ``index``/postings holds the files in which each trigram of the columns occurs, ``index``/files their paths.

    A posting is a sorted list of file numbers, as long as the table has files at most. Postings are sorted by trigram, so that a search reads a few row groups.
    """
    rows = spark.read.parquet(table)
    paths = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    files = paths.withColumn("file", F.row_number().over(Window.orderBy("path")))  # one row a file
    files.write.mode("overwrite").parquet(f"{index}/files")
    held = F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[_trigrams(F.col(c).cast("string")) for c in columns])))))
    pairs = rows.select(F.col("_metadata.file_path").alias("path"), held.alias("trigram")).distinct()
    numbered = pairs.join(F.broadcast(spark.read.parquet(f"{index}/files")), "path")  # a row a file
    postings = numbered.groupBy("trigram").agg(F.array_sort(F.collect_list("file")).alias("files"))
    postings.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{index}/postings")


def files_with(spark: SparkSession, index: str, text: str) -> list[str] | None:
    """The files that hold all trigrams of ``text``; None where it has none, so that all files may match. % and _ stand for any text, as in LIKE."""
    wanted = sorted({piece[i : i + 3] for piece in re.split("[%_]", text.lower()) for i in range(len(piece) - 2)})
    if not wanted:
        return None
    found = spark.read.parquet(f"{index}/postings").where(F.col("trigram").isin(wanted)).select(F.explode("files").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    return sorted(r["path"] for r in found.join(spark.read.parquet(f"{index}/files"), "file").select("path").collect())  # file names


def indexed_search(spark: SparkSession, table: str, index: str, spec: Search) -> DataFrame:
    """The rows that :func:`search` finds in the table, read from the files that can hold them. The index must be of the table as it is, and of all columns searched."""
    rows = spark.read.parquet(table)
    chosen = files_with(spark, index, spec.text) if spec.text else None
    if chosen is None:
        return search(rows, spec)
    if not chosen:
        return rows.where(F.lit(False))
    return search(spark.read.schema(rows.schema).option("basePath", table).parquet(*chosen), spec)


def write_ordinals(records: DataFrame, spec: Search, index: str, *, ranges: int = 64) -> None:
    """Index the order of a search: ids in ranges of the order (``index``/rows, a folder a range), and rows before each range (``index``/counts)."""
    by = F.col(spec.sort if spec.sort in SORTABLE else "id")
    keys = search(records, spec).select(F.col("id"), by.alias("_by"))
    order = [F.col("_by").isNull(), F.col("_by").desc_nulls_last() if spec.descending else F.col("_by").asc_nulls_last(), F.col("id").desc()]
    placed = keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy("range").parquet(f"{index}/rows")
    counts = records.sparkSession.read.schema("id long, range int").parquet(f"{index}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    counts.select("range", "n", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before")).write.mode("overwrite").parquet(f"{index}/counts")  # a row a range


def page_at(records: DataFrame, spec: Search, index: str, number: int, size: int) -> DataFrame:
    """(rank, the records' columns) of one page, by an index of :func:`write_ordinals`: only the ranges that hold the page are read and ranked, however deep it lies. A page past the end is empty."""
    spark = records.sparkSession
    first = (max(1, number) - 1) * size
    held = spark.read.parquet(f"{index}/counts").where((F.col("before") < first + size) & (F.col("before") + F.col("n") > first)).collect()  # the ranges of one page
    begins = {r["range"]: r["before"] for r in held}
    rows = spark.read.parquet(f"{index}/rows").where(F.col("range").isin(*begins) if begins else F.lit(False))
    order = Window.partitionBy("range").orderBy(F.col("_by").desc_nulls_last() if spec.descending else F.col("_by").asc_nulls_last(), F.col("id").desc())
    before = F.coalesce(*[F.when(F.col("range") == k, F.lit(v)) for k, v in begins.items()], F.lit(0))
    ranked = rows.withColumn("rank", (before + F.row_number().over(order)).cast("bigint")).where((F.col("rank") > first) & (F.col("rank") <= first + size)).select("id", "rank")
    return records.join(F.broadcast(ranked), "id")  # a page
