"""The whole normalisation: raw rows to records, errors and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators import dedup, enrich, mapping, quality, stats
from ledgerloom.sources.shared import spread, written


def records_of(mapped: DataFrame, *, developments: DataFrame | None = None, known: DataFrame | None = None, scope: str = "file", near: bool = True, metric: str = "ratio") -> DataFrame:
    """Mapped text rows as classified records (INVALID ones too): enrich, clean, validate, find exact and near duplicates, classify.

    Cleaned rows are written once to the shared folder, and so are the rows after the exact duplicates: the steps after them look at their rows
    several times, and the chain of cleaning expressions would stand in the plan once for each look.
    """
    rows = enrich.enrich(mapped, developments) if developments is not None else mapped
    return judged(written(identified(rows)), known=known, scope=scope, near=near, metric=metric)


def identified(mapped: DataFrame) -> DataFrame:
    """Mapped text rows cleaned, validated and with their identity: row by row, so for streams too."""
    return dedup.with_identity(quality.validate(quality.standardise(mapped)))


def judged(checked: DataFrame, *, known: DataFrame | None = None, scope: str = "file", near: bool = True, metric: str = "ratio") -> DataFrame:
    """Rows of :func:`identified` as classified records: find exact and near duplicates, classify."""
    rows = dedup.exact_duplicates(checked, scope=scope, known=known)
    if near:
        rows = dedup.near_duplicates(written(rows), metric=metric)
    return quality.classify(rows)


def normalise(raw_rows: DataFrame, aliases: DataFrame, *, developments: DataFrame | None = None, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, errors, counters) of raw rows from any number of files and sheets; each step is written to the shared folder and read by the next.

    Headers are found, columns planned, owner sheets joined with property sheets by PI number, and reference sheets and merged
    property sheets left out. Records are VALID, INCOMPLETE or DUPLICATE; INVALID rows are errors.
    """
    known_headers = mapping.known_headings([r["header_norm"] for r in aliases.select("header_norm").distinct().collect()])  # a table of header names
    headers = written(mapping.header_rows(raw_rows, known_headers))
    seen = written(mapping.samples(raw_rows, headers))
    bare = mapping.positional_headers(raw_rows, headers, seen)
    headers = written(headers.join(bare.withColumnRenamed("header", "_positional"), mapping.SHEET, "left").select(*mapping.SHEET, "header_row", F.coalesce("header", "_positional").alias("header")))
    plan = written(mapping.plan_columns(headers, aliases, seen=seen))
    sheets = mapping.sheet_profile(raw_rows, headers, plan)
    has_owner = F.bool_or(F.col("role") == "owner").over(Window.partitionBy("source_file"))  # a row a sheet
    sheets = written(sheets.withColumn("merged", has_owner & (F.col("role") == "property")))
    mapped = mapping.map_columns(raw_rows, plan, headers).join(sheets.select(*mapping.SHEET, "role", "is_reference", "merged"), mapping.SHEET).where("NOT is_reference")
    mapped = written(quality.settled(mapped).where(~mapping.is_building_row(F.col("unit_number"), F.col("extras"))))
    places = ("building_cluster", "unit_number", "sub_community", "project", "community", "size", "bedroom", "plot_number", "developer", "property_type")
    owners = enrich.merge_properties(mapped.where("NOT merged"), mapped.where("merged"), places)
    rows = spread(enrich.enrich(owners, developments) if developments is not None else owners, "source_row", n=mapped.count())  # as sheets differ, and so does what a written part of them costs
    records = written(records_of(rows, **more).drop("role", "is_reference", "merged"))
    errors = quality.error_rows(records).unionByName(quality.sheet_errors(sheets)).unionByName(quality.join_notes(mapped.where("merged")))
    return records.where("status <> 'INVALID'"), errors, stats.job_counters(raw_rows, sheets, records, errors)
