"""Counts and shares over records, errors and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C

MEASURED = ["name", "community", "sub_community", "building_cluster", "unit_number", "size", "plot_reg_no", "plot_number", "dmno", "dmsubno", "bedroom", "party_type", "pi_number", "mobile_1", "email_address", "nationality", "developer"]


def percent(part: Column, whole: Column) -> Column:
    """One decimal, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(1000 * part / whole + 0.5) / 10).otherwise(F.lit(0.0))


def status_counts(records: DataFrame, by: str = "status") -> DataFrame:
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top_values(records: DataFrame, column: str = "community", most: int = 10) -> DataFrame:
    """The most frequent values; equal counts in order of the value."""
    return records.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(most)


def completeness(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, percent): the share of rows that fill each column, all in one pass."""
    columns = columns or MEASURED
    counted = records.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), percent(F.col(c), F.col("_n")).alias("percent")) for c in columns])
    return counted.select(F.explode(pairs).alias("p")).select("p.*")


def success_rate(records: DataFrame, empty: float = 0.0) -> DataFrame:
    """One row: total, valid and their share; ``empty`` is the share of no rows."""
    counted = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "VALID").alias("valid"))
    return counted.select("total", "valid", F.when(F.col("total") > 0, percent(F.col("valid"), F.col("total"))).otherwise(F.lit(empty)).alias("success_rate"))


def totals(records: DataFrame, counters: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of corpus totals; duplicates both as records hold them and as run counters do."""
    r = records.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("status") == "VALID").alias("valid"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicate_records"))
    c = counters.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("duplicate"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"))
    e = errors.agg(F.count(F.lit(1)).alias("errors"))
    return r.crossJoin(c).crossJoin(e)  # one row each


def latest_jobs(jobs: DataFrame, most: int = 10) -> DataFrame:
    return jobs.orderBy(F.col("id").desc()).limit(most)


def error_breakdown(errors: DataFrame) -> DataFrame:
    """(by, value, n) for code, sheet (null: File Level) and severity, and the total, from one pass over grouping sets."""
    sheet = F.coalesce("source_sheet", F.lit("File Level"))
    rows = errors.select("code", sheet.alias("sheet"), "severity")
    sets = rows.groupingSets([["code"], ["sheet"], ["severity"], []], "code", "sheet", "severity").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    by = F.when(F.col("g") == 3, "code").when(F.col("g") == 5, "sheet").when(F.col("g") == 6, "severity").otherwise("total")
    return sets.select(by.alias("by"), F.coalesce(F.when(F.col("g") == 3, F.col("code")).when(F.col("g") == 5, F.col("sheet")).when(F.col("g") == 6, F.col("severity")), F.lit("all")).alias("value"), "n")


def top_errors(errors: DataFrame, most: int = 20) -> DataFrame:
    return top_values(errors, "code", most)


def property_grain(records: DataFrame) -> DataFrame:
    """One row a property: its owners counted, their distinct phones in order in three slots.

    A property's phones are reduced to distinct ones before they are gathered.
    """
    keyed = records.withColumn("property_key", C.property_key(F.col("community"), F.col("building_cluster"), F.col("unit_number"), F.col("plot_number"))).where("property_key IS NOT NULL")
    phones = keyed.where("mobile_1 IS NOT NULL").groupBy("property_key", "mobile_1").agg(F.min(F.struct("source_file", "source_row")).alias("at"))
    first = phones.groupBy("property_key").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "mobile_1"))), 1, 3), lambda p: p["mobile_1"]).alias("m"))
    people = keyed.groupBy("property_key").agg(F.count_distinct("name").alias("owner_count"), F.count(F.lit(1)).alias("n_records"))
    return people.join(first, "property_key", "left").select("property_key", "owner_count", "n_records", *[F.get("m", F.lit(i)).alias(f"mobile_{i + 1}") for i in range(3)])


def run_counters(records: DataFrame, by: str = "source_file") -> DataFrame:
    """Rows of each file by status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("total"), n("VALID"), n("INCOMPLETE"), n("DUPLICATE"), n("INVALID"))


def job_counters(raw_rows: DataFrame, sheets: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """run_counters of each file with total_rows, processed_rows, skipped_rows and error_count.

    Rows below a sheet's heading count: processed are the filled ones of record sheets; total adds all rows of reference and merged
    sheets; skipped are all rows that are no record (blank rows, repeated headings, rows about buildings, skipped sheets).
    ``sheets`` has source_file, source_sheet, header_row, targets, is_reference and merged; ``records`` holds INVALID ones too.
    """
    sheet = ["source_file", "source_sheet"]
    full = F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    body = raw_rows.join(sheets.select(*sheet, "header_row"), sheet).where("source_row > header_row").groupBy(*sheet).agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("filled"))
    kept = body.join(sheets.select(*sheet, (F.col("is_reference") | F.col("merged")).alias("passed"), (F.size("targets") > 0).alias("mapped")), sheet)
    processed = F.when(~F.col("passed") & F.col("mapped"), F.col("filled")).otherwise(0)
    seen = kept.groupBy("source_file").agg(F.sum("rows").alias("_rows"), F.sum(F.when(F.col("passed"), F.col("rows")).otherwise(processed)).alias("total_rows"), F.sum(processed).alias("processed_rows"))
    wrong = errors.groupBy("source_file").agg(F.count(F.lit(1)).alias("error_count"))
    out = seen.join(run_counters(records), "source_file", "left").join(wrong, "source_file", "left")
    counts = ("total", "valid", "incomplete", "duplicate", "invalid", "error_count")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.select("source_file", *counts[:-1], "total_rows", "processed_rows", (F.col("_rows") - F.col("total")).alias("skipped_rows"), "error_count")


def bulk_report(records: DataFrame) -> DataFrame:
    """Each file and all files together (ALL): rows, valid rows and distinct identities."""
    rolled = records.rollup("source_file").agg(F.grouping("source_file").alias("g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "VALID").alias("valid"), F.count_distinct("identity_hash").alias("identities"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("source_file")).alias("source_file"), "total", "valid", "identities")


def status_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(old status, new status, n) of two states of the records."""
    return before.select(key, F.col("status").alias("old")).join(after.select(key, F.col("status").alias("new")), key).groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))
