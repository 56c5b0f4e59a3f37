"""Write records, exports and audits."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.search import Search, ordered, search

EXPORT_ROWS, MOST_EXPORT_ROWS = 50_000, 100_000

# Headings of an export, in order, and the columns below them.
EXPORT = {
    "ID": "id", "Name": "name", "Community": "community", "Sub-Community": "sub_community", "Building/Cluster": "building_cluster", "Unit Number": "unit_number", "Size (sq.ft)": "size",
    "Plot Reg. No": "plot_reg_no", "Plot Number": "plot_number", "DMNO": "dmno", "DMsubno": "dmsubno", "Bedroom": "bedroom", "Party Type": "party_type", "PI Number": "pi_number",
    "Mobile 1": "mobile_1", "Mobile 2": "mobile_2", "Mobile 3": "mobile_3", "Email Address": "email_address", "Nationality": "nationality", "Property Type": "property_type",
    "Developer": "developer", "Project": "project", "Date": "record_date", "Procedure Value": "procedure_value", "Status": "status", "Source File": "source_file",
}


def write_records(records: DataFrame, path: str, *, replace: bool = False, parts: tuple[str, ...] = ("source_file",)) -> None:
    """Append to the record table, or replace the ``parts`` (files, by default) that the records belong to; both in one atomic job."""
    writer = records.write.partitionBy(*parts)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def export_rows(records: DataFrame, spec: Search, limit: int = EXPORT_ROWS) -> DataFrame:
    """The matches in order under the export's headings: missing values empty, dates as yyyy-MM-dd. The limit is a feature of exports."""
    limit = max(1, min(limit, MOST_EXPORT_ROWS))
    rows = ordered(search(records, spec), spec).limit(limit)
    text = lambda c: F.date_format(c, "yyyy-MM-dd") if c == "record_date" else F.col(c).cast("string")
    return rows.select(*[F.coalesce(text(c), F.lit("")).alias(h) for h, c in EXPORT.items()])


def export_csv(records: DataFrame, spec: Search, path: str, *, limit: int = EXPORT_ROWS) -> None:
    export_rows(records, spec, limit).write.option("header", True).option("emptyValue", "").csv(path)


def audit_row(spark: SparkSession, spec: Search, *, user: str, fmt: str, row_count: int, at: datetime | None = None) -> DataFrame:
    """One row for the export log: who took what in which format, how many rows, when."""
    filters = json.dumps({k: v for k, v in asdict(spec).items() if v not in (None, ())}, sort_keys=True)
    return spark.createDataFrame([(user, fmt, filters, row_count, at or datetime.now(timezone.utc))], "user string, export_format string, filters string, row_count long, exported_at timestamp")


def write_developments(developments: DataFrame, path: str) -> None:
    """Reference developments as JSON lines; null fields are left out."""
    developments.drop("ord").write.json(path)
