"""Search, filter, sort and page records; facets and histories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C

SEARCHED = ["name", "mobile_1", "mobile_2", "mobile_3", "email_address", "community", "sub_community", "building_cluster", "unit_number", "project", "developer", "pi_number", "plot_number"]
SORTABLE = ["id", "name", "community", "sub_community", "building_cluster", "unit_number", "size", "bedroom", "developer", "nationality", "record_date", "procedure_value", "status"]
FACETS = ["community", "sub_community", "building_cluster", "bedroom", "developer", "nationality", "source_file"]
PAGE, LARGEST_PAGE = 50, 500


@dataclass(frozen=True)
class Search:
    """What to look for. Empty fields filter nothing; status ALL (or ANY, *) takes every status."""

    text: str | None = None
    equals: tuple[tuple[str, str], ...] = ()
    status: str | None = "VALID"
    property_type: str | None = None
    job_id: int | None = None
    has_mobile: bool | None = None
    has_email: bool | None = None
    sort: str = "id"
    descending: bool = True
    columns: tuple[str, ...] = ()  # those that the text is looked for in; none: all of SEARCHED


def matches(spec: Search) -> Column:
    tests = [F.lit(True)]
    if spec.text:
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{spec.text}%"), F.lit(False)) for c in spec.columns or SEARCHED]))
    for column, value in spec.equals:
        if column not in FACETS:
            raise ValueError(f"no filter on {column}")
        tests.append(F.col(column) == value)
    status = (spec.status or "ALL").upper()
    if status in ("INCOMPLETE", "MISSING_CONTACT"):
        tests.append(F.col("status") == "INCOMPLETE")
    elif status not in ("ALL", "ANY", "*"):
        tests.append(F.col("status") == status)
    if spec.property_type:
        tests.append(F.col("property_type").ilike(spec.property_type))
    if spec.job_id is not None:
        tests.append(F.col("job_id") == spec.job_id)
    for wanted, column in ((spec.has_mobile, "mobile_1"), (spec.has_email, "email_address")):
        if wanted is not None:
            tests.append(F.col(column).isNotNull() if wanted else F.col(column).isNull())
    return reduce(lambda a, b: a & b, tests)


def search(records: DataFrame, spec: Search) -> DataFrame:
    """Records that match, unsorted; filters on plain columns reach the Parquet scan."""
    return records.where(matches(spec))


def ordered(rows: DataFrame, spec: Search) -> DataFrame:
    """Sorted by a column that may be sorted by (else by id), nulls last both ways, then by id downwards."""
    by = F.col(spec.sort if spec.sort in SORTABLE else "id")
    return rows.orderBy(by.desc_nulls_last() if spec.descending else by.asc_nulls_last(), F.col("id").desc())


def page(records: DataFrame, spec: Search, number: int = 1, size: int = PAGE) -> DataFrame:
    """One page of the matches in order; Spark keeps only the rows up to the page's end."""
    size = max(1, min(size, LARGEST_PAGE))
    return ordered(search(records, spec), spec).offset((max(1, number) - 1) * size).limit(size)


def page_counts(records: DataFrame, spec: Search, number: int = 1, size: int = PAGE) -> DataFrame:
    """One row: total, page, page_size, total_pages, has_next, has_prev."""
    total = search(records, spec).agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size).cast("bigint")
    return total.select("total", F.lit(number).cast("bigint").alias("page"), F.lit(size).cast("bigint").alias("page_size"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def record(records: DataFrame, record_id: int) -> DataFrame:
    return records.where(F.col("id") == record_id)


def facets(records: DataFrame, most: int = 500) -> DataFrame:
    """(field, value): the first ``most`` values of each facet in order; communities cleaned of sheet titles first.

    One pass: each row gives its facets, distinct pairs are found by a partial aggregate, then ranked inside a field.
    """
    from pyspark.sql.window import Window

    values = F.array(*[F.struct(F.lit(c).alias("field"), (C.clean_community(F.col(c)) if c == "community" else F.col(c)).alias("value")) for c in FACETS])
    pairs = records.select(F.explode(values).alias("f")).select("f.*").where("value IS NOT NULL").distinct()
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("value"))).where(F.col("n") <= most).drop("n")


def jobs_page(jobs: DataFrame, *, status: str | None = None, number: int = 1, size: int = PAGE) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.col("id").desc()).offset((number - 1) * size).limit(size)


def with_file_names(jobs: DataFrame, source_files: DataFrame) -> DataFrame:
    """Jobs with the name of the file that each of them reads."""
    return jobs.join(source_files.select(F.col("id").alias("source_file_id"), "filename"), "source_file_id", "left")


def errors_page(errors: DataFrame, job_id, *, severity: str | None = None, number: int = 1, size: int = PAGE) -> DataFrame:
    rows = errors.where(F.col("job_id") == job_id)
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    return rows.orderBy("id").offset((number - 1) * size).limit(size)


def edit_history(edits: DataFrame, record_id) -> DataFrame:
    return edits.where(F.col("record_id") == record_id).orderBy(F.col("edited_at").desc(), F.col("field"))


def wire_names(records: DataFrame) -> DataFrame:
    """Records under the names that callers of the record service know; sizes are square feet."""
    return records.withColumns({"bedroom_type": F.col("bedroom"), "mobile": F.col("mobile_1"), "record_status": F.col("status"), "size_display": F.when(F.col("size").isNotNull(), F.concat(F.format_number("size", 2), F.lit(" sq.ft")))})


def job_progress(jobs: DataFrame, batch_size: str = "batch_size") -> DataFrame:
    """Adds error_rows, total_batches, current_batch and progress_percent (0 to 100) to job counters."""
    size = F.greatest(F.col(batch_size), F.lit(1))
    percent = F.when(F.col("total_rows") > 0, F.least(F.lit(100.0), F.floor(1000 * F.col("processed_rows") / F.col("total_rows") + 0.5) / 10)).otherwise(0.0)
    return jobs.withColumns({"error_rows": F.col("invalid_rows"), "total_batches": F.ceil(F.col("total_rows") / size).cast("bigint"), "current_batch": F.ceil(F.col("processed_rows") / size).cast("bigint"), "progress_percent": percent})
