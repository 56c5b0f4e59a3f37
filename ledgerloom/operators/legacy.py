"""The rules of the older register loader, where they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C

# Headings from which the older loader fills a field that no alias has filled; the first one that a row has counts.
FALLBACK_HEADINGS = {
    "name": ["NAME", "FULL NAME", "OWNER NAME", "CUSTOMER NAME", "BUILDING NAME", "PROJECT", "DEVELOPMENT"],
    "mobile": ["MOBILE", "PHONE", "CONTACT"],
    "community": ["COMMUNITY", "AREA", "LOCATION"],
    "unit_number": ["UNIT NO", "FLAT NO", "FLAT NUMBER", "UNIT NUMBER"],
    "building": ["BUILDING NAME", "BUILDING", "CLUSTER"],
    "size": ["ACTUAL AREA", "GROSS AREA", "SIZE"],
    "project": ["MASTER PROJECT", "PROJECT"],
}

# Columns that the older loader's search looks in.
SEARCHED = ("name", "community", "building_cluster", "unit_number", "mobile_1", "plot_number")


def map_header(headers: DataFrame, aliases: DataFrame, column: str = "header") -> DataFrame:
    """(header, target, confidence): 100 with the first alias of the trimmed, upper-case heading, else 0."""
    first = aliases.groupBy("header_norm").agg(F.min_by("target", "ord").alias("target"))
    return headers.withColumn("header_norm", F.upper(F.trim(column))).join(first, "header_norm", "left").withColumn("confidence", F.when(F.col("target").isNotNull(), 100).otherwise(0)).drop("header_norm")


def fallback(field: str, cells: Column, mapped: Column | None = None) -> Column:
    """``mapped`` if it holds text, else the cell under the first fallback heading that the row has, empty or not, else the empty string.

    ``cells`` is the row as a map from upper-case headings to text; a null map has no headings.
    """
    out = F.when(C.has_text(mapped), mapped) if mapped is not None else F.when(F.lit(False), C.none())
    for heading in FALLBACK_HEADINGS[field]:
        out = out.when(F.map_contains_key(cells, F.lit(heading)), F.try_element_at(cells, F.lit(heading)))
    return out.otherwise("")


def is_valid() -> Column:
    return F.coalesce("name", "mobile_1", "unit_number", "developer", "building_cluster", "community", "project").isNotNull()


def dedup_key() -> Column:
    """name|mobile where both are there, else unit|building, in lower case; null if it has 3 characters or fewer."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.lower(F.when((empty("name") != "") & (empty("mobile_1") != ""), F.concat_ws("|", "name", "mobile_1")).otherwise(F.concat_ws("|", empty("unit_number"), empty("building_cluster"))))
    return F.when(F.length(key) > 3, key)


def duplicates(rows: DataFrame, known: DataFrame | None = None, order: tuple[str, ...] = ("source_file", "source_sheet", "source_row")) -> DataFrame:
    """Add ``dedup_key`` and ``is_duplicate``: an earlier row, or a stored record (dedup_key in ``known``), has the key."""
    keyed = rows.withColumn("dedup_key", dedup_key())
    first = keyed.where("dedup_key IS NOT NULL").groupBy("dedup_key").agg(F.min(F.struct(*order)).alias("_first"))
    out = keyed.join(first, "dedup_key", "left")
    seen = F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))
    if known is not None:
        out = out.join(known.select("dedup_key").distinct().withColumn("_known", F.lit(True)), "dedup_key", "left")
        seen = seen | F.coalesce("_known", F.lit(False))
    return out.withColumn("is_duplicate", seen).drop("_first", "_known")


def rejected(rows: DataFrame, cells: Column) -> DataFrame:
    """Rows that hold nothing of a record, with their filled cells as JSON."""
    return rows.where(~is_valid()).withColumn("payload", F.to_json(F.map_filter(cells, lambda k, v: F.coalesce(v, F.lit("")) != "")))
