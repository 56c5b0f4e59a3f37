"""Set-based maintenance of stored records, and edits with their log. Every policy is a projection of the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V
from ledgerloom.operators import quality as Q
from ledgerloom.operators.dedup import with_identity

# Community texts in capitals that are sheet titles.
NOISE_TITLES = ["TOTAL OWNER DETAILS", "TOTAL OWNERS DETAILS", "OWNER DETAILS", "OWNERS DETAILS", "OWNERS DATA", "TOTAL OWNERS", "OWNER DETAIL"]

FIVE_OF = ["name", "mobile_1", "email_address", "community", "sub_community", "building_cluster", "unit_number", "plot_number", "bedroom", "developer", "project", "property_type"]


def full(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))


def any_of(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, map(full, columns))


def noisy_community() -> Column:
    c = F.upper(F.trim("community"))
    return F.coalesce(c.isin(NOISE_TITLES) | c.like("OWNERS DATA #%"), F.lit(False))


def _community() -> Column:
    return full("community") & ~noisy_community()


#: Tests that a VALID record must pass to stay VALID, by policy.
POLICIES = {
    "property": lambda: any_of("unit_number", "plot_number", "building_cluster", "pi_number", "sub_community", "project", "developer") | _community(),
    "registry": lambda: full("name") & any_of("mobile_1", "mobile_2", "mobile_3", "email_address") & (any_of("unit_number", "plot_number", "pi_number") | (full("building_cluster") & _community()) | (full("developer") & (_community() | full("project")))),
    "five_fields": lambda: reduce(lambda a, b: a + b, [(_community() if c == "community" else full(c)).cast("int") for c in FIVE_OF]) >= 5,
    "no_property": lambda: any_of("unit_number", "plot_number", "pi_number") | (full("building_cluster") & _community()) | (full("developer") & full("project")),
}


def reclassify_contact(records: DataFrame) -> DataFrame:
    """VALID with a name and any of three phones or an e-mail, else INCOMPLETE; INVALID stays. It takes duplicates too."""
    good = full("name") & any_of("mobile_1", "mobile_2", "mobile_3", "email_address")
    return records.withColumn("status", F.when(F.col("status") == "INVALID", F.col("status")).when(good, "VALID").otherwise("INCOMPLETE"))


def reclassify(records: DataFrame, policy: str) -> DataFrame:
    """VALID records that fail the policy's test become INCOMPLETE; no other row changes."""
    return records.withColumn("status", F.when((F.col("status") == "VALID") & ~POLICIES[policy](), "INCOMPLETE").otherwise(F.col("status")))


def clear_noise(records: DataFrame) -> DataFrame:
    return records.withColumn("community", F.when(~noisy_community(), F.col("community")))


def without_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records of all files but those listed (source_file), as before a file is read again."""
    return records.join(files.select("source_file").distinct(), "source_file", "left_anti")


def stack_sheets(sheets: list[DataFrame], skip: tuple[str, ...] = ("readme", "legend", "method", "instruction", "cover")) -> DataFrame:
    """All sheets under each other by column name; sheets named like a cover are left out where others exist."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
    cover = F.lower("source_sheet").rlike("|".join(skip))
    others = stacked.groupBy("source_file").agg(F.bool_or(~cover).alias("_others"))
    return stacked.join(others, "source_file").where(~cover | ~F.col("_others")).drop("_others")


#: Fields that an edit may set; each goes through its cleaner.
EDITABLE = [c for c in V.FIELDS if c != "party_type"]


def cleaned_value(field: Column, value: Column) -> Column:
    """The cleaned text of an edit's value, by the field it is for."""
    cleaner = {"name": C.clean_name, "community": C.clean_community, "unit_number": C.clean_unit, "plot_number": C.clean_unit, "nationality": C.clean_nationality}
    cleaner |= {f"mobile_{i}": lambda v: C.clean_phone(v)["num"] for i in (1, 2, 3)}
    cleaner |= {"email_address": lambda v: C.clean_email(v)["value"], "bedroom": lambda v: C.clean_bedroom(v)["value"]}
    cleaner |= {"size": lambda v: C.clean_size(v).cast("string"), "procedure_value": lambda v: C.clean_number(v).cast("string"), "record_date": lambda v: C.clean_date(v).cast("string")}
    out = F.when(F.lit(False), C.none())
    for name in EDITABLE:
        out = out.when(field == name, cleaner.get(name, C.clean_text)(value))
    return out


def changes(records: DataFrame, edits: DataFrame, *, id_col: str = "id") -> DataFrame:
    """(record_id, field, old, new): the edits that really change a record; of several for one field the last (``ord``) counts.

    ``edits`` holds record_id, field, value (null clears the field) and ord. Fields that may not be edited,
    unknown records and values that clean to what is there change nothing.
    """
    last = edits.where(F.col("field").isin(EDITABLE)).groupBy("record_id", "field").agg(F.max_by(F.struct("value"), "ord").alias("v"))
    clean = last.select("record_id", "field", cleaned_value(F.col("field"), F.col("v.value")).alias("new"))
    stands = records.select(F.col(id_col).alias("record_id"), *[F.col(c).cast("string").alias(f"_{c}") for c in EDITABLE])
    old = reduce(lambda cases, c: cases.when(F.col("field") == c, F.col(f"_{c}")), EDITABLE, F.when(F.lit(False), C.none()))
    # both sides grow, and Parquet files are far smaller than their rows: by its files' size the planner would send a record table to the driver for a broadcast
    rows = clean.join(stands.hint("merge"), "record_id").withColumn("old", old)
    return rows.where(~F.col("old").eqNullSafe(F.col("new"))).select("record_id", "field", "old", "new")


def apply_edits(records: DataFrame, edits: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Records after the edits, validated, classified and hashed anew where something changed; flags are replaced there."""
    changed = changes(records, edits, id_col=id_col).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("_set"))
    rows = records.join(changed, F.col(id_col) == F.col("record_id"), "left").drop("record_id")
    has = lambda c: F.coalesce(F.array_contains(F.map_keys("_set"), c), F.lit(False))
    rows = rows.withColumns({c: F.when(has(c), F.try_element_at("_set", F.lit(c)).cast(records.schema[c].dataType)).otherwise(F.col(c)) for c in EDITABLE})
    again = with_identity(Q.validate(rows.withColumn("_flags", F.col("validation_flags")).withColumn("validation_flags", F.array().cast("array<string>")).drop("identity_hash", "is_valid", "has_context")))
    contact = Q.filled("mobile_1") | Q.filled("email_address")
    status = F.when(~F.col("is_valid"), "INVALID").when(Q.filled("name") & contact & F.col("has_context"), "VALID").otherwise("INCOMPLETE")
    edited = F.col("_set").isNotNull()
    return again.withColumns({"status": F.when(edited, status).otherwise(F.col("status")), "validation_flags": F.when(edited, F.col("validation_flags")).otherwise(F.col("_flags"))}).drop("_set", "_flags")


def edit_log(records: DataFrame, edits: DataFrame, user: Column, at: Column, *, id_col: str = "id") -> DataFrame:
    return changes(records, edits, id_col=id_col).withColumns({"edited_by": user, "edited_at": at})
