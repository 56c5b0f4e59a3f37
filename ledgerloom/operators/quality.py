"""Standardise mapped rows, validate them and give them a status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V

#: Fields that count towards a populated record.
COUNTED = ["name", "mobile_1", "mobile_2", "mobile_3", "email_address", "community", "sub_community", "building_cluster", "unit_number", "plot_number", "bedroom", "procedure_value", "developer", "project", "property_type", "party_type"]


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, behind a step through which filters are not pushed.

    A filter on a cleaned column would otherwise be rewritten into the whole chain of cleaning expressions.
    """
    return rows.select(F.inline(F.array(F.struct("*"))))


def filled(c: str) -> Column:
    return F.col(c).isNotNull()


def standardise(mapped: DataFrame, size_header: Column | None = None) -> DataFrame:
    """Clean all 23 business columns (raw text in, typed values or NULL out) and gather validation_flags.

    Missing columns count as NULL; other columns pass through. Flags stand in a fixed order: bedroom, date,
    phones by slot, e-mail, size. A rejected bedroom is kept in ``extras`` where that map column exists.
    """
    for c in V.FIELDS:
        if c not in mapped.columns:
            mapped = mapped.withColumn(c, F.lit(None).cast("string"))
    # steps refer to each other's columns, so that each text is cleaned once however often it is looked at
    plain = ("sub_community", "building_cluster", "plot_reg_no", "dmno", "dmsubno", "pi_number", "property_type", "developer", "project")
    more = ("name", "community", "unit_number", "plot_number", "bedroom", "party_type", "nationality")
    staged = mapped.withColumns({
        **{f"_s_{c}": C.tidy_text(F.col(c)) for c in plain + more}, "_s_email": C.tidy_text(F.col("email_address"), strip_tag=False),
        **{f"_d_{i}": C.phone_digits(C.phone_text(F.col(f"mobile_{i}"))) for i in (1, 2, 3)},
    })
    staged = staged.withColumns({**{f"_t_{c}": C.clean_text(F.col(c), tidy=F.col(f"_s_{c}")) for c in plain + more}, "_t_email": C.first_email(F.col("email_address"), F.col("_s_email"))})
    staged = staged.withColumns({
        "_bedroom": C.clean_bedroom(F.col("bedroom"), F.col("_t_bedroom")),
        **{f"_p_{i}": C.clean_phone(F.col(f"mobile_{i}"), F.col(f"_d_{i}")) for i in (1, 2, 3)},
        "_email": C.clean_email(F.col("email_address"), F.col("_t_email")),
        "_size": C.clean_size(F.col("size"), size_header),
        "_date": C.clean_date(F.col("record_date")),
        "_short": C.without_number(F.col("_t_community")),
    })
    staged = staged.withColumn("_phones", C.phone_slots(F.col("_p_1"), F.col("_p_2"), F.col("_p_3")))
    flag = lambda test, name: F.when(test, F.lit(name))
    first = F.array_compact(F.array(F.col("_bedroom.flag"), flag(filled("record_date") & F.col("_date").isNull(), "date_unparseable")))
    last = F.array_compact(F.array(F.col("_email.flag"), flag(F.col("_size") > V.LARGEST_SIZE, "size_implausible")))
    values = {c: F.col(f"_t_{c}") for c in plain}
    values |= {c: C.clean_unit(F.col(c), F.col(f"_t_{c}")) for c in ("unit_number", "plot_number")}
    values |= {
        "validation_flags": F.concat(first, F.col("_phones.flags"), last),
        "name": C.clean_name(F.col("name"), F.col("_t_name")),
        "community": C.clean_community(F.col("community"), F.col("_t_community"), F.col("_short")),
        "bedroom": F.col("_bedroom.value"),
        "party_type": C.clean_party_type(F.col("party_type"), F.col("_t_party_type")),
        "nationality": C.clean_nationality(F.col("nationality"), F.col("_t_nationality")),
        "size": F.when(F.col("_size") <= V.LARGEST_SIZE, F.col("_size")),
        "procedure_value": C.clean_number(F.col("procedure_value")),
        "record_date": F.col("_date"),
        "mobile_1": F.col("_phones.mobile_1"),
        "mobile_2": F.col("_phones.mobile_2"),
        "mobile_3": F.col("_phones.mobile_3"),
        "email_address": F.col("_email.value"),
    }
    if "extras" in mapped.columns:
        kept = F.when(F.col("_bedroom.flag").isNotNull(), F.create_map(F.lit("Bedroom (raw, rejected)"), F.col("bedroom")))
        values["extras"] = F.coalesce(F.map_concat(F.map_filter(kept, lambda k, v: ~F.array_contains(F.map_keys(F.col("extras")), k)), F.col("extras")), F.col("extras"), kept)
    return settled(staged.withColumns(values).drop("_bedroom", "_phones", "_email", "_size", "_date", "_short", *[f"_{x}_{c}" for x in "st" for c in (*plain, *more, "email")], *[f"_{x}_{i}" for x in "dp" for i in (1, 2, 3)]))


def has_context(community: Column | None = None) -> Column:
    """A unit, plot or PI number; or two of the places that name a property together. ``community`` tells whether that field names a place, where it is known."""
    text = lambda c: C.has_text(F.col(c))
    community = C.is_place(F.col("community")) if community is None else community
    return text("unit_number") | text("plot_number") | text("pi_number") | (text("developer") & (community | text("project"))) | (text("building_cluster") & community)


def populated_fields() -> Column:
    """How many of the 16 counted fields hold something; a community only if it is no sheet title."""
    full = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("int")
    return reduce(lambda a, b: a + b, [C.is_place(F.col(c)).cast("int") if c == "community" else full(c) for c in COUNTED])


def validate(cleaned: DataFrame) -> DataFrame:
    """Add ``is_valid``, ``has_context`` and the flags empty_record, no_contact, no_location, uncontactable."""
    some = lambda *cs: reduce(lambda a, b: a | b, [filled(c) for c in cs])
    person = some("name", "mobile_1", "email_address")
    place = some("unit_number", "plot_number", "building_cluster", "pi_number", "developer", "project") | F.col("_place")
    flags = F.when(~person & ~place, F.array(F.lit("empty_record"))).otherwise(
        F.array_compact(F.array(F.when(~person, F.lit("no_contact")), F.when(~place, F.lit("no_location")), F.when(~some("mobile_1", "email_address"), F.lit("uncontactable"))))
    )
    return settled(cleaned.withColumn("_place", C.is_place(F.col("community"))).withColumns({"is_valid": person | place, "has_context": has_context(F.col("_place")), "validation_flags": F.concat("validation_flags", flags)}).drop("_place"))


def classify(rows: DataFrame) -> DataFrame:
    """Give each validated row (with ``duplicate_flag``, null where it is none) its status.

    INVALID, else DUPLICATE, else VALID (a name, a contact and a property context), else INCOMPLETE with one reason flag: name and contact
    missing, name, contact, or property info.
    """
    contact = filled("mobile_1") | filled("email_address")
    status = F.when(~F.col("is_valid"), "INVALID").when(filled("duplicate_flag"), "DUPLICATE").when(filled("name") & contact & F.col("has_context"), "VALID").otherwise("INCOMPLETE")
    reason = (
        F.when(~filled("name") & ~contact, "incomplete_missing_name_and_contact").when(~filled("name"), "incomplete_missing_name")
        .when(~contact, "incomplete_missing_contact").otherwise("incomplete_missing_property_info")
    )
    more = F.array_compact(F.array(F.when(F.col("status") == "DUPLICATE", F.col("duplicate_flag")), F.when(F.col("status") == "INCOMPLETE", reason)))
    return rows.withColumn("status", status).withColumn("validation_flags", F.concat("validation_flags", more))


def error_rows(records: DataFrame) -> DataFrame:
    """One row for each INVALID record, with its non-empty fields as JSON."""
    payload = F.to_json(F.struct(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c) for c in V.FIELDS if c in records.columns]))  # null fields are left out
    return records.where("status = 'INVALID'").select("source_file", "source_sheet", "source_row", F.lit("WARNING").alias("severity"), F.lit("INVALID_RECORD").alias("code"), F.concat_ws("; ", "validation_flags").alias("message"), payload.alias("payload"))


def sheet_errors(sheets: DataFrame) -> DataFrame:
    """Errors of whole sheets: reference sheets and merged property sheets that are skipped, and sheets of which no column maps."""
    code = F.when(F.col("is_reference"), "REFERENCE_SHEET_SKIPPED").when(F.size("targets") == 0, "NO_MAPPABLE_COLUMNS").when(F.col("merged"), "PROPERTY_SHEET_MERGED")
    return sheets.withColumn("code", code).where("code IS NOT NULL").select("source_file", "source_sheet", F.lit(None).cast("bigint").alias("source_row"), F.lit("WARNING").alias("severity"), "code", F.col("code").alias("message"), F.lit(None).cast("string").alias("payload"))


def join_notes(merged: DataFrame, key: str = "pi_number") -> DataFrame:
    """PROPERTY_OWNER_JOIN for each file whose property rows were joined to its owners, with the number of distinct keys as payload."""
    keyed = merged.withColumn("_key", F.nullif(F.trim(key), F.lit(""))).where("_key IS NOT NULL").groupBy("source_file").agg(F.count_distinct("_key").alias("properties"))
    none = lambda kind: F.lit(None).cast(kind)
    return keyed.select("source_file", none("string").alias("source_sheet"), none("bigint").alias("source_row"), F.lit("WARNING").alias("severity"), F.lit("PROPERTY_OWNER_JOIN").alias("code"), F.lit("PROPERTY_OWNER_JOIN").alias("message"), F.to_json(F.struct("properties")).alias("payload"))


def file_errors(inventory: DataFrame) -> DataFrame:
    """UNREADABLE_FILE for each file of an inventory whose format is unknown or that is encrypted; the format is the message."""
    bad = inventory.where(F.col("detected_format").isin("unknown", "encrypted"))
    none = lambda kind: F.lit(None).cast(kind)
    return bad.select(F.col("filename").alias("source_file"), none("string").alias("source_sheet"), none("bigint").alias("source_row"), F.lit("ERROR").alias("severity"), F.lit("UNREADABLE_FILE").alias("code"), F.col("detected_format").alias("message"), none("string").alias("payload"))


def job_outcome(errors: DataFrame, counters: DataFrame, by: str = "source_file") -> DataFrame:
    """COMPLETED, or COMPLETED_WITH_ERRORS where a file has an ERROR or an invalid row; FAILED where an error says it could not be read."""
    seen = errors.groupBy(by).agg(F.count_if(F.col("severity") == "ERROR").alias("n_errors"), F.bool_or(F.col("code").isin("UNREADABLE_FILE", "JOB_CRASHED")).alias("failed"))
    status = F.when(F.coalesce("failed", F.lit(False)), "FAILED").when((F.coalesce("n_errors", F.lit(0)) > 0) | (F.col("invalid") > 0), "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return counters.join(seen, by, "left").withColumn("job_status", status).drop("failed", "n_errors")
