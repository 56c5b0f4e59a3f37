"""Find headers and map raw cells onto canonical columns, with the mapping itself as data.

``raw_rows`` holds (source_file, source_sheet, source_row, cells). A *column plan* holds one row a sheet column:
source_file, source_sheet, idx, header, disposition, target, rank. No sheet is treated in a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V

SHEET = ["source_file", "source_sheet"]
SCAN_ROWS = 12
SAMPLE_ROWS = 50


def alias_table(spark: SparkSession, aliases: dict[str, str] | None = None) -> DataFrame:
    """(header_norm, target, ord): the default aliases, or those given."""
    return spark.createDataFrame([(h, t, 1) for h, t in (aliases or V.ALIASES).items()], "header_norm string, target string, ord int")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The alias table of a mapping file: one JSON object whose ``aliases`` hold a list of headings for each target.

    A heading may stand under several targets; the first of them in the file counts in a plan. Blank headings are left out.
    """
    pairs = "map<string,array<string>>"
    lists = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.aliases"), pairs).alias("aliases"))
    rows = lists.select(F.posexplode(F.map_entries("aliases")).alias("_at", "_e")).select("_at", F.col("_e.key").alias("target"), F.posexplode("_e.value").alias("_in", "header"))
    named = rows.select(C.normal_header(F.col("header")).alias("header_norm"), "target", (F.col("_at") * 100_000 + F.col("_in")).alias("ord")).where("header_norm <> ''")
    return named.groupBy("header_norm", "target").agg(F.min("ord").cast("int").alias("ord"))


def add_alias(table: DataFrame, header: str, target: str) -> DataFrame:
    """The alias table with one more entry, unless that header already has that target."""
    one = table.sparkSession.createDataFrame([(header, target)], "header string, target string").select(C.normal_header(F.col("header")).alias("header_norm"), "target")
    new = one.join(table.select("header_norm", "target"), ["header_norm", "target"], "left_anti")
    last = table.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m"))
    return table.unionByName(new.crossJoin(F.broadcast(last)).select("header_norm", "target", (F.col("m") + 1).cast("int").alias("ord")))  # last: one row


def remove_alias(table: DataFrame, header: str, target: str) -> DataFrame:
    return table.where(~((F.col("header_norm") == C.normal_header(F.lit(header))) & (F.col("target") == target)))


def alias_catalogue(table: DataFrame) -> DataFrame:
    return table.groupBy("target").agg(F.count(F.lit(1)).alias("n_aliases"), F.array_sort(F.collect_list("header_norm")).alias("headers"))


def _full(cell: Column) -> Column:
    return F.coalesce(F.trim(cell), F.lit("")) != ""


def header_score(cells: Column) -> Column:
    """Filled cells, less 2 for each that looks like data and 1 for each other over 60 characters; -1 under two cells."""
    filled = F.transform(F.filter(cells, _full), lambda c: F.trim(c))
    score = F.aggregate(filled, F.lit(0.0), lambda s, c: s + 1 - F.when(C.looks_like_data(c), 2.0).when(F.length(c) > 60, 1.0).otherwise(0.0))
    return F.when(F.size(filled) < 2, F.lit(-1.0)).otherwise(score)


def known_headings(aliases: list[str]) -> list[str]:
    """All names by which a row is recognised as a heading: those of the alias table, the excluded, those kept aside and a few more."""
    return sorted({*aliases, *V.EXCLUDED_HEADERS, *V.ASIDE_HEADERS, *V.HEADING_NAMES})


def header_rows(raw_rows: DataFrame, known_headers: list[str]) -> DataFrame:
    """(sheet, header_row, header): the heading of each sheet, or header_row -1 where there is none.

    Of the first 12 rows, those count whose score is positive and of whose filled cells max(2, a third) are known headings of
    more than two characters; the best score wins, the first on ties. A row that only looks like a heading does not count: the first
    data row of a register without headings may hold more text than numbers. Only a dozen rows a sheet are looked at.
    """
    filled = F.transform(F.filter("cells", _full), lambda c: F.trim(c))
    hits = F.size(F.filter(filled, lambda c: (F.length(c) > 2) & C.normal_header(c).isin(*known_headers)))
    scored = raw_rows.where(F.col("source_row") < SCAN_ROWS).select(*SHEET, "source_row", "cells", header_score(F.col("cells")).alias("score"), (hits >= F.greatest(F.lit(2), F.floor(F.size(filled) / 3))).alias("is_known"))
    heading = F.when(F.col("is_known") & (F.col("score") > 0), F.struct("score", (-F.col("source_row")).alias("first"), "cells"))
    # a sheet whose first rows are all missing has no heading either
    sheets = scored.groupBy(*SHEET).agg(F.max(heading).alias("best"))
    others = raw_rows.where(F.col("source_row") >= SCAN_ROWS).select(*SHEET).distinct().join(sheets, SHEET, "left_anti").withColumn("best", F.lit(None).cast(sheets.schema["best"].dataType))
    return sheets.unionByName(others).select(*SHEET, F.coalesce(-F.col("best.first"), F.lit(-1)).cast("int").alias("header_row"), F.col("best.cells").alias("header"))


def samples(raw_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, idx, n, numeric, alphabetic, lettered, phonelike, emaillike, parties): shares of a column's first 50 filled cells."""
    body = raw_rows.join(headers.select(*SHEET, "header_row"), SHEET).where(F.col("source_row") > F.col("header_row"))
    first = body.withColumn("_n", F.row_number().over(Window.partitionBy(*SHEET).orderBy("source_row"))).where(F.col("_n") <= SAMPLE_ROWS)
    cells = first.select(*SHEET, F.posexplode("cells").alias("idx", "v")).where(_full(F.col("v")))
    share = lambda test: F.avg(test.cast("double"))
    return cells.groupBy(*SHEET, "idx").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.regexp_replace("v", ",", "").try_cast("double").isNotNull()).alias("numeric"),
        share(F.col("v").rlike(r"[A-Za-z؀-ۿ]")).alias("alphabetic"),
        share(F.col("v").rlike("[A-Za-z]{3,}")).alias("lettered"),
        share(F.col("v").rlike(r"\d{7,}")).alias("phonelike"),
        share(F.col("v").rlike(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}")).alias("emaillike"),
        F.bool_or(F.upper(F.trim("v")).isin("BUYER", "SELLER")).alias("parties"),
    )


def positional_headers(raw_rows: DataFrame, headers: DataFrame, seen: DataFrame) -> DataFrame:
    """Headings for headerless sheets of two known shapes: the 25-column owner register and the list of leads."""
    width = raw_rows.groupBy(*SHEET).agg(F.max(F.size("cells")).alias("n_cols"))
    col = lambda i, what: F.max(F.when(F.col("idx") == i, F.col(what)))
    shape = seen.groupBy(*SHEET).agg(
        (F.least(col(0, "n"), col(6, "n")) >= 3).alias("enough"), (col(0, "numeric") >= 0.8).alias("numbers"), (col(6, "alphabetic") >= 0.7).alias("names"),
        ((F.least(col(0, "n"), col(1, "n"), col(2, "n")) >= 3) & (col(0, "lettered") >= 0.7) & (col(1, "phonelike") >= 0.7) & (col(2, "emaillike") >= 0.7)).alias("leads"),
    )
    bare = headers.where("header_row = -1").join(width, SHEET).join(shape, SHEET, "left")
    words = lambda names: F.array(*[F.lit(n) for n in names])
    header = F.when((F.col("n_cols") >= 25) & F.col("enough") & F.col("numbers") & F.col("names"), words(V.OWNER_REGISTER)).when(
        F.col("n_cols").isin(3, 4) & F.col("leads"), F.when(F.col("n_cols") == 4, words(["Name", "Mobile 1", "Email Address", "extra"])).otherwise(words(["Name", "Mobile 1", "Email Address"]))
    )
    return bare.select(*SHEET, header.alias("header")).where("header IS NOT NULL")


def rank_of(header: Column) -> Column:
    return F.coalesce(C.lookup({h: str(r) for r, names in V.RANKS.items() for h in names}, header).cast("int"), F.lit(V.DEFAULT_RANK))


def plan_columns(headers: DataFrame, aliases: DataFrame, *, seen: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The column plan of all sheets.

    A heading is, in this order: blank; excluded (never read); a composite (premise, phones, e-mails); skipped; kept aside; a
    target by its first alias; else kept aside and unmapped. AREA is a size if over 70 % of its sample is
    numeric, else a community; TYPE is a party type only if its sample holds BUYER or SELLER. ``overrides`` (sheet, header_norm,
    target) win over all but exclusion.
    """
    cells = headers.where("header IS NOT NULL").select(*SHEET, F.posexplode("header").alias("idx", "header")).withColumn("header_norm", C.normal_header(F.col("header")))
    first = aliases.groupBy("header_norm").agg(F.min_by("target", "ord").alias("alias"))
    rows = cells.join(first, "header_norm", "left")
    rows = rows.join(overrides.select(*SHEET, "header_norm", F.col("target").alias("override")), [*SHEET, "header_norm"], "left") if overrides is not None else rows.withColumn("override", C.none())
    rows = rows.join(seen.select(*SHEET, "idx", "n", "numeric", "parties"), [*SHEET, "idx"], "left") if seen is not None else rows.withColumns({"n": F.lit(None).cast("bigint"), "numeric": F.lit(None).cast("double"), "parties": F.lit(None).cast("boolean")})
    h = F.col("header_norm")
    no_party = (h == "TYPE") & (F.col("alias") == "Type (Buyer/Seller)") & (F.col("n") > 0) & ~F.col("parties")
    disposition = (
        F.when(h == "", "blank").when(h.isin(V.EXCLUDED_HEADERS), "excluded").when(F.col("override").isNotNull(), "mapped").when(h == "PREMISE 1", "premise").when(h.isin("PREMISE 2", "PREMISE 3"), "skipped")
        .when(h == "OWNERS_PHONE", "phones").when(h == "OWNERS_EMAIL", "emails").when(h.isin(V.ASIDE_HEADERS), "aside").when(F.coalesce(no_party, F.lit(False)), "aside").when(F.col("alias").isNotNull(), "mapped").otherwise("unmapped")
    )
    area = F.when((h == "AREA") & F.col("n").isNotNull(), F.when(F.col("numeric") > 0.7, "Size").otherwise("Community"))
    return rows.withColumn("disposition", disposition).select(*SHEET, "idx", "header", "header_norm", "disposition", F.when(F.col("disposition") == "mapped", F.coalesce("override", area, "alias")).alias("target"), rank_of(h).alias("rank"))


def mapping_report(plan: DataFrame) -> DataFrame:
    """One row a sheet: mapped headings with their targets, and the sorted headings kept aside, excluded and unmapped."""
    some = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("disposition").isin(*kinds), F.col("header"))))
    pairs = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("idx", "header", "target"))))
    return plan.groupBy(*SHEET).agg(F.transform(pairs, lambda p: F.concat_ws(" -> ", p["header"], p["target"])).alias("mapped"), F.count_if(F.col("target").isNotNull()).alias("n_mapped"), some("aside", "unmapped").alias("aside"), some("excluded").alias("excluded"), some("unmapped").alias("unmapped"))


def is_reference_sheet(header: Column, sheet: Column) -> Column:
    """Whether a sheet lists places and developers rather than records."""
    names = F.filter(F.transform(header, C.normal_header), lambda h: h != "")
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    named = F.lower(sheet).rlike("|".join(V.REFERENCE_WORDS))
    reference = F.arrays_overlap(names, words(V.REFERENCE_HEADERS))
    lists = F.exists(names, lambda h: h.startswith("DEVELOPMENT")) & (F.array_contains(names, "CONFIDENCE") | reference) & ~F.arrays_overlap(names, words(V.CONTACT_HEADERS))
    return F.coalesce(named & (reference | (F.size(names) == 0)), F.lit(False)) | F.coalesce(lists, F.lit(False)) | (header.isNull() & named)


def sheet_role(targets: Column) -> Column:
    """property, owner, both or other, by a sheet's mapped targets."""
    has = lambda ws: F.arrays_overlap(targets, F.array(*[F.lit(w) for w in ws]))
    person, place = has(V.PERSON_TARGETS), has(V.PLACE_TARGETS)
    return F.when(~F.array_contains(targets, "PI number"), F.when(person, "both").otherwise("other")).when(person & place, "both").when(person, "owner").when(place, "property").otherwise("other")


def sheet_profile(raw_rows: DataFrame, headers: DataFrame, plan: DataFrame) -> DataFrame:
    """Structure of each sheet: rows, columns, header, targets, unmapped headings (20 at most), role, reference or not."""
    size = raw_rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cells")).alias("n_cols"))
    maps = plan.groupBy(*SHEET).agg(F.array_sort(F.collect_set("target")).alias("targets"), F.slice(F.array_sort(F.collect_list(F.when(F.col("disposition") == "unmapped", F.col("header")))), 1, 20).alias("unmapped"))
    none = F.array().cast("array<string>")
    out = size.join(headers, SHEET, "left").join(maps, SHEET, "left").withColumns({"targets": F.coalesce("targets", none), "unmapped": F.coalesce("unmapped", none)})
    return out.select(*SHEET, "n_rows", "n_cols", "header_row", (F.col("header_row") == -1).alias("headerless"), is_reference_sheet(F.col("header"), F.col("source_sheet")).alias("is_reference"), sheet_role(F.col("targets")).alias("role"), "targets", "unmapped", F.slice(F.coalesce("header", none), 1, 60).alias("header"))


def file_profile(sheets: DataFrame) -> DataFrame:
    """Each file's sheets, and rows and distinct targets over its record sheets; a reference file has reference sheets only."""
    own = ~F.col("is_reference")
    return sheets.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_sheets"), F.coalesce(F.sum(F.when(own, F.col("n_rows"))), F.lit(0)).alias("n_rows"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(own, F.col("targets")))))).alias("n_targets"), F.bool_and("is_reference").alias("is_reference"))


def acceptable(target: str, value: Column) -> Column:
    """A name is neither a record label nor digits only."""
    if target != "Name":
        return F.lit(True)
    return ~value.rlike(r"(?i)^\s*owners?\s+data\s*#?\d*\s*$") & ~F.trim(value).rlike(r"^\d+$")


def premise(value: Column) -> Column:
    """struct(community, building, unit) of ``code | emirate | unit | building``; fewer than four parts are a building."""
    parts = F.transform(F.split(value, r"\|"), lambda p: F.trim(p))
    at = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    full = F.size(parts) >= 4
    unit = at(2)
    return F.struct(
        F.when(full, F.coalesce(C.lookup(V.COMMUNITY_CODES, F.upper(at(0))), at(0))).alias("community"),
        F.when(full, at(3)).otherwise(F.nullif(F.trim(value), F.lit(""))).alias("building"),
        F.when(full & (F.upper(unit) != "NA"), unit).alias("unit"),
    )


def labelled_phones(value: Column) -> Column:
    """The first three mobile, telephone and phone numbers of ``Fax 1: x, Mobile 1: y, ...``."""
    pattern = r"(?i)(fax|mobile|home|work|other|tel|phone)\s*\d*\s*:\s*([^,]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(value, F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(value, F.lit(pattern), F.lit(2)).alias("number"))
    wanted = F.filter(pairs, lambda p: F.lower(p["label"]).isin("mobile", "tel", "phone") & (F.trim(p["number"]) != ""))
    return F.slice(F.transform(wanted, lambda p: F.trim(p["number"])), 1, 3)


def email_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "[,;]"), lambda e: F.trim(e)), lambda e: e != "")


def _folded(plan: DataFrame) -> DataFrame:
    """The plan as one row a sheet: what its rows need of it, so that no row looks at headings and targets again.

    _at: for each of ``V.LABELS`` the places of its columns, best first; _contested: entries of targets with several columns; _kept: entries kept
    aside, and whether their headings repeat; _premise_at, _phones_at, _emails_at: places of the composites.
    """
    entry = F.struct("rank", "idx", "target", "disposition", "header", "header_norm")
    sheets = plan.groupBy(*SHEET).agg(F.array_sort(F.collect_list(entry)).alias("_plan"))
    places = lambda test: F.transform(F.filter("_plan", test), lambda e: e["idx"])
    of = lambda label: places(lambda e: e["target"] == label)
    first = lambda kind: F.get(places(lambda e: e["disposition"] == kind), F.lit(0)).alias(f"_{kind}_at")
    several = lambda e: F.size(F.filter("_plan", lambda x: x["target"] == e["target"])) > 1
    short = lambda e: F.struct(e["header"].alias("header"), e["target"].alias("target"), e["idx"].alias("idx"))
    kept = F.transform(F.filter("_plan", lambda e: e["disposition"].isin("aside", "unmapped")), short)
    from_project = F.exists("_plan", lambda e: (e["target"] == "Sub-Community") & e["header_norm"].isin(V.PROJECT_HEADERS))
    out = sheets.select(
        *SHEET, F.array(*map(of, V.LABELS)).alias("_at"), F.transform(F.filter("_plan", lambda e: e["target"].isNotNull() & several(e)), short).alias("_contested"),
        kept.alias("_kept"), from_project.alias("_from_project"), first("premise"), first("phones"), first("emails"),
    )
    return out.withColumn("_repeats", F.size(F.array_distinct(F.transform("_kept", lambda e: e["header"]))) < F.size("_kept"))


def map_columns(raw_rows: DataFrame, plan: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Raw rows as the 23 business columns (text) and ``extras``; sheets with different plans go in one pass.

    The plan is folded to one row a sheet, sorted by rank and place, and joined to the rows; each target takes the
    first acceptable filled cell of its columns. Losing cells with another value and columns kept aside go to extras
    under their headings (an aside column wins there). Composites only fill what is empty. A lone project names the
    sub-community too, and a sub-community under a project heading names the project. Blank rows, rows above
    the heading and repeated headings are left out.
    """
    rows = raw_rows.join(_folded(plan), SHEET)
    if headers is not None:
        rows = rows.join(headers.select(*SHEET, F.col("header_row").alias("_header_row"), header_names(F.col("header")).alias("_names")), SHEET, "left").where(F.col("source_row") > F.coalesce("_header_row", F.lit(-1))).where(~is_repeated_header(F.col("cells"), F.col("_names"))).drop("_header_row", "_names")
    rows = rows.where(F.exists("cells", _full))
    at = lambda place: F.nullif(F.get(F.col("cells"), place), F.lit(""))
    cell = lambda e: at(e["idx"])

    def first_of(number: int, label: str) -> Column:
        return F.get(F.filter(F.transform(F.get("_at", F.lit(number)), at), lambda v: v.isNotNull() & acceptable(label, v)), F.lit(0))

    found = {}
    for number, (label, name) in enumerate(V.LABELS.items()):
        found[name] = first_of(number, label)
    rows = rows.withColumns(found).select(F.inline(F.array(F.struct("*"))))  # so that no later step computes these again
    chosen = F.create_map(*[x for label, name in V.LABELS.items() for x in (F.lit(label), F.col(name))])
    lost = F.filter("_contested", lambda e: cell(e).isNotNull() & (cell(e) != F.try_element_at(chosen, e["target"])))
    aside = F.filter("_kept", lambda e: cell(e).isNotNull())
    as_map = lambda entries: F.map_from_entries(F.transform(entries, lambda e: F.struct(e["header"].alias("key"), cell(e).alias("value"))))
    once = lambda entries: F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["header"]), e["header"]) == i + 1)
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumns({
        "_aside": F.when(F.size("_kept") == 0, none).when(F.col("_repeats"), as_map(once(aside))).otherwise(as_map(aside)), "_lost": F.when(F.size("_contested") == 0, none).otherwise(as_map(once(lost))),
        "_premise": premise(at(F.col("_premise_at"))), "_phones": labelled_phones(at(F.col("_phones_at"))), "_emails": email_list(at(F.col("_emails_at"))),
    })
    more = F.when(F.size("_emails") > 1, F.create_map(F.lit("additional_emails"), F.array_join(F.slice("_emails", 2, 1000), ",")))
    merged = F.map_concat(F.map_filter("_lost", lambda k, v: ~F.array_contains(F.map_keys("_aside"), k)), F.col("_aside"))
    return rows.withColumn("_merged", F.when(F.size("_lost") == 0, F.col("_aside")).otherwise(merged)).withColumns({
        "sub_community": F.coalesce("sub_community", "project"),
        "project": F.coalesce("project", F.when(F.col("_from_project"), F.col("sub_community"))),
        "community": F.coalesce("community", "_premise.community"),
        "building_cluster": F.coalesce("building_cluster", "_premise.building"),
        "unit_number": F.coalesce("unit_number", "_premise.unit"),
        **{f"mobile_{i + 1}": F.coalesce(f"mobile_{i + 1}", F.get("_phones", F.lit(i))) for i in range(3)},
        "email_address": F.coalesce("email_address", F.get("_emails", F.lit(0))),
        "extras": F.coalesce(F.map_concat("_merged", F.map_filter(more, lambda k, v: ~F.array_contains(F.map_keys("_merged"), k))), F.col("_merged")),
    }).select(*SHEET, "source_row", *V.FIELDS, "extras")


def header_names(header: Column) -> Column:
    """A heading's normal names, null where it is blank."""
    return F.transform(header, lambda h: F.when(_full(h), C.normal_header(h)))


def is_repeated_header(cells: Column, names: Column) -> Column:
    """Whether a row repeats its sheet's heading, given by its :func:`header_names`: max(2, half of the headed cells) are equal.

    A cell is brought into normal form only if it holds the first word of its heading, which few cells of data do.
    """
    both = F.arrays_zip(cells.alias("c"), names.alias("h"))
    headed = F.size(F.filter(F.slice(names, 1, F.greatest(F.size(cells), F.lit(1))), lambda h: h.isNotNull()))
    may = lambda p: F.upper(F.replace(p["c"], F.lit("`"), F.lit("'"))).contains(F.substring_index(p["h"], " ", 1))
    hits = F.size(F.filter(both, lambda p: p["c"].isNotNull() & p["h"].isNotNull() & F.when(may(p), C.normal_header(p["c"]) == p["h"]).otherwise(F.lit(False))))
    return F.coalesce((headed > 0) & (hits >= F.greatest(F.lit(2), F.floor(headed / 2))), F.lit(False))


def is_building_row(unit: Column, extras: Column) -> Column:
    """A row about a whole building: no unit, and two or more filled counts of levels, shops, flats or offices."""
    hits = F.size(F.filter(F.map_entries(extras), lambda e: F.upper(F.trim(e["key"])).isin(V.BUILDING_MARKERS) & ~F.coalesce(e["value"], F.lit("")).isin("", "0")))
    return (F.coalesce(unit, F.lit("")) == "") & F.coalesce(hits >= 2, F.lit(False))
