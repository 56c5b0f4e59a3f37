"""Join property rows onto owners, and fill places and developers from reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V
from ledgerloom.sources.shared import written

#: Places looked up in the reference, in order of preference.
CANDIDATES = ("project", "sub_community", "community", "building_cluster")


def merge_properties(owners: DataFrame, properties: DataFrame, fill: tuple[str, ...], *, key: str = "pi_number", file_col: str = "source_file", order_col: str = "source_row") -> DataFrame:
    """Owner rows with their empty fields filled from the first property row of the same file and trimmed key.

    Keeps every owner row and adds ``property_merged``. The first row of a key is found by a
    partial aggregate, so keys with many rows are no hot groups; the planner picks the join. Owner rows without a key
    are dealt by their place, as one empty key would take all of them to one task.
    """
    tidy = F.nullif(F.trim(F.col(key)), F.lit(""))
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = properties.withColumn("_key", tidy).where("_key IS NOT NULL").groupBy(F.col(file_col).alias("_file"), "_key").agg(F.min_by(F.struct(*[value(c).alias(c) for c in fill]), F.col(order_col)).alias("_property"))
    first = first.withColumn("_key", F.concat(F.lit("="), "_key"))  # so that no key is like a place
    own = F.coalesce(F.concat(F.lit("="), tidy), F.xxhash64(order_col).cast("string"))
    joined = owners.withColumn("_own", own).join(first, (F.col(file_col) == F.col("_file")) & (F.col("_own") == F.col("_key")), "left")
    filled = {c: F.coalesce(value(c), F.col(f"_property.{c}")) for c in fill}
    return joined.withColumns({**filled, "property_merged": F.col("_property").isNotNull()}).drop("_own", "_file", "_key", "_property")


def merged_away(properties: DataFrame, owners: DataFrame, *, file_col: str = "source_file") -> DataFrame:
    """Property rows that stay records of their own: those of files without owner rows."""
    return properties.join(owners.select(file_col).distinct(), file_col, "left_anti")


def best_developments(developments: DataFrame) -> DataFrame:
    """One development for each place key: the highest confidence, plus 2 if a developer is named; the first on ties.

    ``ref_ord`` is the key's first place in the table, whichever row wins.
    """
    rank = F.coalesce(C.lookup({k: str(v) for k, v in V.CONFIDENCE.items()}, F.lower("confidence")).cast("int"), F.lit(0)) + F.when(F.col("developer").isNotNull(), 2).otherwise(0)
    best = F.struct("rank", (-F.col("ord")).alias("first"))
    # equal names have one key
    named = developments.withColumn("rank", rank).groupBy("name").agg(F.min("ord").alias("ref_ord"), F.max(best).alias("best"), F.max_by(F.struct("name", "emirate", "region", "developer", "dev_type", "confidence"), best).alias("dev"))
    keyed = named.withColumn("ref_key", C.place_key(F.col("name"))).where("ref_key <> ''")
    return keyed.groupBy("ref_key").agg(F.min("ref_ord").alias("ref_ord"), F.max_by("dev", "best").alias("dev"))


def match_developments(places: DataFrame, best: DataFrame, *, id_col: str, candidates: Column) -> DataFrame:
    """(id, dev, matched_by): the best reference entry for each row's candidate places, in order.

    An exact key of any candidate comes first; else a reference key of 5 characters or more that is a word of a candidate,
    or the words with which it begins. Candidates are expanded to those words and beginnings, and joined by equality:
    no loop over the reference. Distinct place texts are matched once, however many rows hold them, and by their best step alone.
    """
    rows = places.select(F.col(id_col).alias("id"), F.posexplode(candidates).alias("pos", "place")).where("place IS NOT NULL")
    keys = rows.select("place").distinct().withColumn("key", C.place_key(F.col("place"))).where("key <> ''")
    words = F.split("key", " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    parts = F.filter(F.array_distinct(F.concat(words, heads)), lambda p: F.length(p) >= 5)
    step = lambda n, key: F.struct(F.lit(n).alias("step"), key.alias("ref_key"))
    tried = keys.select("place", F.explode(F.concat(F.array(step(0, F.col("key"))), F.when(F.length("key") >= 5, F.transform(parts, lambda p: step(1, p))).otherwise(F.array().cast("array<struct<step: int, ref_key: string>>")))).alias("t")).select("place", "t.*")
    per_place = tried.join(best, "ref_key").groupBy("place").agg(F.min_by(F.struct("dev", "step"), F.struct("step", "ref_ord")).alias("hit"))
    return (
        rows.join(per_place, "place")
        .groupBy("id")
        .agg(F.min_by("hit", F.struct("hit.step", "pos")).alias("hit"))
        .select(F.col("id").alias(id_col), "hit.dev", F.when(F.col("hit.step") == 0, "exact").otherwise("contained").alias("matched_by"))
    )


def _located(places: DataFrame, developments: DataFrame | None, with_file: bool) -> DataFrame:
    """What can be told of each combination of places (and file) in ``_places``: the community, the reference entry and whether a known sub-project is named."""
    place = lambda i: F.get("_places", F.lit(i))
    guessed = F.nullif(C.filename_community(place(len(CANDIDATES))), F.lit("")) if with_file else C.none()
    out = places.withColumns({"_guess": guessed, **{c: place(i) for i, c in enumerate(CANDIDATES)}})
    out = out.withColumn("_from_file", (F.coalesce("community", F.lit("")) == "") & F.col("_guess").isNotNull()).withColumn("community", F.when(F.col("_from_file"), F.col("_guess")).otherwise(F.nullif("community", F.lit(""))))
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("community", "sub_community", "project", "building_cluster")], F.coalesce("_guess", F.lit(""))))
    if developments is not None:
        out = written(out)
        found = match_developments(out, best_developments(developments), id_col="_places", candidates=F.array(*[F.col(c) for c in CANDIDATES], F.col("_guess")))
        out = out.join(found, "_places", "left")
    else:
        out = out.withColumns({"dev": F.lit(None).cast("struct<region: string, developer: string, dev_type: string>"), "matched_by": C.none()})
    return out.select("_places", "_from_file", F.col("community").alias("_community"), text.rlike("|".join(V.KNOWN_SUBPROJECTS)).alias("_known"), "dev.region", "dev.developer", "dev.dev_type", "matched_by")


def enrich(rows: DataFrame, developments: DataFrame | None, *, file_col: str | None = "source_file") -> DataFrame:
    """Fill community, developer and property type where they are empty, and list what was filled in ``enriched_fields``.

    The community comes from the file's name, then from the reference; developer and property type from the
    reference; the developer of known sub-projects last. Nothing that a row holds is overwritten. Rows that name the same
    places in the same file are filled alike, so each such combination is looked up once.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = rows.withColumn("_places", F.array(*[F.col(c).cast("string") for c in CANDIDATES], *([F.col(file_col)] if file_col else [])))
    told = written(_located(rows.select("_places").distinct(), developments, file_col is not None).withColumnsRenamed({c: f"_{c}" for c in ("region", "developer", "dev_type")}))
    out = rows.join(told, "_places", "left").withColumn("community", F.col("_community"))
    by_reference = {c: empty(c) & F.col(f).isNotNull() for c, f in (("developer", "_developer"), ("community", "_region"), ("property_type", "_dev_type"))}
    known = empty("developer") & ~by_reference["developer"] & F.col("_known")
    note = lambda test, name: F.when(test, F.lit(name))
    return out.withColumns({
        "enriched_fields": F.array_compact(F.array(note(F.col("_from_file") | by_reference["community"], "community"), note(by_reference["developer"] | known, "developer"), note(by_reference["property_type"], "property_type"))),
        "developer": F.when(by_reference["developer"], F.col("_developer")).when(known, F.lit(V.KNOWN_DEVELOPER)).otherwise(F.nullif("developer", F.lit(""))),
        "community": F.when(by_reference["community"], F.col("_region")).otherwise(F.col("community")),
        "property_type": F.when(by_reference["property_type"], F.col("_dev_type")).otherwise(F.nullif("property_type", F.lit(""))),
    }).drop("_places", "_from_file", "_community", "_known", "_region", "_developer", "_dev_type")


def backfill_developers(records: DataFrame, developments: DataFrame, *, id_col: str, file_col: str | None = None) -> DataFrame:
    """Stored records with empty developers filled in; ``enriched_fields`` gains what was filled, once."""
    open_ = records.where("coalesce(developer, '') = ''")
    done = enrich(open_.drop("enriched_fields"), developments, file_col=file_col).select(id_col, F.col("developer").alias("_developer"), F.col("enriched_fields").alias("_more"))
    gained = F.when(F.col("_developer").isNotNull(), F.array(F.lit("developer"))).otherwise(F.array().cast("array<string>"))
    return records.join(done, id_col, "left").withColumns({
        "enriched_fields": F.array_union(F.coalesce("enriched_fields", F.array().cast("array<string>")), gained),
        "developer": F.coalesce(F.nullif("developer", F.lit("")), "_developer"),
    }).drop("_developer", "_more")
