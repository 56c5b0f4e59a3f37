"""All queries of the library over the tables of a folder, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.operators import dedup, enrich, indexes, maintain, names, quality, search, stats
from ledgerloom.plans import twins as S
from ledgerloom.plans import views
from ledgerloom.plans.pipeline import records_of
from ledgerloom.sources.shared import shared_root, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ROW = ("source_file", "source_row")


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple, str] = {}


def _inputs(spark: SparkSession, sf_dir: str, **more) -> tuple:
    """What the register is made of: the session, and a checksum over names, sizes and times of the files it is read from. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in ("customer", "nation")])
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return (spark.sparkContext.applicationId, sf_dir, *map(str, state), *more.items())


def ingested(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """The register as classified records, cleaned and judged anew and written to the shared folder."""
    key = _inputs(spark, sf_dir, **more)
    rows = written(records_of(views.register(spark, sf_dir), metric="levenshtein", **more))
    _STORED[key] = rows.inputFiles()[0].rsplit("/", 1)[0]
    return rows


def stored(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """The record table that the first query of a session ingests and the others read, as a service reads its stored records. Tables that have changed since are ingested again."""
    path = _STORED.get(_inputs(spark, sf_dir, **more))
    return spark.read.parquet(path) if path else ingested(spark, sf_dir, **more)


def records(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """The stored records, flags as one text."""
    return stored(spark, sf_dir, **more).withColumns({"id": F.col("source_row"), "validation_flags": F.concat_ws(",", "validation_flags")})


# ---- values -----------------------------------------------------------------------------------


@query(f"WITH {S.CLEANED} SELECT r.source_file, r.source_row, r.name AS raw_name, c.name, {S.text('r.building_cluster')} AS building_cluster FROM register r JOIN cleaned c USING (source_row)")
def clean_text_names(spark, sf_dir):
    return views.register(spark, sf_dir).select(*ROW, F.col("name").alias("raw_name"), C.clean_name(F.col("name")).alias("name"), C.clean_text(F.col("building_cluster")).alias("building_cluster"))


@query(f"WITH {S.CLEANED} SELECT source_row, mobile_1 AS raw, n1 AS num, f1 AS flag FROM numbers")
def phone_standardise(spark, sf_dir):
    return views.register(spark, sf_dir).select("source_row", F.col("mobile_1").alias("raw"), C.clean_phone(F.col("mobile_1")).alias("p")).select("source_row", "raw", "p.num", "p.flag")


@query(f"WITH {S.CLEANED} SELECT flag, count(*) AS n FROM (SELECT unnest([f1, f2, f3]) AS flag FROM numbers) WHERE flag IS NOT NULL GROUP BY flag")
def phone_flag_counts(spark, sf_dir):
    phones = F.array(*[C.clean_phone(F.col(f"mobile_{i}"))["flag"] for i in (1, 2, 3)])
    return views.register(spark, sf_dir).select(F.explode(phones).alias("flag")).where("flag IS NOT NULL").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.CLEANED} SELECT source_row, mobile_1, mobile_2, mobile_3 FROM cleaned")
def phone_slots(spark, sf_dir):
    slots = C.phone_slots(*[C.clean_phone(F.col(f"mobile_{i}")) for i in (1, 2, 3)])
    return views.register(spark, sf_dir).select("source_row", slots.alias("s")).select("source_row", "s.mobile_1", "s.mobile_2", "s.mobile_3")


@query(f"WITH {S.CLEANED} SELECT source_row, {S.email('email_address')[0]} AS email, {S.email('email_address')[1]} AS flag FROM register")
def email_standardise(spark, sf_dir):
    return views.register(spark, sf_dir).select("source_row", C.clean_email(F.col("email_address")).alias("e")).select("source_row", F.col("e.value").alias("email"), "e.flag")


@query(r"SELECT email, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}')) AS email FROM documents) GROUP BY email")
def email_mentions(spark, sf_dir):
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}"), F.lit(0)))
    return views.table(spark, sf_dir, "documents").select(found.alias("email")).groupBy("email").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.CLEANED} SELECT source_row, feet, {S.number('procedure_value')} AS procedure_value FROM sized")
def number_size_clean(spark, sf_dir):
    return views.register(spark, sf_dir).select("source_row", C.clean_size(F.col("size")).alias("feet"), C.clean_number(F.col("procedure_value")).alias("procedure_value"))


_FORMS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d"]


@query(f"SELECT o_orderkey, strftime(try_strptime(CASE o_orderkey % 8 {' '.join(f'WHEN {i} THEN strftime(o_orderdate, {chr(39)}{f}{chr(39)})' for i, f in enumerate(_FORMS))} END, [{', '.join(chr(39) + f + chr(39) for f in _FORMS)}]), '%Y-%m-%d %H:%M:%S') AS parsed FROM orders")
def date_parse_mixed(spark, sf_dir):
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd"]
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    shown = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        shown = F.when(F.col("o_orderkey") % 8 == i, F.date_format("at", form)).otherwise(shown)
    return orders.select("o_orderkey", shown.alias("shown")).select("o_orderkey", F.date_format(C.clean_date(F.col("shown")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT o_orderkey, strftime(TIMESTAMP '1899-12-30' + to_microseconds(CAST(round((o_orderkey % 70000 + 2 + 0.5) * 86400000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS day FROM orders")
def excel_serials(spark, sf_dir):
    days = F.col("o_orderkey") % 70_000 + 2 + F.lit(0.5)
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(C.excel_serial(days), "yyyy-MM-dd HH:mm:ss").alias("day"))


@query(f"WITH {S.CLEANED} SELECT source_row, {S.bedroom('bedroom')[0]} AS bedroom, {S.bedroom('bedroom')[1]} AS flag, {S.party('party_type')} AS party_type, {S.nationality('nationality')} AS nationality, {S.unit('unit_number')} AS unit_number FROM register")
def bedroom_party_nationality(spark, sf_dir):
    rows = views.register(spark, sf_dir).select("source_row", C.clean_bedroom(F.col("bedroom")).alias("b"), C.clean_party_type(F.col("party_type")).alias("party_type"), C.clean_nationality(F.col("nationality")).alias("nationality"), C.clean_unit(F.col("unit_number")).alias("unit_number"))
    return rows.select("source_row", F.col("b.value").alias("bedroom"), "b.flag", "party_type", "nationality", "unit_number")


@query(f"WITH {S.CLEANED} SELECT r.community AS raw, c.community, count(*) AS n FROM register r JOIN cleaned c USING (source_row) GROUP BY ALL")
def community_canonical(spark, sf_dir):
    rows = views.register(spark, sf_dir).select(F.col("community").alias("raw"), C.clean_community(F.col("community")).alias("community"))
    return rows.groupBy("raw", "community").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH f AS (SELECT DISTINCT source, concat('[Tag ', source, '] ', upper(source), '_villas-', CAST(n AS VARCHAR), ' (1) March 2022 done.xlsx') AS file FROM documents, (SELECT unnest([1, 2, 3]) AS n)),
s AS (SELECT file, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(file, '^\[.*?\]\s*(.*)\.[^.]*$', 1), '[\(\[\{{].*?[\)\]\}}]', ' ', 'g'), '(?i){S.V.FILE_NOISE}', ' ', 'g'), '[-_./\\]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM f)
SELECT file, CASE WHEN (s = upper(s)) <> (s = lower(s)) THEN array_to_string(list_transform(string_split(s, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE s END AS community FROM s""")
def filename_community(spark, sf_dir):
    sources = views.table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    file = F.concat(F.lit("[Tag "), "source", F.lit("] "), F.upper("source"), F.lit("_villas-"), F.col("n").cast("string"), F.lit(" (1) March 2022 done.xlsx"))
    return sources.select(file.alias("file")).select("file", C.filename_community(F.col("file")).alias("community"))


@query(f"WITH {S.CLEANED} SELECT source_row, {S.name_key('name')} AS name_key FROM cleaned")
def name_key(spark, sf_dir):
    return views.register(spark, sf_dir).select("source_row", C.name_key(C.clean_name(F.col("name"))).alias("name_key"))


@query(f"WITH {S.CLEANED} SELECT source_row, CASE WHEN community IS NOT NULL AND coalesce(unit_number, plot_number) IS NOT NULL THEN upper(community) || '|' || upper(coalesce(building_cluster, '')) || '|' || upper(coalesce(unit_number, plot_number)) END AS property_key FROM cleaned")
def property_key(spark, sf_dir):
    rows = quality.standardise(views.register(spark, sf_dir))
    return rows.select("source_row", C.property_key(F.col("community"), F.col("building_cluster"), F.col("unit_number"), F.col("plot_number")).alias("property_key"))


# ---- joins and enrichment ---------------------------------------------------------------------


@query(f"""WITH {views.OWNERS_SQL}, first AS (SELECT source_file, trim(pi_number) AS pi, unit_number, building_cluster, size, row_number() OVER (PARTITION BY source_file, trim(pi_number) ORDER BY source_row) AS r FROM properties)
SELECT o.source_row, coalesce(o.unit_number, f.unit_number) AS unit_number, coalesce(o.building_cluster, f.building_cluster) AS building_cluster, coalesce(o.size, f.size) AS size, f.pi IS NOT NULL AS property_merged
FROM owners o LEFT JOIN first f ON f.r = 1 AND o.source_file = f.source_file AND trim(o.pi_number) = f.pi""")
def owner_property_merge(spark, sf_dir):
    merged = enrich.merge_properties(views.owners(spark, sf_dir), views.properties(spark, sf_dir), ("unit_number", "building_cluster", "size"))
    return merged.select("source_row", "unit_number", "building_cluster", "size", "property_merged")


_BEST = f"""{views.DEVELOPMENTS_SQL},
keyed AS (SELECT *, {S.place_key('name')} AS ref_key, coalesce(CASE lower(confidence) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END, 0) + CASE WHEN developer IS NULL THEN 0 ELSE 2 END AS rank FROM developments),
best AS (SELECT ref_key, min(ord) OVER (PARTITION BY ref_key) AS ref_ord, name, region, developer, dev_type, row_number() OVER (PARTITION BY ref_key ORDER BY rank DESC, ord) AS r FROM keyed WHERE ref_key <> '' QUALIFY r = 1)"""


@query(f"WITH {_BEST} SELECT ref_key, ref_ord, name, region, developer, dev_type FROM best")
def reference_best(spark, sf_dir):
    return enrich.best_developments(views.developments(spark, sf_dir)).select("ref_key", "ref_ord", "dev.name", "dev.region", "dev.developer", "dev.dev_type")


_PLACES = "places AS (SELECT o_orderkey AS id, concat(CASE o_orderkey % 3 WHEN 0 THEN 'The ' ELSE '' END, CASE o_orderkey % 4 WHEN 0 THEN 'Sidra' WHEN 1 THEN 'Golf Place' WHEN 2 THEN 'Nowhere' ELSE 'Maple' END, ' ', CAST(o_orderkey % 60 AS STRING), CASE o_orderkey % 5 WHEN 0 THEN ' Villas East' ELSE '' END) AS project, CASE o_orderkey % 7 WHEN 0 THEN 'Rimal 3' END AS community FROM orders)"


@query(f"""WITH {_BEST}, {_PLACES},
cand AS (SELECT id, 0 AS pos, {S.place_key('project')} AS key FROM places UNION ALL SELECT id, 1, {S.place_key('community')} FROM places WHERE community IS NOT NULL),
parts AS (SELECT DISTINCT id, pos, 1 AS step, unnest(list_concat(string_split(key, ' '), list_transform(range(1, len(string_split(key, ' ')) + 1), lambda n: array_to_string(string_split(key, ' ')[1:n], ' ')))) AS ref_key FROM cand WHERE length(key) >= 5),
hits AS (SELECT id, 0 AS step, pos, ref_ord, b.name, developer FROM cand JOIN best b ON key = ref_key UNION ALL SELECT id, step, pos, ref_ord, b.name, developer FROM parts p JOIN best b ON p.ref_key = b.ref_key AND length(p.ref_key) >= 5)
SELECT id, name, developer, CASE step WHEN 0 THEN 'exact' ELSE 'contained' END AS matched_by FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, pos, ref_ord) = 1""")
def reference_match(spark, sf_dir):
    places = views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", _PLACES.split("AS id, ")[1].split(" AS project")[0] + " AS project", "CASE o_orderkey % 7 WHEN 0 THEN 'Rimal 3' END AS community")
    found = enrich.match_developments(places, enrich.best_developments(views.developments(spark, sf_dir)), id_col="id", candidates=F.array("project", "community"))
    return found.select("id", "dev.name", "dev.developer", "matched_by")


# names of the register's files have neither tags nor brackets nor words to leave out
_GUESS = r"array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(source_file, '\.[^.]*$', ''), '[-_./\\]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query(f"""WITH {_BEST}, {views.REGISTER_SQL}, guessed AS (SELECT *, nullif({_GUESS}, '') AS guess FROM register),
located AS (SELECT *, coalesce(community, '') = '' AND guess IS NOT NULL AS from_file, CASE WHEN coalesce(community, '') = '' THEN guess ELSE community END AS place FROM guessed),
cand AS ({' UNION ALL '.join(f"SELECT source_row AS id, {pos} AS pos, {S.place_key(c)} AS key FROM located WHERE {c} IS NOT NULL" for pos, c in enumerate(("project", "sub_community", "place", "building_cluster", "guess")))}),
keys AS (SELECT DISTINCT key FROM cand WHERE length(key) >= 5),
parts AS (SELECT DISTINCT key, unnest(list_concat(string_split(key, ' '), list_transform(range(1, len(string_split(key, ' ')) + 1), lambda n: array_to_string(string_split(key, ' ')[1:n], ' ')))) AS ref_key FROM keys),
found AS (SELECT key, 0 AS step, ref_ord, region, developer, dev_type FROM (SELECT DISTINCT key FROM cand) JOIN best ON key = ref_key UNION ALL SELECT key, 1, ref_ord, region, developer, dev_type FROM parts JOIN best USING (ref_key) WHERE length(ref_key) >= 5),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY key, step ORDER BY ref_ord) = 1),
hits AS (SELECT id, step, region AS r, developer AS d, dev_type AS t FROM cand JOIN firsts USING (key) QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, pos) = 1),
filled AS (SELECT source_row, from_file, step, coalesce(place, '') = '' AND r IS NOT NULL AS c_ref, coalesce(developer, '') = '' AND d IS NOT NULL AS d_ref, coalesce(property_type, '') = '' AND t IS NOT NULL AS t_ref, place, developer, property_type, r, d, t,
  regexp_matches(lower(concat_ws(' ', coalesce(place, ''), coalesce(sub_community, ''), coalesce(project, ''), coalesce(building_cluster, ''), coalesce(guess, ''))), '{'|'.join(S.V.KNOWN_SUBPROJECTS)}') AS sub FROM located LEFT JOIN hits ON source_row = id),
told AS (SELECT *, coalesce(developer, '') = '' AND NOT d_ref AND sub AS known FROM filled)
SELECT source_row, CASE WHEN c_ref THEN r ELSE place END AS community, CASE WHEN d_ref THEN d WHEN known THEN {S.quoted([S.V.KNOWN_DEVELOPER])} ELSE nullif(developer, '') END AS developer, CASE WHEN t_ref THEN t ELSE nullif(property_type, '') END AS property_type,
  array_to_string({S.compact("CASE WHEN from_file OR c_ref THEN 'community' END", "CASE WHEN d_ref OR known THEN 'developer' END", "CASE WHEN t_ref THEN 'property_type' END")}, ',') AS enriched_fields, CASE step WHEN 0 THEN 'exact' WHEN 1 THEN 'contained' END AS matched_by FROM told""")
def enrich_fill(spark, sf_dir):
    rows = enrich.enrich(views.register(spark, sf_dir), views.developments(spark, sf_dir))
    return rows.select("source_row", "community", "developer", "property_type", F.array_join("enriched_fields", ",").alias("enriched_fields"), "matched_by")


@query(f"WITH {S.CLEANED} SELECT source_row, CASE WHEN coalesce(developer, '') = '' AND regexp_matches(lower(concat_ws(' ', coalesce(community, ''), coalesce(sub_community, ''), coalesce(project, ''), coalesce(building_cluster, ''), 'Register')), '{'|'.join(S.V.KNOWN_SUBPROJECTS)}') THEN 'Emaar Properties' ELSE developer END AS developer FROM register")
def keyword_fallback(spark, sf_dir):
    return enrich.enrich(views.register(spark, sf_dir), None, file_col=None).select("source_row", "developer")


# ---- validation, duplicates, status -----------------------------------------------------------


@query(f"WITH {S.CHECKED} SELECT source_row, is_valid, has_context, array_to_string(flags2, ',') AS flags FROM checked")
def validate_flags(spark, sf_dir):
    rows = quality.validate(quality.standardise(views.register(spark, sf_dir)))
    return rows.select("source_row", "is_valid", "has_context", F.concat_ws(",", "validation_flags").alias("flags"))


@query(f"WITH {S.RECORDS} SELECT source_file, source_row, status, validation_flags FROM records")
def status_cascade(spark, sf_dir):
    return records(spark, sf_dir).select(*ROW, "status", "validation_flags")


@query(f"WITH {S.RECORDS} SELECT community, status, count(*) AS n FROM records GROUP BY ALL")
def status_by_community(spark, sf_dir):
    return records(spark, sf_dir).groupBy("community", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.RECORDS} SELECT source_row, CAST({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in quality.COUNTED)} AS INT) AS n FROM records")
def populated_fields(spark, sf_dir):
    return quality.standardise(views.register(spark, sf_dir)).select("source_row", quality.populated_fields().alias("n"))


@query(f"WITH {S.RECORDS} SELECT source_file, source_sheet, source_row, 'INVALID_RECORD' AS code, 'WARNING' AS severity, array_to_string(flags2, '; ') AS message FROM records WHERE status = 'INVALID'")
def error_rows(spark, sf_dir):
    return quality.error_rows(stored(spark, sf_dir)).select(*ROW, "source_sheet", "code", "severity", "message")


@query(f"WITH {S.RECORDS} SELECT source_file, CASE WHEN count(*) FILTER (status = 'INVALID') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS job_status FROM records GROUP BY source_file")
def job_outcome(spark, sf_dir):
    rows = stored(spark, sf_dir)
    return quality.job_outcome(quality.error_rows(rows), stats.run_counters(rows)).select("source_file", "job_status")


@query(f"WITH {S.CHECKED} SELECT source_row, identity_hash FROM checked")
def identity_hash(spark, sf_dir):
    return dedup.with_identity(quality.standardise(views.register(spark, sf_dir))).select("source_row", "identity_hash")


@query(f"WITH {S.RECORDS} SELECT source_row, duplicate_flag FROM records WHERE duplicate_flag = 'duplicate_identity_hash'")
def exact_duplicates(spark, sf_dir):
    return records(spark, sf_dir).where("duplicate_flag = 'duplicate_identity_hash'").select("source_row", "duplicate_flag")


@query(f"WITH {S.records('global')} SELECT source_file, count(*) FILTER (duplicate_flag = 'duplicate_identity_hash') AS n_duplicates FROM records GROUP BY source_file")
def cross_file_duplicates(spark, sf_dir):
    return records(spark, sf_dir, scope="global").groupBy("source_file").agg(F.count_if(F.col("duplicate_flag") == "duplicate_identity_hash").alias("n_duplicates"))


@query(f"WITH {S.CHECKED}, stored AS (SELECT DISTINCT identity_hash FROM checked WHERE copy = 0) SELECT source_row FROM checked WHERE copy > 0 AND identity_hash IN (SELECT identity_hash FROM stored)")
def known_identities(spark, sf_dir):
    rows = dedup.with_identity(quality.standardise(views.register(spark, sf_dir)))
    return dedup.known_identities(rows.where("copy > 0"), rows.where("copy = 0")).select("source_row")


@query(f"WITH {S.RECORDS} SELECT source_row, kind, floor(score * 1000 + 0.5) / 1000 AS score FROM near")
def near_dup_levenshtein(spark, sf_dir):
    found = stored(spark, sf_dir).where("fuzzy_match_score IS NOT NULL")
    return found.select("source_row", F.regexp_extract("duplicate_flag", "fuzzy_duplicate_(.*)_match", 1).alias("kind"), F.col("fuzzy_match_score").alias("score"))


# customers under made-up names of three parts
_NAMED = "upper(concat(CASE c_custkey % 5 WHEN 0 THEN 'Fatima' WHEN 1 THEN 'Mohammed' WHEN 2 THEN 'Karoline' WHEN 3 THEN 'Ines' ELSE 'Li' END, ' ', CASE c_custkey % 3 WHEN 0 THEN 'Okonkwo' WHEN 1 THEN 'Haddad' ELSE 'Wu' END, ' ', translate(CAST((c_custkey * 7919) % 1000 AS STRING), '0123456789', 'abeiklmost')))"


@query(f"""WITH keys AS (SELECT DISTINCT c_mktsegment, {_NAMED} AS key FROM customer)
SELECT c_mktsegment, a.key AS a, b.key AS b, floor((1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key))) * 1000 + 0.5) / 1000 AS score
FROM keys a JOIN keys b USING (c_mktsegment) WHERE a.key < b.key AND 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) >= 0.85""")
def similar_names(spark, sf_dir):
    """All pairs of similar names within a segment, by the index of rare pairs of letters."""
    keys = views.table(spark, sf_dir, "customer").select("c_mktsegment", F.expr(_NAMED).alias("key"))
    return names.similar_names(keys, ["c_mktsegment"], metric="levenshtein").withColumn("score", F.floor(F.col("score") * 1000 + 0.5) / 1000)


@query()
def near_dup_ratio(spark, sf_dir):
    rows = records_of(views.register(spark, sf_dir))
    return rows.where("fuzzy_match_score IS NOT NULL").select("source_row", "fuzzy_matched_row", "fuzzy_match_score", "duplicate_flag")


@query(f"WITH {S.RECORDS} SELECT source_file, source_row, status, duplicate_flag, identity_hash FROM records")
def ingest_records(spark, sf_dir):
    """The whole job over the register each time it is called; the queries on records read what it wrote."""
    return ingested(spark, sf_dir).select(*ROW, "status", "duplicate_flag", "identity_hash")


# ---- search -----------------------------------------------------------------------------------

_LIKE = lambda q: " OR ".join(f"coalesce({c} ILIKE '%{q}%', FALSE)" for c in search.SEARCHED)


@query(f"WITH {S.RECORDS} SELECT id, name, community FROM records WHERE ({_LIKE('rash')}) AND status = 'VALID'")
def search_text(spark, sf_dir):
    return search.search(records(spark, sf_dir), search.Search(text="rash")).select("id", "name", "community")


@query(f"WITH {S.RECORDS} SELECT id, status FROM records WHERE nationality = 'Egypt' AND property_type ILIKE 'VILLA' AND mobile_1 IS NOT NULL AND email_address IS NULL")
def search_filters(spark, sf_dir):
    spec = search.Search(equals=(("nationality", "Egypt"),), status="ALL", property_type="VILLA", has_mobile=True, has_email=False)
    return search.search(records(spark, sf_dir), spec).select("id", "status")


@query(f"WITH {S.RECORDS} SELECT id, name, community FROM records WHERE ({_LIKE('osman')}) AND status <> 'INVALID'")
def search_by_trigrams(spark, sf_dir):
    """A stored table with an index of trigrams beside it: only files that hold all trigrams of the text are read, and their rows tested."""
    root = f"{shared_root(spark)}/indexed-{uuid.uuid4().hex}"
    rows = records(spark, sf_dir)
    rows.where("status <> 'INVALID'").repartitionByRange("name").write.parquet(f"{root}/table")
    indexes.write_trigrams(spark, f"{root}/table", f"{root}/index")
    return indexes.indexed_search(spark, f"{root}/table", f"{root}/index", search.Search(text="OSMAN", status="ALL")).select("id", "name", "community")


@query(f"WITH {S.RECORDS} SELECT id, size, row_number() OVER (ORDER BY size DESC NULLS LAST, id DESC) AS rank FROM records WHERE status <> 'INVALID' QUALIFY rank > 120 AND rank <= 160")
def page_by_ordinals(spark, sf_dir):
    """The fourth page of forty by an index of the order: the ranges that hold it are read, and no others."""
    rows, spec = records(spark, sf_dir).where("status <> 'INVALID'"), search.Search(status="ALL", sort="size")
    root = f"{shared_root(spark)}/ordinals-{uuid.uuid4().hex}"
    indexes.write_ordinals(rows, spec, root, ranges=16)
    return indexes.page_at(rows, spec, root, 4, 40).select("id", "size", "rank")


_PAGE = search.Search(status="ALL", sort="size", descending=False)


@query(f"WITH {S.RECORDS}, p AS (SELECT id, size FROM records ORDER BY size ASC NULLS LAST, id DESC LIMIT 50 OFFSET 100) SELECT id, size, row_number() OVER (ORDER BY size ASC NULLS LAST, id DESC) AS rank FROM p")
def page_sorted(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = search.page(records(spark, sf_dir), _PAGE, number=3).select("id", "size")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").asc_nulls_last(), F.col("id").desc())).cast("bigint"))  # one page


@query(f"WITH {S.RECORDS} SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50) AS has_next, TRUE AS has_prev FROM records")
def page_counts(spark, sf_dir):
    return search.page_counts(records(spark, sf_dir), _PAGE, number=3)


@query(f"WITH {S.RECORDS}, v AS ({' UNION '.join(f'SELECT {chr(39)}{c}{chr(39)} AS field, CAST({c} AS VARCHAR) AS value FROM records' for c in search.FACETS)}) SELECT field, value FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY field ORDER BY value) <= 500")
def facets(spark, sf_dir):
    return search.facets(records(spark, sf_dir))


@query(f"WITH {S.RECORDS} SELECT id, bedroom AS bedroom_type, mobile_1 AS mobile, status AS record_status, format('{{:,.2f}}', size) || ' sq.ft' AS size_display FROM records")
def wire_names(spark, sf_dir):
    return search.wire_names(records(spark, sf_dir)).select("id", "bedroom_type", "mobile", "record_status", "size_display")


@query("SELECT o_custkey AS source_file_id, o_orderkey AS id, c_name AS filename FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def job_file_names(spark, sf_dir):
    jobs = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_file_id"), F.col("o_orderkey").alias("id"))
    files = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    return search.with_file_names(jobs, files)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY id DESC LIMIT 50 OFFSET 50")
def jobs_page(spark, sf_dir):
    return search.jobs_page(views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status"), status="F", number=2)


@query("SELECT l_orderkey AS id, floor(least(100.0, floor(1000 * l_linenumber / 7 + 0.5) / 10) * 10 + 0.5) / 10 AS progress_percent, CAST(ceil(7 / 2) AS BIGINT) AS total_batches, CAST(ceil(l_linenumber / 2) AS BIGINT) AS current_batch, l_linenumber AS line FROM lineitem")
def job_progress(spark, sf_dir):
    jobs = views.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "7 AS total_rows", "l_linenumber AS processed_rows", "0 AS invalid_rows", "2 AS batch_size")
    return search.job_progress(jobs).select("id", "line", "progress_percent", "total_batches", "current_batch")


# ---- statistics -------------------------------------------------------------------------------


def _q(sql: str) -> str:
    return f"WITH {S.RECORDS} {sql}"


@query(_q("SELECT status, count(*) AS n FROM records GROUP BY status"))
def status_counts(spark, sf_dir):
    return stats.status_counts(records(spark, sf_dir))


@query(_q("SELECT community, count(*) AS n FROM records WHERE community IS NOT NULL GROUP BY community ORDER BY n DESC, community LIMIT 10"))
def top_communities(spark, sf_dir):
    return stats.top_values(records(spark, sf_dir))


@query(_q(" UNION ALL ".join(f"SELECT '{c}' AS field, floor(1000 * count({c}) / count(*) + 0.5) / 10 AS percent FROM records" for c in stats.MEASURED)))
def completeness(spark, sf_dir):
    return stats.completeness(records(spark, sf_dir))


@query(_q("SELECT count(*) AS total, count(*) FILTER (status = 'VALID') AS valid, floor(1000 * count(*) FILTER (status = 'VALID') / count(*) + 0.5) / 10 AS success_rate FROM records"))
def success_rate(spark, sf_dir):
    return stats.success_rate(records(spark, sf_dir))


@query(_q("SELECT count(*) AS records, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'DUPLICATE') AS duplicate_records, count(DISTINCT source_file) AS files, count(*) FILTER (status = 'DUPLICATE') AS duplicate_rows, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'INVALID') AS errors FROM records"))
def totals(spark, sf_dir):
    rows = records(spark, sf_dir)
    return stats.totals(rows, stats.run_counters(rows), rows.where("status = 'INVALID'"))


_ERRORS = "errors AS (SELECT event_type AS code, CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('Sheet', CAST(user_id % 5 AS STRING)) END AS source_sheet, CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity FROM events)"


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr("event_type AS code", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('Sheet', CAST(user_id % 5 AS STRING)) END AS source_sheet", "CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'WARNING' END AS severity")


@query(f"WITH {_ERRORS} SELECT 'code' AS by, code AS value, count(*) AS n FROM errors GROUP BY code UNION ALL SELECT 'sheet', coalesce(source_sheet, 'File Level'), count(*) FROM errors GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM errors GROUP BY severity UNION ALL SELECT 'total', 'all', count(*) FROM errors")
def error_breakdown(spark, sf_dir):
    return stats.error_breakdown(_events(spark, sf_dir))


@query(f"WITH {_ERRORS} SELECT code, count(*) AS n FROM errors GROUP BY code ORDER BY n DESC, code LIMIT 20")
def top_errors(spark, sf_dir):
    return stats.top_errors(_events(spark, sf_dir))


@query(_q("""SELECT property_key, count(DISTINCT name) AS owner_count, count(*) AS n_records, p[1] AS mobile_1, p[2] AS mobile_2, p[3] AS mobile_3 FROM (
SELECT *, upper(community) || '|' || upper(coalesce(building_cluster, '')) || '|' || upper(coalesce(unit_number, plot_number)) AS property_key FROM records) r
LEFT JOIN (SELECT property_key AS pk, list(mobile_1 ORDER BY first_at) AS p FROM (SELECT property_key, mobile_1, min(row(source_file, source_row)) AS first_at FROM (SELECT *, upper(community) || '|' || upper(coalesce(building_cluster, '')) || '|' || upper(coalesce(unit_number, plot_number)) AS property_key FROM records) WHERE mobile_1 IS NOT NULL AND property_key IS NOT NULL GROUP BY ALL) GROUP BY property_key) ON pk = property_key
WHERE property_key IS NOT NULL GROUP BY property_key, p"""))
def property_grain(spark, sf_dir):
    return stats.property_grain(records(spark, sf_dir))


@query(_q("SELECT source_file, count(*) AS total, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'INCOMPLETE') AS incomplete, count(*) FILTER (status = 'DUPLICATE') AS duplicate, count(*) FILTER (status = 'INVALID') AS invalid FROM records GROUP BY source_file"))
def run_counters(spark, sf_dir):
    return stats.run_counters(records(spark, sf_dir))


@query(_q("SELECT CASE WHEN grouping(source_file) = 1 THEN 'ALL' ELSE source_file END AS source_file, count(*) AS total, count(*) FILTER (status = 'VALID') AS valid, count(DISTINCT identity_hash) AS identities FROM records GROUP BY ROLLUP (source_file)"))
def bulk_report(spark, sf_dir):
    return stats.bulk_report(records(spark, sf_dir))


# ---- maintenance and edits --------------------------------------------------------------------

_FULL = lambda c: f"coalesce(trim(CAST({c} AS VARCHAR)) <> '', FALSE)"
_ANY = lambda *cs: "(" + " OR ".join(map(_FULL, cs)) + ")"
_NOISY = f"coalesce(upper(trim(community)) IN ({S.quoted(maintain.NOISE_TITLES)}) OR upper(trim(community)) LIKE 'OWNERS DATA #%', FALSE)"
_PLACE = f"({_FULL('community')} AND NOT {_NOISY})"


def _raw_states(spark, sf_dir):
    """Records whose communities are as written, so that the noise rules have work."""
    rows = records(spark, sf_dir)
    return rows.withColumn("community", F.when(F.col("source_row") % 3 == 0, F.lit("Total Owner Details")).when(F.col("source_row") % 7 == 0, F.lit("owners data #12")).otherwise(F.col("community")))


_RAW = f"{S.RECORDS}, states AS (SELECT * REPLACE (CASE WHEN source_row % 3 = 0 THEN 'Total Owner Details' WHEN source_row % 7 = 0 THEN 'owners data #12' ELSE community END AS community) FROM records)"


@query(f"WITH {_RAW} SELECT id, CASE WHEN status = 'INVALID' THEN status WHEN {_FULL('name')} AND {_ANY('mobile_1', 'mobile_2', 'mobile_3', 'email_address')} THEN 'VALID' ELSE 'INCOMPLETE' END AS status FROM states")
def reclassify_contact(spark, sf_dir):
    return maintain.reclassify_contact(_raw_states(spark, sf_dir)).select("id", "status")


def _policy(test: str) -> str:
    return f"WITH {_RAW} SELECT id, CASE WHEN status = 'VALID' AND NOT ({test}) THEN 'INCOMPLETE' ELSE status END AS status FROM states"


@query(_policy(f"{_ANY('unit_number', 'plot_number', 'building_cluster', 'pi_number', 'sub_community', 'project', 'developer')} OR {_PLACE}"))
def reclassify_sparse(spark, sf_dir):
    return maintain.reclassify(_raw_states(spark, sf_dir), "property").select("id", "status")


@query(_policy(f"{_FULL('name')} AND {_ANY('mobile_1', 'mobile_2', 'mobile_3', 'email_address')} AND ({_ANY('unit_number', 'plot_number', 'pi_number')} OR ({_FULL('building_cluster')} AND {_PLACE}) OR ({_FULL('developer')} AND ({_PLACE} OR {_FULL('project')})))"))
def reclassify_registry(spark, sf_dir):
    return maintain.reclassify(_raw_states(spark, sf_dir), "registry").select("id", "status")


@query(_policy(" + ".join(f"CAST({_PLACE if c == 'community' else _FULL(c)} AS INT)" for c in maintain.FIVE_OF) + " >= 5"))
def five_fields(spark, sf_dir):
    return maintain.reclassify(_raw_states(spark, sf_dir), "five_fields").select("id", "status")


@query(_policy(f"{_ANY('unit_number', 'plot_number', 'pi_number')} OR ({_FULL('building_cluster')} AND {_PLACE}) OR ({_FULL('developer')} AND {_FULL('project')})"))
def reclassify_no_property(spark, sf_dir):
    return maintain.reclassify(_raw_states(spark, sf_dir), "no_property").select("id", "status")


@query(f"WITH {_RAW} SELECT id, CASE WHEN NOT {_NOISY} THEN community END AS community FROM states")
def clear_noise(spark, sf_dir):
    return maintain.clear_noise(_raw_states(spark, sf_dir)).select("id", "community")


@query(f"WITH {_RAW} SELECT status AS old, CASE WHEN status = 'VALID' AND NOT ({' + '.join(f'CAST({_PLACE if c == "community" else _FULL(c)} AS INT)' for c in maintain.FIVE_OF)} >= 5) THEN 'INCOMPLETE' ELSE status END AS new, count(*) AS n FROM states GROUP BY ALL")
def status_changes(spark, sf_dir):
    before = _raw_states(spark, sf_dir)
    return stats.status_changes(before, maintain.reclassify(before, "five_fields"))


@query(_q("SELECT source_file, count(*) AS n FROM records WHERE source_file <> 'register_2.csv' GROUP BY source_file"))
def without_files(spark, sf_dir):
    rows = records(spark, sf_dir)
    gone = views.register(spark, sf_dir).where("source_file = 'register_2.csv'").select("source_file")
    return maintain.without_files(rows, gone).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


_EDITS = "edits AS (SELECT user_id AS record_id, CASE event_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'mobile_1' WHEN 2 THEN 'developer' ELSE 'bedroom' END AS field, CASE event_id % 12 WHEN 0 THEN '  Jane   Doe ' WHEN 1 THEN '050-999-8877' WHEN 2 THEN 'n/a' WHEN 3 THEN '5 BHK' WHEN 4 THEN 'Name' WHEN 5 THEN 'abc' WHEN 6 THEN 'Emaar' WHEN 7 THEN '40' WHEN 8 THEN NULL ELSE 'Studio flat' END AS value, event_id AS ord FROM events)"


def _edits(spark, sf_dir):
    return views.table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {c}" for x, c in (("user_id", "record_id"), (_EDITS.split("record_id, ")[1].split(" AS field")[0], "field"), (_EDITS.split("AS field, ")[1].split(" AS value")[0], "value"), ("event_id", "ord"))])


_CHANGES = f"""{S.RECORDS}, {_EDITS}, last AS (SELECT record_id, field, value FROM edits QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY ord DESC) = 1),
phone_parts AS (SELECT *, {S.phone_steps('value', 1)} FROM last), phone_new AS (SELECT *, {S.phone('value', 1)} FROM phone_parts),
fresh AS (SELECT record_id, field, CASE field WHEN 'name' THEN {S.name('value')} WHEN 'mobile_1' THEN n1 WHEN 'developer' THEN {S.text('value')} ELSE {S.bedroom('value')[0]} END AS new FROM phone_new),
changes AS (SELECT record_id, field, CASE field WHEN 'name' THEN r.name WHEN 'mobile_1' THEN r.mobile_1 WHEN 'developer' THEN r.developer ELSE r.bedroom END AS old, new FROM fresh JOIN records r ON record_id = r.id WHERE old IS DISTINCT FROM new)"""


@query(f"WITH {_CHANGES} SELECT record_id, field, old, new FROM changes")
def edit_log(spark, sf_dir):
    return maintain.changes(records(spark, sf_dir), _edits(spark, sf_dir))


@query(f"""WITH {_CHANGES}, sets AS (SELECT record_id, list(field) AS fields, max(new) FILTER (field = 'name') AS s_name, max(new) FILTER (field = 'mobile_1') AS s_mobile, max(new) FILTER (field = 'developer') AS s_developer, max(new) FILTER (field = 'bedroom') AS s_bedroom FROM changes GROUP BY record_id),
edited AS (SELECT r.* EXCLUDE (person, place, has_context, identity_hash) REPLACE (CASE WHEN list_contains(fields, 'name') THEN s_name ELSE name END AS name, CASE WHEN list_contains(fields, 'mobile_1') THEN s_mobile ELSE mobile_1 END AS mobile_1, CASE WHEN list_contains(fields, 'developer') THEN s_developer ELSE developer END AS developer, CASE WHEN list_contains(fields, 'bedroom') THEN s_bedroom ELSE bedroom END AS bedroom), s.record_id IS NOT NULL AS changed FROM records r LEFT JOIN sets s ON r.id = s.record_id)
SELECT id, name, mobile_1, developer, bedroom, identity_hash, CASE WHEN NOT changed THEN status WHEN NOT person AND NOT place THEN 'INVALID' WHEN name IS NOT NULL AND (mobile_1 IS NOT NULL OR email_address IS NOT NULL) AND has_context THEN 'VALID' ELSE 'INCOMPLETE' END AS status FROM ({S.validated('edited')})""")
def apply_edits(spark, sf_dir):
    rows = stored(spark, sf_dir).withColumn("id", F.col("source_row"))
    return maintain.apply_edits(rows, _edits(spark, sf_dir)).select("id", "name", "mobile_1", "developer", "bedroom", "identity_hash", "status")


from ledgerloom.plans import catalogue_service, catalogue_sheets  # noqa: E402, F401  (these register the queries on raw sheets, files, the older loader and the record service)
