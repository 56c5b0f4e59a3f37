"""Queries on what a record service keeps: single records, errors, edits, mappings, job lists, stored tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V
from ledgerloom.operators import enrich, legacy, maintain, mapping, quality, search, stats
from ledgerloom.plans import twins as S
from ledgerloom.plans import views
from ledgerloom.plans.catalogue import _BEST, _CHANGES, _edits, query, records
from ledgerloom.sources import files, sinks
from ledgerloom.sources.shared import shared_root, spread


def _new_folder(spark) -> str:
    return f"{shared_root(spark)}/query-{uuid.uuid4().hex}"


# ---- records, errors, edits -------------------------------------------------------------------


@query(f"WITH {S.RECORDS} SELECT id, name, community, status, validation_flags FROM records WHERE id = 42")
def record_lookup(spark, sf_dir):
    return search.record(records(spark, sf_dir), 42).select("id", "name", "community", "status", "validation_flags")


_JOB_ERRORS = [("event_id", "id"), ("user_id % 7", "job_id"), ("event_type", "code"), ("CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'WARNING' END", "severity")]


@query(f"SELECT * FROM (SELECT {', '.join(f'{x} AS {c}' for x, c in _JOB_ERRORS)} FROM events) WHERE job_id = 3 AND severity = 'WARNING' ORDER BY id LIMIT 50 OFFSET 50")
def job_errors(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(*[f"{x} AS {c}" for x, c in _JOB_ERRORS])
    return search.errors_page(rows, 3, severity="WARNING", number=2)


@query(f"WITH {_CHANGES} SELECT field, old, new, 'clerk ' || CAST(record_id % 3 AS VARCHAR) AS edited_by FROM changes WHERE record_id = 13")
def edit_history(spark, sf_dir):
    log = maintain.edit_log(records(spark, sf_dir), _edits(spark, sf_dir), F.concat(F.lit("clerk "), (F.col("record_id") % 3).cast("string")), F.current_timestamp())
    return search.edit_history(log, 13).select("field", "old", "new", "edited_by")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY id DESC LIMIT 10")
def latest_jobs(spark, sf_dir):
    return stats.latest_jobs(views.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status"))


@query(f"WITH {S.RECORDS} SELECT id, name, status FROM records WHERE {' OR '.join(f'coalesce({c} ILIKE {chr(39)}%al%{chr(39)}, FALSE)' for c in legacy.SEARCHED)}")
def legacy_search(spark, sf_dir):
    """The older service's search: six columns, every status."""
    return search.search(records(spark, sf_dir), search.Search(text="al", status="ALL", columns=legacy.SEARCHED)).select("id", "name", "status")


@query(f"WITH {S.RECORDS}, c AS (SELECT count(*) AS total, count(*) FILTER (status = 'VALID') AS valid FROM records WHERE source_file = 'register_9.csv') SELECT total, valid, CASE WHEN total > 0 THEN floor(1000 * valid / total + 0.5) / 10 ELSE 100.0 END AS success_rate FROM c")
def success_rate_of_none(spark, sf_dir):
    """The older service's share for a file without records is 100."""
    return stats.success_rate(records(spark, sf_dir).where("source_file = 'register_9.csv'"), empty=100.0)


@query(f"WITH {S.CLEANED} SELECT source_row, coalesce(CASE WHEN mobile_1 LIKE '+971%' THEN regexp_matches(mobile_1, '^.971({'|'.join(V.MOBILE_PREFIXES)})') WHEN mobile_1 LIKE '971%' THEN substr(mobile_1, 4, 2) IN ({S.quoted(V.MOBILE_PREFIXES)}) ELSE mobile_1 <> '' END, FALSE) AS is_mobile FROM cleaned")
def mobile_numbers(spark, sf_dir):
    return records(spark, sf_dir).select("source_row", C.is_mobile(F.col("mobile_1")).alias("is_mobile"))


# a value for each editable field, of a dozen kinds
_VALUES = "CASE (c_custkey // 3) % 12 WHEN 0 THEN '  Jane   Doe ' WHEN 1 THEN '050-999-8877' WHEN 2 THEN 'n/a' WHEN 3 THEN '5 BHK' WHEN 4 THEN '120 sqm' WHEN 5 THEN 'X@Y.com' WHEN 6 THEN 'Emaar' WHEN 7 THEN '40' WHEN 8 THEN NULL WHEN 9 THEN '2021-03-04' WHEN 10 THEN 'dubai hills' ELSE 'INDIA' END"
_CLEAN = {c: S.text("value") for c in maintain.EDITABLE}
_CLEAN |= {"name": S.name("value"), "community": S.community("value"), "unit_number": S.unit("value"), "plot_number": S.unit("value"), "nationality": S.nationality("value"), "mobile_1": "n1", "mobile_2": "n1", "mobile_3": "n1"}
_CLEAN |= {"email_address": S.email("value")[0], "bedroom": S.bedroom("value")[0], "size": f"CAST({S.size('value')} AS VARCHAR)", "procedure_value": f"CAST({S.number('value')} AS VARCHAR)", "record_date": f"strftime({S.date('value')}, '%Y-%m-%d %H:%M:%S')"}


@query(f"""WITH v AS (SELECT c_custkey, {_VALUES} AS value, unnest([{S.quoted(maintain.EDITABLE)}]) AS field FROM customer), parts AS (SELECT *, {S.phone_steps('value', 1)} FROM v), phones AS (SELECT *, {S.phone('value', 1)} FROM parts)
SELECT c_custkey, field, value, CASE field {' '.join(f"WHEN '{c}' THEN {e}" for c, e in _CLEAN.items())} END AS cleaned FROM phones""")
def edit_values(spark, sf_dir):
    """What an edit of each of the editable fields stores for a value."""
    value = F.expr(_VALUES.replace("(c_custkey // 3)", "(c_custkey DIV 3)"))
    rows = spread(views.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", value.alias("value"), F.explode(F.array(*map(F.lit, maintain.EDITABLE))).alias("field"))
    return rows.select("c_custkey", "field", "value", maintain.cleaned_value(F.col("field"), F.col("value")).alias("cleaned"))


# ---- mappings ---------------------------------------------------------------------------------

_HEADER = "upper(trim(regexp_replace(replace(coalesce({0}, ''), chr(96), chr(39)), '\\s+', ' ', 'g')))"
_ALIASES = "aliases AS (SELECT upper(trim(p_name)) AS header_norm, CASE p_size % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'Project' ELSE 'Size' END AS target, CAST(min(p_partkey) AS INT) AS ord FROM part GROUP BY ALL)"


def _aliases(spark, sf_dir):
    """Part names as headings, each under the targets that the sizes of its parts name."""
    rows = views.table(spark, sf_dir, "part").selectExpr("upper(trim(p_name)) AS header_norm", "CASE p_size % 3 WHEN 0 THEN 'Name' WHEN 1 THEN 'Project' ELSE 'Size' END AS target", "p_partkey")
    return rows.groupBy("header_norm", "target").agg(F.min("p_partkey").cast("int").alias("ord"))


@query(f"""WITH {_ALIASES}, more AS (SELECT header_norm, target FROM aliases UNION SELECT 'TENANT', 'Name'), fewer AS (SELECT * FROM more WHERE NOT (header_norm = (SELECT min(header_norm) FROM aliases) AND target = 'Size'))
SELECT target, count(*) AS n_aliases, array_to_string(list(header_norm ORDER BY header_norm), '|') AS headers FROM fewer GROUP BY target""")
def alias_edits(spark, sf_dir):
    """An alias added twice, another removed, and the catalogue after that."""
    table = _aliases(spark, sf_dir)
    first = table.agg(F.min("header_norm")).first()[0]
    table = mapping.add_alias(mapping.add_alias(table, " Tenant ", "Name"), "tenant", "Name")
    return mapping.alias_catalogue(mapping.remove_alias(table, first, "Size")).select("target", "n_aliases", F.array_join("headers", "|").alias("headers"))


@query(f"WITH {_ALIASES}, first AS (SELECT header_norm, arg_min(target, ord) AS target FROM aliases GROUP BY header_norm) SELECT c_custkey, c.header, target, CASE WHEN target IS NULL THEN 0 ELSE 100 END AS confidence FROM (SELECT c_custkey, concat(' ', CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE p_name END) AS header FROM customer LEFT JOIN part ON p_partkey = c_custkey) c LEFT JOIN first ON upper(trim(c.header)) = header_norm")
def legacy_headers(spark, sf_dir):
    """Headings by the older loader's exact match."""
    part = views.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = views.table(spark, sf_dir, "customer").join(part, F.col("p_partkey") == F.col("c_custkey"), "left")
    header = F.concat(F.lit(" "), F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("p_name")), F.lit("")))
    return legacy.map_header(rows.select("c_custkey", header.alias("header")), _aliases(spark, sf_dir))


# a sheet a supplier, with seven headings; what a heading maps to depends on the supplier's nation
_SHEET_HEADS = ["concat('Owner ', CASE s_nationkey % 2 WHEN 0 THEN ' Name' ELSE 'Names' END)", "CASE s_nationkey % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'Passport' ELSE 'Contact no.' END", "'Premise 1'", "CASE s_nationkey % 3 WHEN 0 THEN 'premise 2' WHEN 1 THEN ' ' ELSE 'Floor' END", "'Owners_Phone'", "s_name", "CASE s_nationkey % 5 WHEN 0 THEN 'PROJECT' WHEN 1 THEN 'Size' ELSE 'Password' END"]
_NORM = _HEADER.format("header")


@query(f"""WITH cells AS (SELECT s_suppkey, unnest([{', '.join(_SHEET_HEADS)}]) AS header, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) - 1 AS idx FROM supplier), named AS (SELECT *, {_NORM} AS h FROM cells),
kinds AS (SELECT *, {S.table(V.ALIASES, 'h')} AS alias, CASE WHEN s_suppkey % 10 = 3 AND idx = 5 THEN 'Unit Number' WHEN s_suppkey % 10 = 4 AND h IN ('PASSPORT', 'PASSWORD') THEN 'Name' END AS override FROM named),
kept AS (SELECT *, CASE WHEN h = '' THEN 'blank' WHEN h IN ({S.quoted(V.EXCLUDED_HEADERS)}) THEN 'excluded' WHEN override IS NOT NULL THEN 'mapped' WHEN h = 'PREMISE 1' THEN 'premise' WHEN h IN ('PREMISE 2', 'PREMISE 3') THEN 'skipped' WHEN h = 'OWNERS_PHONE' THEN 'phones'
  WHEN h IN ({S.quoted(V.ASIDE_HEADERS)}) THEN 'aside' WHEN alias IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS disposition FROM kinds)
SELECT s_suppkey, CAST(idx AS INT) AS idx, header, disposition, CASE WHEN disposition = 'mapped' THEN coalesce(override, alias) END AS target, CASE {' '.join(f'WHEN h IN ({S.quoted(hs)}) THEN {r}' for r, hs in V.RANKS.items())} ELSE {V.DEFAULT_RANK} END AS rank FROM kept""")
def column_plan_overrides(spark, sf_dir):
    """The column plan of a sheet a supplier; overrides win over all but exclusion."""
    suppliers = views.table(spark, sf_dir, "supplier").withColumns({"source_file": F.col("s_suppkey").cast("string"), "source_sheet": F.lit("S")})
    heads = suppliers.select(*mapping.SHEET, F.array(*map(F.expr, _SHEET_HEADS)).alias("header"))
    named = suppliers.where("s_suppkey % 10 = 3").select(*mapping.SHEET, C.normal_header(F.col("s_name")).alias("header_norm"), F.lit("Unit Number").alias("target"))
    private = suppliers.where("s_suppkey % 10 = 4").select(*mapping.SHEET, F.explode(F.array(F.lit("PASSPORT"), F.lit("PASSWORD"))).alias("header_norm"), F.lit("Name").alias("target"))
    plan = mapping.plan_columns(heads, mapping.alias_table(spark), overrides=named.unionByName(private))
    return plan.select(F.col("source_file").cast("bigint").alias("s_suppkey"), "idx", "header", "disposition", "target", "rank")


@query("SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'Owners Data #' WHEN 1 THEN ' owner data ' WHEN 2 THEN '' ELSE p_brand END, CASE WHEN p_partkey % 5 < 3 THEN CAST(p_size AS VARCHAR) ELSE '' END) AS name, p_partkey % 5 > 2 AS acceptable FROM part")
def acceptable_names(spark, sf_dir):
    name = F.expr("concat(CASE p_partkey % 5 WHEN 0 THEN 'Owners Data #' WHEN 1 THEN ' owner data ' WHEN 2 THEN '' ELSE p_brand END, CASE WHEN p_partkey % 5 < 3 THEN CAST(p_size AS STRING) ELSE '' END)")
    return views.table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", mapping.acceptable("Name", F.col("name")).alias("acceptable"))


_CELLS = ["c_name", "CASE c_custkey % 3 WHEN 0 THEN 'Mobile' WHEN 1 THEN '+971 50 1234567' END", "CASE c_custkey % 4 WHEN 0 THEN '1,200.5' WHEN 1 THEN repeat('heading ', 9) ELSE '  ' END", "CASE c_custkey % 5 WHEN 0 THEN 'a@b.com' WHEN 1 THEN '2020-01-02' WHEN 2 THEN c_mktsegment END"]
_CELL_SCORES = "CASE WHEN trim(c) = '' OR c IS NULL THEN 0.0 WHEN regexp_matches(c, '[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}') OR regexp_matches(c, '^[\\d\\s+\\-|().]{7,}$') OR regexp_matches(c, '^\\d{4}-\\d{2}-\\d{2}') OR try_cast(replace(c, ',', '') AS DOUBLE) IS NOT NULL THEN -1.0 WHEN length(c) > 60 THEN 0.0 ELSE 1.0 END"


@query(f"""WITH cells AS (SELECT c_custkey, unnest([{', '.join(_CELLS)}]) AS c FROM customer)
SELECT c_custkey, CASE WHEN count(*) FILTER (trim(coalesce(c, '')) <> '') < 2 THEN -1.0 ELSE sum(CAST({_CELL_SCORES} AS DOUBLE)) END AS score FROM cells GROUP BY c_custkey""")
def header_scores(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select("c_custkey", mapping.header_score(F.array(*map(F.expr, _CELLS))).alias("score"))


_REGISTER_CELLS = ["CASE WHEN c_nationkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'x' ELSE '1,' || CAST(c_custkey AS STRING) END"] + [f"'c{i}'" for i in range(1, 6)] + ["CASE WHEN c_nationkey % 4 = 2 THEN CAST(c_custkey AS STRING) ELSE c_name END"]


@query(f"""WITH cells AS (SELECT c_nationkey, {_REGISTER_CELLS[0]} AS a, {_REGISTER_CELLS[6]} AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_nationkey, '{'|'.join(V.OWNER_REGISTER)}' AS header FROM cells WHERE r <= 50 AND c_nationkey % 5 <> 4 GROUP BY c_nationkey HAVING count(*) >= 3 AND avg(CAST(try_cast(replace(a, ',', '') AS DOUBLE) IS NOT NULL AS INT)) >= 0.8 AND avg(CAST(regexp_matches(b, '[A-Za-z]') AS INT)) >= 0.7""")
def owner_register_sheets(spark, sf_dir):
    """A headerless sheet a nation, 25 columns wide (24 for each fifth): those that are owner registers get their headings."""
    cells = F.array(*map(F.expr, _REGISTER_CELLS), *[F.lit(f"c{i}") for i in range(7, 24)])
    wide = F.when(F.col("c_nationkey") % 5 == 4, cells).otherwise(F.concat(cells, F.array(F.lit("c24"))))
    raw = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("source_file"), F.lit("S").alias("source_sheet"), F.col("c_custkey").alias("source_row"), wide.alias("cells"))
    bare = raw.select(*mapping.SHEET).distinct().withColumns({"header_row": F.lit(-1), "header": F.lit(None).cast("array<string>")})
    found = mapping.positional_headers(raw, bare, mapping.samples(raw, bare))
    return found.select(F.col("source_file").cast("int").alias("c_nationkey"), F.array_join("header", "|").alias("header"))


@query("SELECT p_partkey, p_size % 2 = 0 AND (CAST(p_partkey % 3 <> 0 AS INT) + CAST(p_partkey % 4 < 2 AS INT) + 1) >= 2 AS is_building FROM part")
def building_rows(spark, sf_dir):
    extras = F.create_map(F.lit(" Levels"), F.when(F.col("p_partkey") % 3 != 0, F.lit("4")), F.lit("SHOPS"), F.when(F.col("p_partkey") % 4 < 2, F.lit("2")).otherwise("0"), F.lit("flats"), F.lit("9"), F.lit("Floor"), F.lit("7"))
    unit = F.when(F.col("p_size") % 2 != 0, F.lit("12"))
    return views.table(spark, sf_dir, "part").select("p_partkey", mapping.is_building_row(unit, extras).alias("is_building"))


# ---- joins, stacks, stored tables -------------------------------------------------------------


@query(f"WITH {views.OWNERS_SQL} SELECT source_row, source_file FROM properties WHERE source_file NOT IN (SELECT source_file FROM owners WHERE source_file <> 'dld_3')")
def unmerged_properties(spark, sf_dir):
    """Property rows of a file without owners stay records."""
    return enrich.merged_away(views.properties(spark, sf_dir), views.owners(spark, sf_dir).where("source_file <> 'dld_3'")).select("source_row", "source_file")


_OPEN = [("o_orderkey", "id"), ("concat(CASE o_orderkey % 4 WHEN 0 THEN 'Sidra' WHEN 1 THEN 'Golf Place' WHEN 2 THEN 'Nowhere' ELSE 'Rimal' END, ' ', CAST(o_orderkey % 60 AS STRING))", "project"), ("CASE o_orderkey % 7 WHEN 0 THEN 'Rimal 3' END", "community"), ("CAST(NULL AS STRING)", "sub_community"), ("CAST(NULL AS STRING)", "building_cluster"), ("CAST(NULL AS STRING)", "property_type"), ("CASE o_orderkey % 5 WHEN 0 THEN 'Own Developer' WHEN 1 THEN '' END", "developer")]


@query(f"""WITH {_BEST}, rows AS (SELECT {', '.join(f'{e} AS {c}' for e, c in _OPEN)} FROM orders),
cand AS (SELECT id, 0 AS pos, {S.place_key('project')} AS key FROM rows UNION ALL SELECT id, 1, {S.place_key('community')} FROM rows WHERE community IS NOT NULL),
parts AS (SELECT DISTINCT id, pos, unnest(list_concat(string_split(key, ' '), list_transform(range(1, len(string_split(key, ' ')) + 1), lambda n: array_to_string(string_split(key, ' ')[1:n], ' ')))) AS ref_key FROM cand WHERE length(key) >= 5),
hits AS (SELECT id, 0 AS step, pos, ref_ord, developer FROM cand JOIN best b ON key = ref_key UNION ALL SELECT id, 1, pos, ref_ord, developer FROM parts p JOIN best b ON p.ref_key = b.ref_key AND length(p.ref_key) >= 5),
found AS (SELECT id, developer AS dev FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, pos, ref_ord) = 1),
done AS (SELECT r.id, nullif(r.developer, '') AS old, coalesce(dev, CASE WHEN regexp_matches(lower(concat_ws(' ', coalesce(community, ''), '', project, '')), '{'|'.join(S.V.KNOWN_SUBPROJECTS)}') THEN '{V.KNOWN_DEVELOPER}' END) AS new FROM rows r LEFT JOIN found USING (id))
SELECT id, coalesce(old, new) AS developer, CASE WHEN id % 2 = 0 THEN CASE WHEN old IS NULL AND new IS NOT NULL THEN 'community,developer' ELSE 'community' END WHEN old IS NULL AND new IS NOT NULL THEN 'developer' ELSE '' END AS enriched_fields FROM done""")
def backfill_developers(spark, sf_dir):
    """Stored records without a developer filled from the reference and by keyword."""
    rows = views.table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for e, c in _OPEN])
    rows = rows.withColumn("enriched_fields", F.when(F.col("id") % 2 == 0, F.array(F.lit("community"))))
    done = enrich.backfill_developers(rows, views.developments(spark, sf_dir), id_col="id")
    return done.select("id", "developer", F.array_join("enriched_fields", ",").alias("enriched_fields"))


@query(f"""WITH {views.REGISTER_SQL}, stacked AS (SELECT source_file, source_sheet, source_row, name, mobile_1 FROM register UNION ALL BY NAME SELECT source_file, 'Legend' AS source_sheet, source_row, community FROM register WHERE copy = 1 UNION ALL BY NAME SELECT 'only.csv' AS source_file, 'Cover page' AS source_sheet, source_row, name FROM register WHERE copy = 2)
SELECT source_file, source_sheet, source_row, name, mobile_1, community FROM stacked WHERE source_sheet <> 'Legend'""")
def stacked_sheets(spark, sf_dir):
    """Sheets with different columns under each other; a cover sheet stays only where a file has no other."""
    rows = views.register(spark, sf_dir)
    legend = rows.where("copy = 1").select("source_file", F.lit("Legend").alias("source_sheet"), "source_row", "community")
    cover = rows.where("copy = 2").select(F.lit("only.csv").alias("source_file"), F.lit("Cover page").alias("source_sheet"), "source_row", "name")
    return maintain.stack_sheets([rows.select("source_file", "source_sheet", "source_row", "name", "mobile_1"), legend, cover]).select("source_file", "source_sheet", "source_row", "name", "mobile_1", "community")


_THIN = [("CASE WHEN p_partkey % 3 = 0 THEN p_name END", "name"), ("CASE WHEN p_partkey % 5 = 0 THEN p_brand END", "mobile_1"), ("CASE WHEN p_partkey % 7 = 0 THEN '12' END", "unit_number"), ("CAST(NULL AS STRING)", "developer"), ("CAST(NULL AS STRING)", "building_cluster"), ("CASE WHEN p_partkey % 11 = 0 THEN p_type END", "community"), ("CAST(NULL AS STRING)", "project")]


@query("""SELECT p_partkey, '{' || concat_ws(',', CASE WHEN p_size % 2 = 0 THEN '"SIZE":"' || CAST(p_size AS VARCHAR) || '"' END, '"REMARKS":"' || p_type || '"') || '}' AS payload FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def rejected_rows(spark, sf_dir):
    """Rows that hold nothing of a record, with what else they hold."""
    rows = views.table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_type", *[f"{e} AS {c}" for e, c in _THIN])
    cells = F.create_map(F.lit("SIZE"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("NOTE"), F.lit(""), F.lit("REMARKS"), F.col("p_type"))
    return legacy.rejected(rows, cells).select("p_partkey", "payload")


@query(f"WITH {S.RECORDS} SELECT source_file, count(*) AS n, count(DISTINCT id) AS ids FROM records GROUP BY source_file")
def rerun_of_a_file(spark, sf_dir):
    """Records are stored, one file is stored again in the place of its first rows, and all is read back."""
    rows, path = records(spark, sf_dir), f"{_new_folder(spark)}/records"
    sinks.write_records(rows, path)
    sinks.write_records(rows.where("source_file = 'register_2.csv'"), path, replace=True)
    return spark.read.parquet(path).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(f"""WITH {S.RECORDS}, n AS (SELECT count(*) AS row_count FROM records WHERE status = 'INCOMPLETE')
SELECT 'clerk' AS user, 'csv' AS export_format, row_count, '2026-01-02 03:04:05' AS exported_at FROM n""")
def export_audit(spark, sf_dir):
    spec, rows = search.Search(status="INCOMPLETE"), records(spark, sf_dir)
    n = search.search(rows, spec).count()
    row = sinks.audit_row(spark, spec, user="clerk", fmt="csv", row_count=n, at=datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    return row.select("user", "export_format", "row_count", F.date_format(F.to_utc_timestamp("exported_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("exported_at"))


@query(f"WITH {views.DEVELOPMENTS_SQL} SELECT name, region, developer, dev_type, confidence, count(*) AS n FROM developments GROUP BY ALL")
def reference_exchange(spark, sf_dir):
    """Reference developments written as JSON lines and read back."""
    path = f"{_new_folder(spark)}/developments"
    sinks.write_developments(views.developments(spark, sf_dir), path)
    return files.read_developments(spark, path).groupBy("name", "region", "developer", "dev_type", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name || ' \"A\", B;C|D' AS name, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment END), '') AS segment, CASE WHEN c_custkey % 5 < 2 THEN 'first, ' || chr(10) || chr(10) || 'last ' || CAST(c_custkey AS VARCHAR) ELSE '5\" pipe' END AS note FROM customer")
def delimited_exchange(spark, sf_dir):
    """Customers written as quoted text under four delimiters, a folder each, some with notes of three lines and some with a loose quote, and read back in one call."""
    root = _new_folder(spark)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.when(F.col("c_custkey") % 5 < 2, quoted(F.concat(F.lit("first, \n\nlast "), F.col("c_custkey").cast("string")))).otherwise(F.lit('5" pipe'))
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), quoted(F.concat("c_name", F.lit(' "A", B;C|D'))).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("segment"), note.alias("note"), (F.col("c_custkey") % 4).alias("part"))
    for i, d in enumerate(files.DELIMITERS):  # one write a delimiter
        rows.where(F.col("part") == i).select(F.concat_ws(d, "k", "name", "segment", "note")).write.text(f"{root}/{i}")
    back = files.read_delimited(spark, f"{root}/*")
    return back.select(F.get("cells", F.lit(0)).cast("bigint").alias("c_custkey"), *[F.get("cells", F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "segment"), (3, "note"))])


@query(f"WITH {S.CLEANED}, i AS (SELECT source_row, 'page ' || CAST(source_row % 3 AS VARCHAR) AS kind FROM register) SELECT source_row, 'UNREADABLE_FILE' AS code, CASE source_row % 3 WHEN 0 THEN 'unknown' ELSE 'encrypted' END AS message FROM i WHERE source_row % 3 < 2")
def unreadable_files(spark, sf_dir):
    names = views.register(spark, sf_dir).select(F.col("source_row").cast("string").alias("filename"), F.element_at(F.array(F.lit("unknown"), F.lit("encrypted"), F.lit("csv")), (F.col("source_row") % 3 + 1).cast("int")).alias("detected_format"))
    return quality.file_errors(names).select(F.col("source_file").cast("bigint").alias("source_row"), "code", "message")
