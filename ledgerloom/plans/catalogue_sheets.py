"""Queries on raw sheets, files and the older loader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.functions import vocabulary as V
from ledgerloom.operators import legacy, mapping
from ledgerloom.operators.search import Search
from ledgerloom.plans import twins as S
from ledgerloom.plans import views
from ledgerloom.plans.catalogue import query, records
from ledgerloom.plans.pipeline import normalise
from ledgerloom.plans.rerun import fingerprints
from ledgerloom.sources import files, sinks
from ledgerloom.sources.shared import shared_root
from ledgerloom.streaming import ingest

HEADINGS = ["Name", "MOBILE", "Phone", " Project ", "Building  Name", "Unit Number", "TYPE", "AREA", "Passport", "Remarks", "Premise 1", "Owners_Phone", "Owners_Email"]

_text = lambda e: f"CAST({e} AS STRING)"

#: Cells of the sheets that come from the register, as SQL of both engines.
_WIDE = [
    "name", "mobile_1", "CASE WHEN k % 2 = 0 THEN '043920430' END", "project", "building_cluster", "unit_number", "CASE k % 3 WHEN 0 THEN 'BUYER' ELSE 'A' END", _text("k % 900"), "'X1234'", f"concat('note ', {_text('k')})",
    f"concat(CASE k % 3 WHEN 0 THEN 'JBR' WHEN 1 THEN 'jlt' ELSE 'ZZ' END, ' | DXB | ', CASE k % 2 WHEN 0 THEN 'NA' ELSE concat('u', {_text('k')}) END, ' | RIMAL ', {_text('k % 5')})",
    f"concat('Fax 1: 009714', {_text('k')}, ', Mobile 1: 9715055', lpad({_text('k')}, 5, '0'), ', Tel: 04', {_text('k')})", f"concat('a', {_text('k')}, '@x.com; b', {_text('k')}, '@y.com')",
]
_LEADS = ["'Lead ' || name", f"concat('0501', lpad({_text('k')}, 6, '0'))", f"concat('l', {_text('k')}, '@mail.ae')"]
#: A register of owners without a heading: 25 columns, of which the first rows hold more words than numbers.
_OWNERS = [
    _text("k"), "'Business Bay'", "'Shop'", _text("k % 90 + 20"), "'P1'", "'Dubai'", "coalesce(name, 'Owner of it')", "'half'", "'Street 5'", "mobile_1", "email_address", "'no fax'", "'box'", "'F'", "'not known'",
    "mobile_2", "mobile_3", "'X99'", "'n'", "'n'", "'Cairo'", "'E1'", "'n'", "'Egypt'", "nationality",
]
#: (file, sheet, source_row, cells, which rows of the register) of each sheet.
_SHEETS = [
    (f"concat('wide_', {_text('k % 3')}, '.csv')", "A", "k + 10", _WIDE, "copy = 0"),
    ("'leads.csv'", "B", "k", _LEADS, "copy = 0"),
    ("'owners.csv'", "C", "k", _OWNERS, "copy = 0 AND k % 5 = 0"),
]
#: Rows above and within them. A row of words beats no heading, and of two headings the better one counts.
_TOP_ROWS = [(f"wide_{i}.csv", "A", row, cells) for i in range(3) for row, cells in ((0, ["Report of owners", None]), (1, HEADINGS), (2, ["Name", "Area", "1200", "x@y.com", "0501234567"]), (500, HEADINGS), (501, [None, ""]))]
_TOP_ROWS += [("places.csv", "Legend", 0, ["DEVELOPMENT", "MASTER DEVELOPER", "CONFIDENCE"])]
_cells = lambda cells: "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in cells) + "]"

RAW_SQL = f"""{views.REGISTER_SQL}, {views.DEVELOPMENTS_SQL}, raw AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{s}', {r}, {_cells(c)})" for f, s, r, c in _TOP_ROWS)}) h(source_file, source_sheet, source_row, cells)
UNION ALL SELECT 'places.csv', 'Legend', ord + 1, [name, developer, confidence] FROM developments
{' '.join(f"UNION ALL SELECT {f}, '{s}', {r}, [{', '.join(c)}] FROM register WHERE {w}" for f, s, r, c, w in _SHEETS)})"""


def raw_rows(spark, sf_dir):
    """Sheets of the register with odd tops: sheet A has a title and a lesser heading and repeats its own, sheets B and C have none (leads; a register of owners), Legend lists developments."""
    people = views.register(spark, sf_dir)
    rows = spark.createDataFrame(_TOP_ROWS, "source_file string, source_sheet string, source_row long, cells array<string>")
    rows = rows.unionByName(views.developments(spark, sf_dir).select(F.lit("places.csv").alias("source_file"), F.lit("Legend").alias("source_sheet"), (F.col("ord") + 1).alias("source_row"), F.array("name", "developer", "confidence").alias("cells")))
    for file, sheet, row, cells, which in _SHEETS:
        rows = rows.unionByName(people.where(which).select(F.expr(file).alias("source_file"), F.lit(sheet).alias("source_sheet"), F.expr(row).alias("source_row"), F.array(*map(F.expr, cells)).alias("cells")))
    return rows


#: Headings by the rule of header_rows, and by position where there are none.
HEADERS_SQL = rf"""cells AS (SELECT source_file, source_sheet, source_row, trim(c) AS v FROM (SELECT source_file, source_sheet, source_row, unnest(cells) AS c FROM raw WHERE source_row < 12) WHERE trim(c) <> ''),
scored AS (SELECT source_file, source_sheet, source_row, count(*) AS n, count(*) FILTER (length(v) > 2 AND upper(regexp_replace(replace(v, chr(96), chr(39)), '\s+', ' ', 'g')) IN ({S.quoted(mapping.known_headings(list(V.ALIASES)))})) AS hits,
  sum(1 - CASE WHEN regexp_matches(v, '[^@\s]+@[^@\s]+\.[A-Za-z]{{2,}}') OR regexp_matches(v, '^[\d\s+\-|().]{{7,}}$') OR regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}') OR try_cast(replace(v, ',', '') AS DOUBLE) IS NOT NULL THEN 2 WHEN length(v) > 60 THEN 1 ELSE 0 END) AS score FROM cells GROUP BY ALL),
picked AS (SELECT source_file, source_sheet, source_row AS top FROM scored WHERE n > 1 AND score > 0 AND hits >= greatest(2, n // 3) QUALIFY row_number() OVER (PARTITION BY source_file, source_sheet ORDER BY score DESC, source_row) = 1),
headers AS (SELECT source_file, source_sheet, CAST(coalesce(max(top), -1) AS INT) AS header_row,
  coalesce(max(CASE WHEN source_row = top THEN array_to_string(list_transform(cells, lambda c: coalesce(c, '')), '|') END), CASE source_sheet WHEN 'B' THEN 'Name|Mobile 1|Email Address' WHEN 'C' THEN '{'|'.join(V.OWNER_REGISTER)}' END) AS header
  FROM raw LEFT JOIN picked USING (source_file, source_sheet) GROUP BY source_file, source_sheet)"""


def planned(spark, sf_dir):
    """(raw rows, headers with positional ones, column samples, plan)."""
    rows, aliases = raw_rows(spark, sf_dir), mapping.alias_table(spark)
    headers = mapping.header_rows(rows, mapping.known_headings(list(V.ALIASES)))
    seen = mapping.samples(rows, headers)
    bare = mapping.positional_headers(rows, headers, seen).withColumnRenamed("header", "_p")
    headers = headers.join(bare, mapping.SHEET, "left").select(*mapping.SHEET, "header_row", F.coalesce("header", "_p").alias("header"))
    return rows, headers, seen, mapping.plan_columns(headers, aliases, seen=seen)


@query(f"WITH {RAW_SQL}, {HEADERS_SQL} SELECT source_file, source_sheet, header_row, header FROM headers")
def header_row_detect(spark, sf_dir):
    return planned(spark, sf_dir)[1].select(*mapping.SHEET, "header_row", F.array_join("header", "|").alias("header"))


_norm = lambda x: rf"upper(trim(regexp_replace(replace(coalesce({x}, ''), chr(96), chr(39)), '\s+', ' ', 'g')))"
_filled = lambda x: f"coalesce(trim({x}), '') <> ''"
_ranks = "CASE " + " ".join(f"WHEN h IN ({S.quoted(names)}) THEN {rank}" for rank, names in V.RANKS.items()) + f" ELSE {V.DEFAULT_RANK} END"

#: The plan of each sheet's columns, by its headings and the first 50 rows below them.
PLAN_SQL = f"""WITH {RAW_SQL}, {HEADERS_SQL},
body AS (SELECT raw.*, header_row FROM raw JOIN headers USING (source_file, source_sheet) WHERE source_row > header_row),
first_rows AS (SELECT * FROM body QUALIFY row_number() OVER (PARTITION BY source_file, source_sheet ORDER BY source_row) <= {mapping.SAMPLE_ROWS}),
sampled AS (SELECT source_file, source_sheet, generate_subscripts(cells, 1) - 1 AS idx, unnest(cells) AS v FROM first_rows),
seen AS (SELECT source_file, source_sheet, idx, avg(CASE WHEN try_cast(replace(v, ',', '') AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END) AS numbers, bool_or(upper(trim(v)) IN ('BUYER', 'SELLER')) AS parties FROM sampled WHERE {_filled('v')} GROUP BY ALL),
heads AS (SELECT source_file, source_sheet, generate_subscripts(string_split(header, '|'), 1) - 1 AS idx, unnest(string_split(header, '|')) AS header FROM headers WHERE header IS NOT NULL),
named AS (SELECT heads.*, {_norm('header')} AS h, numbers, parties FROM heads LEFT JOIN seen USING (source_file, source_sheet, idx)),
aliased AS (SELECT *, {S.table(V.ALIASES, 'h')} AS alias FROM named),
placed AS (SELECT *, CASE WHEN h = '' THEN 'blank' WHEN h IN ({S.quoted(V.EXCLUDED_HEADERS)}) THEN 'excluded' WHEN h = 'PREMISE 1' THEN 'premise' WHEN h IN ('PREMISE 2', 'PREMISE 3') THEN 'skipped'
  WHEN h = 'OWNERS_PHONE' THEN 'phones' WHEN h = 'OWNERS_EMAIL' THEN 'emails' WHEN h IN ({S.quoted(V.ASIDE_HEADERS)}) THEN 'aside'
  WHEN h = 'TYPE' AND alias = 'Type (Buyer/Seller)' AND NOT parties THEN 'aside' WHEN alias IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS disposition FROM aliased),
plan AS (SELECT source_file, source_sheet, CAST(idx AS INT) AS idx, header, h AS header_norm, disposition,
  CASE WHEN disposition = 'mapped' THEN CASE WHEN h = 'AREA' AND numbers > 0.7 THEN 'Size' WHEN h = 'AREA' AND numbers IS NOT NULL THEN 'Community' ELSE alias END END AS target, CAST({_ranks} AS INT) AS rank FROM placed)"""

_list = lambda value, test, order: f"coalesce(string_agg({value}, '|' ORDER BY {order}) FILTER ({test}), '')"
_joined = lambda *columns: [F.array_join(c, "|").alias(c) for c in columns]
_has = lambda values: f"bool_or(target IN ({S.quoted(values)}))"

SHEETS_SQL = f"""{PLAN_SQL}, sized AS (SELECT source_file, source_sheet, count(*) AS n_rows, CAST(max(len(cells)) AS INT) AS n_cols FROM raw GROUP BY ALL),
targets AS (SELECT source_file, source_sheet, coalesce(bool_or(target = 'PI number'), FALSE) AS pi, coalesce({_has(V.PERSON_TARGETS)}, FALSE) AS person, coalesce({_has(V.PLACE_TARGETS)}, FALSE) AS place, list_sort(list(DISTINCT target) FILTER (target IS NOT NULL)) AS targets,
  array_to_string(list_sort(list(header) FILTER (disposition = 'unmapped'))[1:20], '|') AS unmapped, bool_or(header_norm IN ({S.quoted(V.REFERENCE_HEADERS)})) AS reference,
  bool_or(starts_with(header_norm, 'DEVELOPMENT')) AND bool_or(header_norm = 'CONFIDENCE' OR header_norm IN ({S.quoted(V.REFERENCE_HEADERS)})) AND NOT bool_or(header_norm IN ({S.quoted(V.CONTACT_HEADERS)})) AS lists FROM plan GROUP BY ALL),
sheets AS (SELECT source_file, source_sheet, n_rows, n_cols, header_row, header_row = -1 AS headerless,
  coalesce(lists, FALSE) OR (regexp_matches(lower(source_sheet), '{'|'.join(V.REFERENCE_WORDS)}') AND coalesce(reference, TRUE)) AS is_reference,
  CASE WHEN pi AND person AND place THEN 'both' WHEN pi AND person THEN 'owner' WHEN pi AND place THEN 'property' WHEN NOT pi AND person THEN 'both' ELSE 'other' END AS role,
  coalesce(array_to_string(targets, '|'), '') AS targets, coalesce(unmapped, '') AS unmapped, coalesce(header, '') AS header
  FROM sized JOIN headers USING (source_file, source_sheet) LEFT JOIN targets USING (source_file, source_sheet))"""


@query(f"{PLAN_SQL} SELECT * FROM plan")
def column_plan(spark, sf_dir):
    return planned(spark, sf_dir)[3]


@query(f"{SHEETS_SQL} SELECT * FROM sheets")
def sheet_profile(spark, sf_dir):
    rows, headers, _, plan = planned(spark, sf_dir)
    return mapping.sheet_profile(rows, headers, plan).withColumns({c: F.array_join(c, "|") for c in ("targets", "unmapped", "header")})


@query(f"""{SHEETS_SQL}, own AS (SELECT source_file, count(DISTINCT t) AS n FROM (SELECT source_file, unnest(string_split(targets, '|')) AS t FROM sheets WHERE NOT is_reference) WHERE t <> '' GROUP BY source_file)
SELECT source_file, count(*) AS n_sheets, CAST(coalesce(sum(n_rows) FILTER (NOT is_reference), 0) AS BIGINT) AS n_rows, CAST(coalesce(max(n), 0) AS INT) AS n_targets, bool_and(is_reference) AS is_reference FROM sheets LEFT JOIN own USING (source_file) GROUP BY source_file""")
def file_profile(spark, sf_dir):
    rows, headers, _, plan = planned(spark, sf_dir)
    return mapping.file_profile(mapping.sheet_profile(rows, headers, plan))


@query(f"""{PLAN_SQL} SELECT source_file, source_sheet, {_list("header || ' -> ' || target", 'target IS NOT NULL', 'idx')} AS mapped, count(target) AS n_mapped,
  {_list('header', "disposition IN ('aside', 'unmapped')", 'header')} AS aside, {_list('header', "disposition = 'excluded'", 'header')} AS excluded, {_list('header', "disposition = 'unmapped'", 'header')} AS unmapped FROM plan GROUP BY ALL""")
def mapping_report(spark, sf_dir):
    return mapping.mapping_report(planned(spark, sf_dir)[3]).select(*mapping.SHEET, "n_mapped", *_joined("mapped", "aside", "excluded", "unmapped"))


_row = "source_file, source_sheet, source_row"
_first = lambda label: f"max(v) FILTER (target = {S.quoted([label])} AND place = 1)"
_kind = lambda kind: f"max(v) FILTER (disposition = '{kind}')"
_shown = ["name", "mobile_1", "mobile_2", "mobile_3", "email_address", "community", "sub_community", "project", "building_cluster", "unit_number", "size", "party_type"]

MAPPED_SQL = rf"""{PLAN_SQL}, headed AS (SELECT body.*, string_split(header, '|') AS head FROM body JOIN headers USING (source_file, source_sheet) WHERE len(list_filter(cells, lambda c: {_filled('c')})) > 0),
compared AS (SELECT *, list_filter(range(1, len(cells) + 1), lambda i: {_filled('head[i]')}) AS shown FROM headed),
bodies AS (SELECT * FROM compared WHERE len(shown) = 0 OR len(list_filter(shown, lambda i: cells[i] IS NOT NULL AND {_norm('cells[i]')} = {_norm('head[i]')})) < greatest(2, len(shown) // 2)),
entries AS (SELECT {_row}, idx, rank, header, header_norm, disposition, target, nullif(cells[idx + 1], '') AS v FROM bodies JOIN plan USING (source_file, source_sheet)),
ranked AS (SELECT *, v IS NOT NULL AND (target <> 'Name' OR NOT regexp_matches(v, '(?i)^\s*owners?\s+data\s*#?\d*\s*$') AND NOT regexp_matches(trim(v), '^\d+$')) AS good FROM entries),
choices AS (SELECT *, CASE WHEN good THEN row_number() OVER (PARTITION BY {_row}, target, good ORDER BY rank, idx) END AS place FROM ranked),
wide AS (SELECT {_row}, {', '.join(f'{_first(label)} AS {c}' for label, c in V.LABELS.items() if c in _shown)}, {_kind('premise')} AS premise, {_kind('phones')} AS phones, {_kind('emails')} AS emails,
  bool_or(coalesce(target = 'Sub-Community', FALSE) AND header_norm IN ({S.quoted(V.PROJECT_HEADERS)})) AS from_project FROM choices GROUP BY {_row}),
parted AS (SELECT *, list_transform(string_split(premise, '|'), lambda p: trim(p)) AS p, list_filter(list_transform(string_split(replace(emails, ';', ','), ','), lambda e: trim(e)), lambda e: e <> '') AS e,
  list_transform(list_filter(string_split(phones, ','), lambda x: regexp_matches(x, '(?i)(mobile|tel|phone)\s*\d*\s*:')), lambda x: trim(regexp_extract(x, ':(.*)', 1))) AS n FROM wide),
kept AS (SELECT {_row}, header AS key, v, 0 AS kind, rank, idx FROM entries WHERE disposition IN ('aside', 'unmapped') AND v IS NOT NULL
  UNION ALL SELECT {_row}, c.header, c.v, 1, c.rank, c.idx FROM choices c JOIN (SELECT {_row}, target, v AS won FROM choices WHERE place = 1) w USING ({_row}, target) WHERE c.v <> won
  UNION ALL SELECT {_row}, 'additional_emails', array_to_string(e[2:], ','), 2, 0, 0 FROM parted WHERE len(e) > 1),
extras AS (SELECT {_row}, string_agg(key || '=' || v, '; ' ORDER BY key || '=' || v) AS extras FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {_row}, key ORDER BY kind, rank, idx) = 1) GROUP BY ALL)
SELECT {_row}, name, coalesce(mobile_1, n[1]) AS mobile_1, coalesce(mobile_2, n[2]) AS mobile_2, coalesce(mobile_3, n[3]) AS mobile_3, coalesce(email_address, e[1]) AS email_address,
  coalesce(community, CASE WHEN len(p) >= 4 THEN coalesce({S.table(V.COMMUNITY_CODES, 'upper(p[1])')}, nullif(p[1], '')) END) AS community, coalesce(sub_community, project) AS sub_community, coalesce(project, CASE WHEN from_project THEN sub_community END) AS project,
  coalesce(building_cluster, CASE WHEN len(p) >= 4 THEN nullif(p[4], '') ELSE nullif(trim(premise), '') END) AS building_cluster, coalesce(unit_number, CASE WHEN len(p) >= 4 AND upper(p[3]) NOT IN ('NA', '') THEN p[3] END) AS unit_number, size, party_type, coalesce(extras, '') AS extras
FROM parted LEFT JOIN extras USING ({_row})"""


@query(MAPPED_SQL)
def map_columns(spark, sf_dir):
    """All sheets under their plans; extras as sorted ``heading=value`` texts."""
    rows, headers, _, plan = planned(spark, sf_dir)
    pairs = F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return mapping.map_columns(rows, plan, headers).select(*mapping.SHEET, "source_row", *_shown, F.array_join(F.array_sort(pairs), "; ").alias("extras"))


# premises of four, two and no parts, with codes in either case, blank parts and NA units
_PREMISE = "CASE c_custkey % 7 WHEN 5 THEN concat('Tower ', c_name) WHEN 6 THEN concat('A | ', c_mktsegment) ELSE concat(CASE c_custkey % 4 WHEN 0 THEN 'JBR' WHEN 1 THEN 'jlt' WHEN 2 THEN '' ELSE c_mktsegment END, ' | DXB | ', CASE c_custkey % 3 WHEN 0 THEN 'na' WHEN 1 THEN ' ' ELSE c_name END, ' | RIMAL ', CAST(c_nationkey AS STRING)) END"


@query(f"""WITH t AS (SELECT c_custkey, {_PREMISE} AS text FROM customer), s AS (SELECT *, list_transform(string_split(text, '|'), lambda p: trim(p)) AS p FROM t)
SELECT c_custkey, CASE WHEN len(p) >= 4 THEN coalesce({S.table(V.COMMUNITY_CODES, 'upper(p[1])')}, nullif(p[1], '')) END AS community, CASE WHEN len(p) >= 4 THEN nullif(p[4], '') ELSE nullif(trim(text), '') END AS building,
  CASE WHEN len(p) >= 4 AND upper(p[3]) NOT IN ('NA', '') THEN p[3] END AS unit FROM s""")
def pipe_field(spark, sf_dir):
    text = F.expr(_PREMISE)
    return views.table(spark, sf_dir, "customer").select("c_custkey", mapping.premise(text).alias("p")).select("c_custkey", "p.community", "p.building", "p.unit")


_LABELLED = "concat(CASE c_custkey % 3 WHEN 0 THEN 'Fax' WHEN 1 THEN 'MOBILE' ELSE 'home' END, ' 1: 009714', CAST(c_custkey AS STRING), ', ', CASE c_custkey % 4 WHEN 0 THEN 'Mobile 1' WHEN 1 THEN 'Work' WHEN 2 THEN 'phone' ELSE 'Note' END, ': 97150', CAST(c_nationkey AS STRING), ', Tel:  04', CAST(c_custkey AS STRING), ', other: 7')"


@query(rf"""WITH t AS (SELECT c_custkey, string_split({_LABELLED}, ',') AS parts FROM customer), p AS (SELECT c_custkey, list_transform(list_filter(parts, lambda x: regexp_matches(x, '(?i)(mobile|tel|phone)\s*\d*\s*:')), lambda x: trim(regexp_extract(x, ':(.*)', 1))) AS p FROM t)
SELECT c_custkey, p[1] AS first, p[2] AS second FROM p""")
def labelled_phones(spark, sf_dir):
    text = F.expr(_LABELLED)
    found = views.table(spark, sf_dir, "customer").select("c_custkey", mapping.labelled_phones(text).alias("p"))
    return found.select("c_custkey", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


_MAILS = "concat(CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' , ' ELSE concat(c_mktsegment, '@z.ae;') END, CASE c_custkey % 2 WHEN 0 THEN concat(' a', CAST(c_custkey AS STRING), '@x.com ;; ') ELSE ';' END, repeat('b@y.com,', CAST(c_custkey % 4 AS INT)))"


@query(f"""WITH t AS (SELECT c_custkey, list_filter(list_transform(string_split(replace({_MAILS}, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS e FROM customer)
SELECT c_custkey, e[1] AS first, CAST(len(e) AS INT) AS n FROM t""")
def email_list(spark, sf_dir):
    text = F.expr(_MAILS)
    return views.table(spark, sf_dir, "customer").select("c_custkey", mapping.email_list(text).alias("e")).select("c_custkey", F.get("e", F.lit(0)).alias("first"), F.size("e").alias("n"))


@query(r"SELECT p_partkey, upper(trim(regexp_replace(replace(concat('  ', p_name, '`s  ', p_type), chr(96), chr(39)), '\s+', ' ', 'g'))) AS header FROM part")
def header_normalise(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", C.normal_header(F.expr("concat('  ', p_name, '`s  ', p_type)")).alias("header"))


@query(f"WITH {S.CLEANED}, winners AS (SELECT source_row, coalesce(nullif(mobile_1, ''), nullif(mobile_2, '')) AS mobile FROM register) SELECT * FROM winners")
def header_rank_coalesce(spark, sf_dir):
    rows = views.register(spark, sf_dir).select(F.lit("f").alias("source_file"), F.lit("s").alias("source_sheet"), "source_row", F.array("mobile_2", "mobile_1").alias("cells"))
    heads = spark.createDataFrame([("f", "s", 0, ["PHONE", "MOBILE"])], "source_file string, source_sheet string, header_row int, header array<string>")
    plan = mapping.plan_columns(heads, mapping.alias_table(spark))
    # rows with neither phone are blank and fall out of the mapping, so they are joined back
    found = mapping.map_columns(rows, plan).select("source_row", F.col("mobile_1").alias("mobile"))
    return rows.select("source_row").join(found, "source_row", "left")


@query(r"SELECT page_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS source_row, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(unnest(c), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), chr(160), ' ', 'g'), '\s+', ' ', 'g')) AS cell FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS c FROM pages) WHERE len(c) > 0".replace('\\"', '"'))
def html_rows(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", r"(?is)(<p\b[^>]*>.*?</p>)", "<tr><td>$1</td></tr>").alias("html"))
    return files.html_rows(pages).select("page_id", "source_row", F.coalesce(F.get("cells", F.lit(0)), F.lit("")).alias("cell"))


@query()
def file_inventory(spark, sf_dir):
    return files.file_inventory(spark, sf_dir, pattern="*.parquet").select("filename", "size_bytes", "content_sha256", "detected_format", "allowed")


# pages under the first bytes of each format: zip, OLE, encrypted OLE, HTML, text under a .csv name, text under none
_HEADS = ["504B0304", "D0CF11E0A1B11AE1", "D0CF11E0A1B11AE1" + "EncryptedPackage".encode("utf-16-le").hex(), "3C68746D6C3E", "EFBBBF", "2A"]


@query("""WITH p AS (SELECT page_id, page_id % 6 AS kind, lower(left(html, 1000)) AS head FROM pages)
SELECT page_id, CASE WHEN kind = 0 THEN 'xlsx' WHEN kind = 1 THEN 'xls' WHEN kind = 2 THEN 'encrypted' WHEN kind = 3 OR contains(head, '<html') OR contains(head, '<table') THEN 'html' WHEN kind = 4 THEN 'csv' ELSE 'unknown' END AS format,
  CASE WHEN kind IN (1, 2) THEN 'EXCEL' WHEN kind = 3 OR contains(left(head, 400), '<html') OR contains(left(head, 400), '<table') THEN 'HTML' WHEN kind = 4 THEN 'CSV' ELSE 'EXCEL' END AS older FROM p""")
def file_formats(spark, sf_dir):
    """The format of each page's bytes, put under the first bytes of six kinds of files."""
    kind = F.col("page_id") % 6
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (kind + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode(F.left("html", F.lit(1000)), "UTF-8"), F.unhex(F.lit("20" * 2048)))
    path = F.concat(F.lit("in/page"), F.col("page_id").cast("string"), F.when(kind == 4, ".CSV").otherwise(".dat"))
    rows = views.table(spark, sf_dir, "pages").select("page_id", content.alias("content"), path.alias("path"))
    return rows.select("page_id", files.file_format(F.col("content"), F.col("path")).alias("format"), files.legacy_format(F.col("content"), F.col("path")).alias("older"))


_PATHS = "concat('in/', CASE doc_id % 5 WHEN 0 THEN '~$' WHEN 1 THEN '._' WHEN 2 THEN '0-' ELSE '' END, source, CASE doc_id % 7 WHEN 3 THEN ' Done' ELSE '' END, CASE doc_id % 6 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLS' WHEN 2 THEN '.csv' WHEN 3 THEN '.xlsm' WHEN 4 THEN '.pdf' ELSE '.csv.gz' END)"


@query("SELECT doc_id, doc_id % 5 > 2 AND doc_id % 7 <> 3 AND NOT contains(lower(source), 'done') AND doc_id % 6 < 4 AS allowed FROM documents")
def allowed_files(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", files.allowed(F.expr(_PATHS)).alias("allowed"))


@query("""WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), jobs AS (SELECT sha, max(doc_id * 10) AS prior_job FROM f WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 GROUP BY sha)
SELECT doc_id, sha AS content_sha256, prior_job FROM f LEFT JOIN jobs USING (sha)""")
def file_duplicates(spark, sf_dir):
    """Documents as files; those of even ids were loaded before, each third of them by a job that failed."""
    inventory = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"))
    before = inventory.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "id")
    jobs = before.selectExpr("id AS source_file_id", "id * 10 AS id", "CASE WHEN id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status")
    return files.repeated_files(inventory, before, jobs)


@query(f"""WITH {S.RECORDS}, chosen AS (SELECT * FROM records WHERE status = 'VALID' ORDER BY id DESC LIMIT 50000)
SELECT {', '.join((f"coalesce(strftime(record_date, '%Y-%m-%d'), '')" if c == 'record_date' else f"coalesce(CAST({c} AS VARCHAR), '')") + f' AS "{h}"' for h, c in sinks.EXPORT.items())} FROM chosen""")
def export_shape(spark, sf_dir):
    return sinks.export_rows(records(spark, sf_dir), Search())


@query(f"""WITH {S.CLEANED}, keyed AS (SELECT source_file, source_sheet, source_row, lower(CASE WHEN coalesce(name, '') <> '' AND coalesce(mobile_1, '') <> '' THEN name || '|' || mobile_1 ELSE coalesce(unit_number, '') || '|' || coalesce(building_cluster, '') END) AS key FROM cleaned)
SELECT source_row, CASE WHEN length(key) > 3 THEN key END AS dedup_key, length(key) > 3 AND row_number() OVER (PARTITION BY key ORDER BY source_file, source_sheet, source_row) > 1 AS is_duplicate FROM keyed""")
def legacy_dedup(spark, sf_dir):
    from ledgerloom.operators import quality

    return legacy.duplicates(quality.standardise(views.register(spark, sf_dir))).select("source_row", "dedup_key", "is_duplicate")


# four kinds of sheets with seven columns each; what the older loader takes from each is spelled out in the twin
_KINDS = [
    ["OWNER NAME", "PHONE", "AREA", "FLAT NO", "CLUSTER", "GROSS AREA", "PROJECT"],
    ["FULL NAME", "CONTACT", "LOCATION", "UNIT NUMBER", "BUILDING", "SIZE", "MASTER PROJECT"],
    ["DEVELOPMENT", "MOBILE", "COMMUNITY", "UNIT NO", "BUILDING NAME", "ACTUAL AREA", "REMARKS"],
    ["CITY", "PHONE", "CONTACT", "FLAT NUMBER", "CLUSTER", "SIZE", "PROJECT"],
]


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'B ' || p_brand WHEN 3 THEN 'P ' || p_type ELSE p_name END AS name, p_brand AS mobile,
  CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS community, CAST(p_size AS VARCHAR) AS unit_number, 'B ' || p_brand AS building, 'S ' || CAST(p_size AS VARCHAR) AS size,
  CASE WHEN p_partkey % 4 = 2 THEN '' ELSE 'P ' || p_type END AS project FROM part""")
def legacy_guess(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    values = F.array("p_name", "p_brand", "p_type", size, F.concat(F.lit("B "), "p_brand"), F.concat(F.lit("S "), size), F.concat(F.lit("P "), "p_type"))
    headings = F.array(*[F.array(*map(F.lit, kind)) for kind in _KINDS])[(F.col("p_partkey") % 4).cast("int")]
    rows = part.select("p_partkey", F.map_from_arrays(headings, values).alias("cells"))
    return rows.select("p_partkey", *[legacy.fallback(f, F.col("cells")).alias(f) for f in legacy.FALLBACK_HEADINGS])


@query()
def stream_ingest(spark, sf_dir):
    """The register in files, one a micro-batch, must give the same statuses as all files at once across files."""
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = views.register(spark, sf_dir).drop("k", "copy")
    rows.repartition(3, "source_file").write.parquet(f"{root}/in")
    stream = ingest.register_stream(spark, f"{root}/in", rows.schema, files_a_batch=1)
    ingest.ingest_stream(stream, f"{root}/records", f"{root}/state", counters=f"{root}/counters").awaitTermination()
    return spark.read.parquet(f"{root}/records").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT concat('nation ', c_nationkey) AS source_file, bool_or(c_nationkey % 3 = 0 OR (c_nationkey % 5 = 1 AND c_custkey % 7 = 0)) AS changed, CAST(count(*) + 1 AS BIGINT) AS n_rows FROM customer GROUP BY c_nationkey")
def files_to_rerun(spark, sf_dir):
    """A file a nation, before and after two edits: an alias for a heading that each third file has, and a cell in some rows of each fifth. Those files run again, and no others."""
    file = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    people = views.table(spark, sf_dir, "customer").select("c_nationkey", file.alias("source_file"), F.lit("S").alias("source_sheet"), F.col("c_custkey").alias("source_row"), "c_name", "c_mktsegment")
    second = F.when(F.col("c_nationkey") % 3 == 0, "Cell").otherwise("Mobile")
    heads = people.select("source_file", "source_sheet", F.lit(-1).cast("long").alias("source_row"), F.array(F.lit("Name"), second).alias("cells")).distinct()
    rows = lambda segment: people.select("source_file", "source_sheet", "source_row", F.array("c_name", segment).alias("cells")).unionByName(heads)
    edited = F.when((F.col("c_nationkey") % 5 == 1) & (F.col("source_row") % 7 == 0), "edited").otherwise(F.col("c_mktsegment"))
    aliases = mapping.alias_table(spark)
    before, after = fingerprints(rows(F.col("c_mktsegment")), aliases), fingerprints(rows(edited), mapping.add_alias(aliases, "cell", "Mobile 1"))
    return after.join(before.select("source_file", F.col("fingerprint").alias("was")), "source_file").select("source_file", (F.col("fingerprint") != F.col("was")).alias("changed"), "n_rows")


def _normalised(spark, sf_dir):
    return normalise(raw_rows(spark, sf_dir), mapping.alias_table(spark), developments=views.developments(spark, sf_dir))


@query()
def normalise_records(spark, sf_dir):
    """Raw sheets to records in one call."""
    rows = _normalised(spark, sf_dir)[0]
    return rows.select(*mapping.SHEET, "source_row", "name", "mobile_1", "email_address", "community", "building_cluster", "unit_number", "developer", "status", F.concat_ws(",", "validation_flags").alias("validation_flags"))


@query()
def normalise_errors(spark, sf_dir):
    return _normalised(spark, sf_dir)[1]


@query()
def normalise_counters(spark, sf_dir):
    return _normalised(spark, sf_dir)[2]
