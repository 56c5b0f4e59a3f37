"""The cleaning rules once more, as DuckDB SQL text: what the queries are held against."""

from __future__ import annotations

from ledgerloom.functions import vocabulary as V
from ledgerloom.plans.views import REGISTER_SQL


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NULLS = quoted(V.NULL_TOKENS)


def text(x: str, tag: bool = True) -> str:
    s = rf"trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g'))"
    if tag:
        s = rf"trim(regexp_replace({s}, '^\[[A-Za-z0-9]+\]\s*', ''))"
    return f"CASE WHEN lower({s}) NOT IN ({NULLS}) THEN {s} END"


def name(x: str) -> str:
    s = f"({text(x)})"
    return rf"CASE WHEN lower({s}) NOT IN ({quoted(V.LABEL_NAMES)}) AND NOT regexp_matches({s}, '(?i)^owners?\s+data\s*#\d+$') THEN {s} END"


def title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|[^\p{{L}}]+)'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"


def capitals(x: str) -> str:
    return f"({x} = upper({x}) AND {x} <> lower({x}))"


def table(values: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in values.items()) + " END"


def number(x: str) -> str:
    return rf"CASE WHEN lower(trim({x})) NOT IN ({NULLS}) THEN nullif(try_cast(regexp_replace(trim({x}), '[^\d.\-]', '', 'g') AS DOUBLE), 0.0) END"


def size(x: str) -> str:
    unit = rf"regexp_extract({x}, '(?i)(\d[\d,]*(?:\.\d+)?)\s*{V.SQUARE_METRES}', 1)"
    return f"floor(coalesce(CASE WHEN {unit} <> '' THEN try_cast(replace({unit}, ',', '') AS DOUBLE) END * {V.SQUARE_FEET}, {number(x)}) * 100 + 0.5) / 100"


def date(x: str) -> str:
    forms = quoted(["%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d"])
    return f"try_strptime(trim({x}), [{forms}])"


def bedroom(x: str) -> tuple[str, str]:
    s = f"({text(x)})"
    found = rf"nullif(regexp_extract(lower({s}), '(\d+)\s*(?:bhk|b\s*/?\s*r|bed(?:room)?s?)', 1), '')"
    n = rf"try_cast(coalesce({found}, CASE WHEN regexp_matches({s}, '^\d{{1,3}}$') THEN {s} END) AS INT)"
    studio = f"contains(lower({s}), 'studio')"
    value = f"CASE WHEN {studio} THEN 'Studio' WHEN {n} > {V.MOST_BEDROOMS} THEN NULL WHEN {n} IS NOT NULL THEN {n} || ' BR' WHEN lower({s}) = 'penthouse' THEN 'Penthouse' WHEN lower({s}) = 'retail' THEN 'Retail' ELSE {s} END"
    return value, f"CASE WHEN NOT {studio} AND {n} > {V.MOST_BEDROOMS} THEN 'bedroom_implausible' END"


def unit(x: str) -> str:
    return f"nullif(trim(regexp_replace({text(x)}, '[-s]+$', '')), '')"


def party(x: str) -> str:
    s = f"upper({text(x)})"
    return f"CASE WHEN starts_with({s}, 'BUY') THEN 'Buyer' WHEN starts_with({s}, 'SELL') THEN 'Seller' END"


def nationality(x: str) -> str:
    s = f"({text(x)})"
    return f"CASE WHEN upper({s}) IN ({quoted(V.UAE_SPELLINGS)}) THEN 'United Arab Emirates' WHEN {capitals(s)} AND length({s}) > 3 THEN {title(s)} ELSE {s} END"


def community(x: str) -> str:
    s = f"({text(x)})"
    short = rf"trim(regexp_replace({s}, '\s+\d+$', ''))"
    known = f"coalesce({table(V.COMMUNITIES, f'upper({s})')}, {table(V.COMMUNITIES, f'upper({short})')})"
    plain = f"CASE WHEN {capitals(short)} AND length({short}) > 2 THEN {title(short)} WHEN {short} <> '' THEN {short} ELSE {s} END"
    return f"CASE WHEN NOT regexp_matches({s}, '(?i){V.COMMUNITY_NOISE}') THEN coalesce({known}, {plain}) END"


def email(x: str) -> tuple[str, str]:
    s = f"lower(trim(split_part({text(x, tag=False)}, ',', 1)))"
    good = rf"regexp_matches({s}, '^[^@\s]+@[^@\s]+\.[A-Za-z]{{2,}}$')"
    return f"CASE WHEN {good} THEN {s} END", f"CASE WHEN NOT {good} THEN 'email_invalid' END"


def phone_steps(x: str, i: int) -> str:
    scientific = rf"regexp_matches(trim({x}), '^\d+\.\d+[eE][+-]?\d+$')"
    value = rf"CASE WHEN {scientific} THEN CAST(CAST(trunc(try_cast(trim({x}) AS DOUBLE)) AS HUGEINT) AS VARCHAR) ELSE regexp_replace(trim({x}), '^[Oo](\d)', '0\1') END"
    return rf"{scientific} AS sci{i}, try_cast(trim({x}) AS DOUBLE) AS num_{i}, regexp_replace({value}, '\D', '', 'g') AS all{i}, regexp_replace(regexp_replace({value}, '\D', '', 'g'), '^00', '') AS d{i}"


def phone(x: str, i: int) -> str:
    d, uae = f"d{i}", f"regexp_replace(d{i}, '^9710*(971)?', '971')"
    p = "|".join(V.MOBILE_PREFIXES)
    rules = [
        (f"{x} IS NULL OR lower(trim({x})) IN ({NULLS})", "NULL", None), (f"sci{i} AND num_{i} > 1e15", "NULL", "phone_corrupt_scientific"), (f"all{i} = ''", "NULL", "phone_no_digits"),
        (f"length({d}) < 7", "NULL", "phone_too_short"), (f"length({d}) > 15", "NULL", "phone_too_long"), (f"sci{i}", d, "phone_precision_lost_in_excel"),
        (f"starts_with({d}, '971') AND length({uae}) < 11", uae, "phone_too_short_for_uae"), (f"starts_with({d}, '971') AND length({uae}) > 12", uae, "phone_too_long_for_uae"), (f"starts_with({d}, '971')", f"'+' || {uae}", None),
        (rf"regexp_matches({d}, '^0({p})\d{{7}}$')", f"'+971' || substr({d}, 2)", None), (rf"regexp_matches({d}, '^({p})\d{{7}}$')", f"'+971' || {d}", None),
        (rf"regexp_matches({d}, '^[234679]\d{{6,7}}$') OR starts_with({d}, '0')", d, "phone_local_no_country_code"), (f"length({d}) >= 8", f"'+' || {d}", None),
    ]
    num = "CASE " + " ".join(f"WHEN {t} THEN {n}" for t, n, _ in rules) + f" ELSE {d} END"
    flag = "CASE " + " ".join(f"WHEN {t} THEN {quoted([f]) if f else 'NULL'}" for t, _, f in rules) + " ELSE 'phone_no_country_code' END"
    return f"{num} AS n{i}, {flag} AS f{i}"


def compact(*parts: str) -> str:
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_BED, _BED_FLAG = bedroom("bedroom")
_MAIL, _MAIL_FLAG = email("email_address")
_SLOTS = {
    "mobile_1": "coalesce(n1, n2, n3)",
    "mobile_2": "CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND n1 <> n2 THEN n2 WHEN n3 IS NOT NULL AND n3 <> coalesce(n1, n2) THEN n3 END",
    "mobile_3": "CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL AND n1 <> n2 AND n3 <> n1 AND n3 <> n2 THEN n3 END",
}

#: The register cleaned, with its flags.
CLEANED = f"""{REGISTER_SQL},
phones AS (SELECT *, {', '.join(phone_steps(f'mobile_{i}', i) for i in (1, 2, 3))} FROM register),
numbers AS (SELECT *, {', '.join(phone(f'mobile_{i}', i) for i in (1, 2, 3))} FROM phones),
sized AS (SELECT *, {size('size')} AS feet, {date('record_date')} AS day FROM numbers),
cleaned AS (SELECT k, copy, source_file, source_sheet, source_row,
  {name('name')} AS name, {community('community')} AS community, {text('sub_community')} AS sub_community, {text('building_cluster')} AS building_cluster,
  {unit('unit_number')} AS unit_number, {unit('plot_number')} AS plot_number, {text('plot_reg_no')} AS plot_reg_no, {text('dmno')} AS dmno, {text('dmsubno')} AS dmsubno,
  CASE WHEN feet <= {V.LARGEST_SIZE} THEN feet END AS size, {_BED} AS bedroom, {party('party_type')} AS party_type, {text('pi_number')} AS pi_number,
  {', '.join(f'{e} AS {c}' for c, e in _SLOTS.items())}, {_MAIL} AS email_address, {nationality('nationality')} AS nationality, {text('property_type')} AS property_type,
  {text('developer')} AS developer, {text('project')} AS project, day AS record_date, {number('procedure_value')} AS procedure_value,
  {compact(_BED_FLAG, "CASE WHEN record_date IS NOT NULL AND day IS NULL THEN 'date_unparseable' END", 'f1', 'f2', 'f3', _MAIL_FLAG, f"CASE WHEN feet > {V.LARGEST_SIZE} THEN 'size_implausible' END")} AS flags
  FROM sized)"""

_COMMUNITY = community("community")


def validated(source: str) -> str:
    return f"""SELECT *, name IS NOT NULL OR mobile_1 IS NOT NULL OR email_address IS NOT NULL AS person,
  unit_number IS NOT NULL OR plot_number IS NOT NULL OR building_cluster IS NOT NULL OR pi_number IS NOT NULL OR developer IS NOT NULL OR project IS NOT NULL OR ({_COMMUNITY}) IS NOT NULL AS place,
  unit_number IS NOT NULL OR plot_number IS NOT NULL OR pi_number IS NOT NULL OR (developer IS NOT NULL AND ({_COMMUNITY}) IS NOT NULL) OR (building_cluster IS NOT NULL AND ({_COMMUNITY}) IS NOT NULL) OR (developer IS NOT NULL AND project IS NOT NULL) AS has_context,
  sha256(coalesce(upper(name), '') || '|' || coalesce(mobile_1, '') || '|' || coalesce(upper(community), '') || '|' || coalesce(upper(building_cluster), '') || '|' || coalesce(upper(unit_number), '') || '|' || coalesce(upper(plot_number), '')) AS identity_hash
  FROM {source}"""


CHECKED = f"""{CLEANED},
checked AS (SELECT *, person OR place AS is_valid,
  list_concat(flags, CASE WHEN NOT person AND NOT place THEN ['empty_record'] ELSE {compact("CASE WHEN NOT person THEN 'no_contact' END", "CASE WHEN NOT place THEN 'no_location' END", "CASE WHEN mobile_1 IS NULL AND email_address IS NULL THEN 'uncontactable' END")} END) AS flags2
  FROM ({validated('cleaned')}))"""


def name_key(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(regexp_replace(upper(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
    forms = f"list_transform({words}, lambda w: coalesce({table(V.NAME_FORMS, 'w')}, w))"
    telling = f"list_filter({forms}, lambda w: w NOT IN ({quoted(V.NAME_NOISE)}))"
    return f"array_to_string(list_sort(CASE WHEN len({telling}) > 0 THEN {telling} ELSE {forms} END), ' ')"


def place_key(x: str) -> str:
    t = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    words = f"array_to_string(list_filter(string_split({t}, ' '), lambda w: w NOT IN ({quoted(V.PLACE_NOISE)})), ' ')"
    return f"CASE WHEN {words} <> '' THEN {words} ELSE {t} END"


def alike(other: str) -> str:
    """Similarity of a name key and another by edit distance; 0 where either is missing."""
    return f"CASE WHEN coalesce(key, '') = '' OR coalesce({other}, '') = '' THEN 0.0 WHEN key = {other} THEN 1.0 ELSE 1 - levenshtein(key, {other}) / greatest(length(key), length({other}), 1) END"


def records(scope: str = "file") -> str:
    """Records with exact duplicates of the scope, then near duplicates inside each file by a walk over its rows (by edit distance), and the status."""
    keys = "identity_hash" + (", source_file" if scope == "file" else "")
    return f"""RECURSIVE {CHECKED},
marked AS (SELECT *, CASE WHEN is_valid AND row_number() OVER (PARTITION BY is_valid, {keys} ORDER BY source_file, source_sheet, source_row) > 1 THEN 'duplicate_identity_hash' END AS exact_flag FROM checked),
usable AS (SELECT *, {name_key('name')} AS key, CASE WHEN community IS NOT NULL AND coalesce(unit_number, plot_number) IS NOT NULL THEN upper(community) || '|' || upper(coalesce(building_cluster, '')) || '|' || upper(coalesce(unit_number, plot_number)) END AS prop, bool_or(exact_flag IS NULL) OVER (PARTITION BY source_file, identity_hash) AS first_here FROM marked WHERE is_valid),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY source_sheet, source_row) AS step FROM usable WHERE name IS NOT NULL AND (prop IS NOT NULL OR mobile_1 IS NOT NULL) AND first_here),
walk AS (SELECT source_file, CAST(0 AS BIGINT) AS step, MAP([''], ['']) AS names, MAP([''], [TRUE]) AS seen, CAST(NULL AS VARCHAR) AS source_sheet, CAST(NULL AS BIGINT) AS source_row, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT source_file FROM steps) UNION ALL
  SELECT source_file, step, CASE WHEN kind IS NULL THEN map_concat(names, MAP(list_filter(['p|' || prop, 'm|' || mobile_1], lambda x: x IS NOT NULL), list_transform(list_filter([prop, mobile_1], lambda x: x IS NOT NULL), lambda x: key))) ELSE names END,
    CASE WHEN kind IS NULL THEN map_concat(seen, MAP([identity_hash], [TRUE])) ELSE seen END, source_sheet, source_row, kind, CASE kind WHEN 'property' THEN by_prop WHEN 'phone' THEN by_phone END
  FROM (SELECT *, CASE WHEN len(map_extract(seen, identity_hash)) > 0 THEN 'exact' WHEN by_prop >= 0.85 THEN 'property' WHEN by_phone >= 0.85 THEN 'phone' END AS kind
    FROM (SELECT *, {alike('last_prop')} AS by_prop, {alike('last_phone')} AS by_phone
      FROM (SELECT s.*, w.names, w.seen, map_extract(w.names, 'p|' || s.prop)[1] AS last_prop, map_extract(w.names, 'm|' || s.mobile_1)[1] AS last_phone FROM walk w JOIN steps s ON s.source_file = w.source_file AND s.step = w.step + 1)))),
near AS (SELECT source_file, source_sheet, source_row, kind, score FROM walk WHERE step > 0 AND kind <> 'exact'),
taken AS (SELECT source_file, source_sheet, source_row FROM walk WHERE step > 0 AND kind IS NULL),
flagged AS (SELECT marked.*, CASE WHEN t.source_row IS NULL THEN coalesce('fuzzy_duplicate_' || kind || '_match_' || CAST(CAST(floor(score * 100) AS INT) AS VARCHAR) || 'pct', exact_flag) END AS duplicate_flag FROM marked LEFT JOIN near USING (source_file, source_sheet, source_row) LEFT JOIN taken t USING (source_file, source_sheet, source_row)),
judged AS (SELECT *, CASE WHEN NOT is_valid THEN 'INVALID' WHEN duplicate_flag IS NOT NULL THEN 'DUPLICATE' WHEN name IS NOT NULL AND (mobile_1 IS NOT NULL OR email_address IS NOT NULL) AND has_context THEN 'VALID' ELSE 'INCOMPLETE' END AS status FROM flagged),
records AS (SELECT *, source_row AS id, array_to_string(list_concat(flags2, CASE WHEN status = 'DUPLICATE' THEN [duplicate_flag] WHEN status = 'INCOMPLETE' THEN [CASE WHEN name IS NULL AND mobile_1 IS NULL AND email_address IS NULL THEN 'incomplete_missing_name_and_contact' WHEN name IS NULL THEN 'incomplete_missing_name' WHEN mobile_1 IS NULL AND email_address IS NULL THEN 'incomplete_missing_contact' ELSE 'incomplete_missing_property_info' END] ELSE [] END), ',') AS validation_flags FROM judged)"""


RECORDS = records()
