"""Raw sheets to records in one call, against what the rules give by hand."""

import pytest

from ledgerloom.operators import mapping
from ledgerloom.plans.pipeline import normalise, records_of

RAW = "source_file string, source_sheet string, source_row long, cells array<string>"
HEAD = ["OWNER NAME", "MOBILE", "COMMUNITY", "UNIT NUMBER", "PASSPORT"]


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [
        ("a.csv", "S", 0, ["List of owners", None, None, None, None]),
        ("a.csv", "S", 1, HEAD),
        ("a.csv", "S", 2, ["Karoline Okonkwo", "0501234567", "Sidra", "12", "P1"]),
        ("a.csv", "S", 3, ["Karoline Okonkwo", "0501234567", "Sidra", "12", "P2"]),  # equal identity
        ("a.csv", "S", 4, ["Karoline Okonkwa", "0507654321", "Sidra", "12", "P3"]),  # alike, of the same property
        ("a.csv", "S", 5, ["Mustafa Lindqvist", None, "Sidra", "14", "P4"]),  # no contact
        ("a.csv", "S", 6, HEAD),
        ("a.csv", "S", 7, [None, None, None, None, None]),
        ("a.csv", "S", 8, [None, None, "Total Owner Details", None, "P5"]),  # neither a person nor a place
    ]
    frame = spark.createDataFrame(rows, RAW)
    return [part.collect() for part in normalise(frame, mapping.alias_table(spark))]


def test_statuses(outcome):
    got = {r.source_row: (r.status, r.validation_flags[-1] if r.validation_flags else None) for r in outcome[0]}
    assert got[2] == ("VALID", None)
    assert got[3] == ("DUPLICATE", "duplicate_identity_hash")
    assert got[4][0] == "DUPLICATE" and got[4][1].startswith("fuzzy_duplicate_property_match_")
    assert got[5] == ("INCOMPLETE", "incomplete_missing_contact")
    assert set(got) == {2, 3, 4, 5}


def test_private_columns_stay_out(outcome):
    assert not any(v in str(r) for r in outcome[0] for v in ("P1", "P2", "P3", "P4"))


def test_errors_and_counters(outcome):
    assert [(r.source_row, r.code) for r in outcome[1]] == [(8, "INVALID_RECORD")]
    (c,) = outcome[2]
    assert (c.total, c.valid, c.incomplete, c.duplicate, c.invalid) == (5, 1, 1, 2, 1)
    assert (c.total_rows, c.processed_rows, c.skipped_rows, c.error_count) == (6, 6, 2, 1)  # the blank row and the repeated heading are skipped


def test_counters_and_errors_of_skipped_sheets(spark):
    rows = [("a.csv", "Owners", 0, ["PI NUMBER", "OWNER NAME", "MOBILE"])] + [("a.csv", "Owners", i, [f"P{i}", f"Owner Number {i}", f"050123456{i}"]) for i in (1, 2)]
    rows += [("a.csv", "Places", 0, ["PI NUMBER", "UNIT NUMBER", "BUILDING NAME"])] + [("a.csv", "Places", i, [f" P{i}", f"{i}0", "Tower"]) for i in (1, 2, 3)]
    rows += [("a.csv", "Legend", 0, ["DEVELOPMENT", "MASTER DEVELOPER", "CONFIDENCE"]), ("a.csv", "Legend", 1, ["Sidra", "Emaar", "High"])]
    records, errors, counters = normalise(spark.createDataFrame(rows, RAW), mapping.alias_table(spark))
    assert sorted((r.name, r.unit_number, r.status) for r in records.collect()) == [("Owner Number 1", "10", "VALID"), ("Owner Number 2", "20", "VALID")]
    assert sorted((e.code, e.source_sheet, e.severity, e.payload) for e in errors.collect()) == [
        ("PROPERTY_OWNER_JOIN", None, "WARNING", '{"properties":3}'), ("PROPERTY_SHEET_MERGED", "Places", "WARNING", None), ("REFERENCE_SHEET_SKIPPED", "Legend", "WARNING", None),
    ]
    (c,) = counters.collect()
    # the legend's own heading holds no two known names, so it counts as one of its rows
    assert (c.total_rows, c.processed_rows, c.skipped_rows, c.error_count, c.valid) == (7, 2, 5, 3, 2)


def owner(i, name):
    cells = [str(265610 + i), "Business Bay", "Shop", "120", "P7", "Dubai", name, "half", "Street", f"050123456{i}", f"o{i}@mail.ae", "none", "box", "F", "unknown", None, None, "X99", "n", "n", "Cairo", "E1", "n", "Egypt", "Egypt"]
    return ("owners.csv", "S", i, cells)


def test_owner_register_without_a_heading(spark):
    """Its first row holds more words than numbers, and is data for all that."""
    names = ["Karoline Okonkwo", "Mustafa Lindqvist", "Étienne Marchetti", "Ines Castellanos", "Tariq Al Suwaidi", "Wanjiru Kimani"]
    rows = spark.createDataFrame([owner(i, n) for i, n in enumerate(names)], RAW)
    (head,) = mapping.header_rows(rows, mapping.known_headings(["NAME", "PHONE"])).collect()
    assert (head.header_row, head.header) == (-1, None)
    records, errors, _ = normalise(rows, mapping.alias_table(spark))
    got = sorted((r.source_row, r.name, r.mobile_1, r.email_address) for r in records.collect())
    assert got == [(i, n, f"+97150123456{i}", f"o{i}@mail.ae") for i, n in enumerate(names)] and errors.count() == 0


@pytest.mark.parametrize(
    "rows,want",
    [
        ([["Name", "Area", "1200", "x@y.com", "0501234567"], ["Owner name", "Mobile", "Community", "Notes", "More"]], 1),  # both are known; the better score wins
        ([["Name", "Mobile", "x"], ["Name", "Mobile", "x"]], 0),  # the first on ties
        ([["Name", "Mobile"] + ["word"] * 7], -1),  # two of nine are too few
        ([["Passport", "PREMISE 1"], ["a", "b"]], 0),  # excluded and literal names count
        ([["F", "1"], ["Name", "12", "7"]], -1),
        ([[None, " "]], -1),
    ],
)
def test_header_rule(spark, rows, want):
    frame = spark.createDataFrame([("f", "s", i, r) for i, r in enumerate(rows)], RAW)
    assert [r.header_row for r in mapping.header_rows(frame, mapping.known_headings([r.header_norm for r in mapping.alias_table(spark).collect()])).collect()] == [want]


def test_aliases_from_a_mapping_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"notes": "x", "aliases": {"Name": ["Owner`s  name", "who", "WHO"], "Project": ["Who", " "]}}')
    got = sorted((r.header_norm, r.target) for r in mapping.read_aliases(spark, f"{tmp_path}/m.json").collect())
    assert got == [("OWNER'S NAME", "Name"), ("WHO", "Name"), ("WHO", "Project")]
    heads = spark.createDataFrame([("f", "s", 0, ["who"])], "source_file string, source_sheet string, header_row int, header array<string>")
    assert mapping.plan_columns(heads, mapping.read_aliases(spark, f"{tmp_path}/m.json")).first().target == "Name"


def test_no_rows(spark):
    parts = normalise(spark.createDataFrame([], RAW), mapping.alias_table(spark))
    assert [p.count() for p in parts] == [0, 0, 0]


def test_near_check_can_be_left_out(spark):
    rows = [("f", "s", i, n, "0501234567") for i, n in enumerate(["Karoline Okonkwo", "Karoline Okonkwa"])]
    frame = spark.createDataFrame(rows, "source_file string, source_sheet string, source_row long, name string, mobile_1 string")
    status = lambda **more: [r.status for r in records_of(frame, **more).orderBy("source_row").collect()]
    assert status() == ["INCOMPLETE", "DUPLICATE"] and status(near=False) == ["INCOMPLETE", "INCOMPLETE"]
