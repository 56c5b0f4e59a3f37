"""No sheet, key or file makes one task of what a row of it costs, and what is looked up is looked up once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import enrich, mapping
from ledgerloom.plans import pipeline

RAW = "source_file string, source_sheet string, source_row long, cells array<string>"


@pytest.fixture
def planned_as_written(spark):
    """Joins by shuffle, parts as the shuffle deals them."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_owners_without_a_key_are_no_hot_group(spark, planned_as_written):
    owners = spark.range(400).select(F.lit("a.csv").alias("source_file"), F.col("id").alias("source_row"), F.when(F.col("id") % 100 == 7, F.concat(F.lit(" P"), F.col("id"))).alias("pi_number"), F.lit(None).cast("string").alias("unit_number"))
    places = spark.createDataFrame([("a.csv", 1, "P7 ", "12"), ("a.csv", 0, "P107", " 9 "), ("a.csv", 2, "", "none"), ("b.csv", 1, "P207", "of another file")], "source_file string, source_row long, pi_number string, unit_number string")
    joined = enrich.merge_properties(owners, places, ("unit_number",))
    assert sorted((r.source_row, r.unit_number) for r in joined.where("property_merged").collect()) == [(7, "12"), (107, "9")]
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200


def test_cleaning_is_dealt_over_all_cores(spark, monkeypatch):
    """One sheet, one written part: its rows are still cleaned in as many tasks as there are cores."""
    parts = []
    clean = pipeline.identified

    def counted(rows):
        parts.append(rows.rdd.getNumPartitions())
        return clean(rows)

    monkeypatch.setattr(pipeline, "identified", counted)
    rows = [("a.csv", "S", 0, ["OWNER NAME", "MOBILE"])] + [("a.csv", "S", i, [f"Owner Number {i}", f"05012345{i:02}"]) for i in range(1, 41)]
    records, _, _ = pipeline.normalise(spark.createDataFrame(rows, RAW).coalesce(1), mapping.alias_table(spark))
    assert records.count() == 40 and parts == [spark.sparkContext.defaultParallelism]


def test_rows_of_one_number_are_filled_each_by_its_own_places(spark):
    fields = ("project", "sub_community", "community", "building_cluster", "developer", "property_type")
    rows = [("Sidra 7", None, None, None, None, None), (None, None, "Far Hills", None, "Own", None), (None, None, None, None, None, "Villa"), ("Sidra 7", None, "", None, "", "Flat")]
    frame = spark.createDataFrame([("f.csv", 1, *r) for r in rows], f"source_file string, source_row long, {', '.join(f'{c} string' for c in fields)}")
    known = [(1, "Sidra 7", "Dubai", "South", "Emaar", "Villa", "low"), (2, "sidra (7)", "Dubai", "North", "Other", "Flat", "high"), (3, "Sidra 7", "Dubai", "East", None, "Tower", "high")]
    developments = spark.createDataFrame(known, "ord long, name string, emirate string, region string, developer string, dev_type string, confidence string")
    got = enrich.enrich(frame, developments, file_col=None).select("community", "developer", "property_type", F.array_join("enriched_fields", ",").alias("told"), "matched_by").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("North", "Other", "Flat", "community,developer,property_type", "exact"), ("Far Hills", "Own", None, "", None), (None, None, "Villa", "", None), ("North", "Other", "Flat", "community,developer", "exact"),
    ], key=str)


def test_repeated_headings_with_odd_letters(spark):
    """A cell that spells its heading with other spaces, cases and signs counts; one that only holds its first word does not."""
    head = ["Owner`s  name", " straße nr", "Unit Number", None, "Größe"]
    rows = [
        (["OWNER'S NAME", "STRASSE\tNR ", "9", "x", "1"], True),
        (["owner`s Name", "1", "2", "3", "GRÖßE"], True),
        (["Owner's name and more", "Strasse nr 5", "Unit Number 7", "x", "Größe 2"], False),
        (["Owner's name", "1", "2", "x", "3"], False),  # one of four
        ([None, None, "unit number", "GRÖSSE"], False),  # in other columns
        (["owner's name", "strasse nr"], True),
        ([], False),
    ]
    frame = spark.createDataFrame([("f", "s", i, cells) for i, (cells, _) in enumerate(rows)], RAW)
    names = mapping.header_names(F.array(*map(F.lit, head)))
    got = frame.select("source_row", mapping.is_repeated_header(F.col("cells"), names).alias("is_head")).orderBy("source_row").collect()
    assert [r.is_head for r in got] == [want for _, want in rows]


def test_extras_of_contested_and_repeated_headings(spark):
    """Losing cells and cells kept aside, under headings that stand twice; the first filled one counts."""
    head = ["Name", "Owner Name", "Notes", "Notes", "Mobile"]
    rows = [["Karoline", "Mustafa", None, "second", "0501234567"], ["12", "Mustafa", "first", "second", ""], ["Karoline", "Karoline", "", "", "1"], [None, "owners data #4", " ", None, "2"]]
    raw = spark.createDataFrame([("f", "s", i, r) for i, r in enumerate([head, *rows])], RAW)
    headers = spark.createDataFrame([("f", "s", 0, head)], "source_file string, source_sheet string, header_row int, header array<string>")
    plan = mapping.plan_columns(headers, mapping.alias_table(spark, {"NAME": "Name", "OWNER NAME": "Name", "MOBILE": "Mobile 1"}))
    got = {r.source_row: (r.name, r.mobile_1, r.extras) for r in mapping.map_columns(raw, plan, headers).collect()}
    lost = {r.header for r in plan.collect() if r.target == "Name"}
    assert lost == {"Name", "Owner Name"}
    names = [got[i][0] for i in range(1, 5)]
    assert names[1:] == ["Mustafa", "Karoline", None] and names[0] in ("Karoline", "Mustafa")
    other = {"Karoline": ("Owner Name", "Mustafa"), "Mustafa": ("Name", "Karoline")}[names[0]]
    assert got[1][1:] == ("0501234567", {other[0]: other[1], "Notes": "second"})
    assert got[2][1:] == (None, {"Name": "12", "Notes": "first"})
    assert got[3][1:] == ("1", {}) and got[4][1:] == ("2", {"Notes": " "})


def test_each_text_is_squeezed_once(spark):
    """The plan of the cleaning holds one pass over the white space of each of the 16 texts and the e-mail, however often the text is looked at."""
    from ledgerloom.functions import vocabulary as V
    from ledgerloom.operators import quality

    rows = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in V.FIELDS]).localCheckpoint()
    plan = quality.validate(quality.standardise(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)\s+") == 17
