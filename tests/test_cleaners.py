import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cleaners as C
from ledgerloom.operators import mapping
from ledgerloom.operators.dedup import name_ratio


def run(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


PHONES = [
    ("050-999-8877", "+971509998877", None), ("0501234567", "+971501234567", None), ("501234567", "+971501234567", None), ("971|50-6597775", "+971506597775", None), ("971 0 55 4570666", "+971554570666", None),
    ("971 00 971 56981", "97156981", "phone_too_short_for_uae"), ("43920430", "43920430", "phone_local_no_country_code"), ("+14155552671", "+14155552671", None), ("5.0655e10", "50655000000", "phone_precision_lost_in_excel"),
    ("7.4995E+21", None, "phone_corrupt_scientific"), ("12345", None, "phone_too_short"), ("abc", None, "phone_no_digits"), ("n/a", None, None), (None, None, None), ("", None, None), ("1" * 16, None, "phone_too_long"), ("O501234567", "+971501234567", None),
]


def test_phones(spark):
    assert [(r.num, r.flag) for r in run(spark, C.clean_phone, [p for p, _, _ in PHONES])] == [(n, f) for _, n, f in PHONES]


@pytest.mark.parametrize(
    "cleaner,pairs",
    [
        (C.clean_text, [("  a  b ", "a b"), ("[x1] Jane", "Jane"), ("N/A", None), ("0", None), ("[x]", None), (None, None)]),
        (C.clean_name, [("Owners Data #193265", None), ("[ab12] Jane Doe", "Jane Doe"), ("Owner", None), ("name", None)]),
        (C.clean_number, [("1,533.74", 1533.74), ("AED0", None), ("-", None), ("1-2", None), ("n/a", None)]),
        (C.clean_size, [("100 sqm", 1076.39), ("85.5 m2", 920.31), ("1,000 Sq. M", 10763.91), ("1,533.74", 1533.74), ("AED0", None), ("large", None)]),
        (C.clean_unit, [("101-", "101"), ("G1-s", "G1"), ("A-101", "A-101"), ("--", None)]),
        (C.clean_party_type, [("buying", "Buyer"), ("SELLER", "Seller"), ("A", None), (None, None)]),
        (C.clean_nationality, [("u.a.e.", "United Arab Emirates"), ("INDIA", "India"), ("SAUDI-ARABIA", "Saudi-Arabia"), ("USA", "USA"), ("Egypt", "Egypt")]),
        (C.clean_community, [("Total Owner Details", None), ("OWNER DETAILS", None), ("Owners Data", None), ("DAMAC HILLS 1044", "DAMAC Hills"), ("DAMAC HILLS 2", "DAMAC Hills 2"), ("Dubai Hills Estate", "Dubai Hills Estate"), ("AL-BARSHA SOUTH 3", "Al-Barsha South")]),
        (C.place_key, [("The Sidra Residences", "sidra"), ("The Tower", "the tower"), (None, "")]),
        (C.name_key, [("Mohd. Al-Rashid", "MOHAMMED RASHID"), ("Mohammed Al Rashid", "MOHAMMED RASHID"), ("Emaar Properties PJSC", "EMAAR"), ("The LLC", "LLC THE"), (None, "")]),
        (C.filename_community, [("[Club Villas] Club Villas.xlsx", "Club Villas"), ("PARK_POINT-march 2022 (1) done.csv", "Park Point"), (None, "")]),
    ],
)
def test_values(spark, cleaner, pairs):
    assert run(spark, cleaner, [v for v, _ in pairs]) == [w for _, w in pairs]


def test_structs(spark):
    assert [(r.value, r.flag) for r in run(spark, C.clean_email, ["A@x.com, b@y.com", "not-an-email", "n/a", None])] == [("a@x.com", None), (None, "email_invalid"), (None, None), (None, None)]
    assert [(r.value, r.flag) for r in run(spark, C.clean_bedroom, ["2 BHK", "3", "studio apt", "26", "retail", "duplex"])] == [("2 BR", None), ("3 BR", None), ("Studio", None), (None, "bedroom_implausible"), ("Retail", None), ("duplex", None)]
    assert [str(x) for x in run(spark, C.clean_date, ["05/03/2024", "12/25/2024", "2023-01-05 10:20:30", "sometime"])] == ["2024-03-05 00:00:00", "2024-12-25 00:00:00", "2023-01-05 10:20:30", "None"]
    assert run(spark, mapping.labelled_phones, ["Fax 1: 009714000, Mobile 1: 971505518569", None])[0] == ["971505518569"]
    (p,) = run(spark, mapping.premise, ["JBR | DXB | NA | RIMAL 3 1101"])
    assert (p.community, p.building, p.unit) == ("Jumeirah Beach Residence", "RIMAL 3 1101", None)


def test_property_key_and_ratio(spark):
    row = spark.createDataFrame([("Dubai Hills Estate", "Park Point", "507", None)], "c string, b string, u string, p string")
    assert row.select(C.property_key(F.col("c"), F.col("b"), F.col("u"), F.col("p"))).first()[0] == "DUBAI HILLS ESTATE|PARK POINT|507"
    pair = spark.createDataFrame([("FATIMA MANSOORI", "JOHN SMITH")], "a string, b string")
    assert pair.select(name_ratio("a", "b")).first()[0] < 0.35
