"""File readers and the streaming sink on small files."""

import csv
import hashlib
import io
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import legacy, quality
from ledgerloom.plans import views
from ledgerloom.sources import files
from ledgerloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_each_file_has_its_own_delimiter_and_line_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NAME,UNIT\n" + "".join(f'"n, {i}",{i}\n' for i in range(3000)))
    (tmp_path / "b.csv").write_text("NAME;UNIT;SIZE\nx;1;2\n ;\"q\"\"r\";\n")
    (tmp_path / "c.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.read_delimited(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = sorted((r.source_row, r.cells) for r in rows if r.source_file == "a.csv")
    assert one == [(0, ["NAME", "UNIT"])] + [(i + 1, [f"n, {i}", str(i)]) for i in range(3000)]
    two = sorted((r.source_row, r.cells) for r in rows if r.source_file == "b.csv")
    assert two == [(0, ["NAME", "UNIT", "SIZE"]), (1, ["x", "1", "2"]), (2, [None, 'q"r', None])]


def test_a_given_delimiter_holds_for_all_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a|b,c\n")
    assert [r.cells for r in files.read_delimited(spark, str(tmp_path), delimiter="|").collect()] == [["a", "b,c"]]


def csv_rows(text, delimiter):
    return [[c.strip() or None for c in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)]


@pytest.mark.parametrize("split", ["128m", "64"])
def test_quoted_cells_over_line_breaks(spark, tmp_path, split):
    """Rows over several lines and several parts of a file, against a reader that walks the file from its start."""
    rng = random.Random(7)
    texts = {"a.csv": 'NAME,NOTE\n"A","line one\nline two"\nB,5" pipe\n', "b.csv": 'x;y\n"1,2,3,4,5";"a;b\n;c"\n"q ""r"" s"; \n', "empty.csv": ""}
    for k in range(3):
        cell = lambda: rng.choice(["", "plain", "5\" pipe", '"a, b"', '"one\ntwo"', '"' + "long\n" * rng.randint(1, 9) + '"', '"say ""hi"""', '"\n\n"', '"a"'])
        texts[f"c{k}.csv"] = "".join(",".join(["k", *(cell() for _ in range(3))]) + "\n" for _ in range(60))
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = files.read_delimited(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        got = sorted((r.source_row, r.cells) for r in rows if r.source_file == name)
        want = csv_rows(text, ";" if name == "b.csv" else ",")
        assert got == list(enumerate(want)), name


def test_a_quote_that_is_never_closed_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"c\nd",e\n"open,f\ng,h\n' + "i,j\n" * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32")
    try:
        rows = sorted((r.source_row, r.cells) for r in files.read_delimited(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows[:4] == [(0, ["a", "b"]), (1, ["c\nd", "e"]), (2, ['"open', "f"]), (3, ["g", "h"])] and rows[-1] == (53, ["i", "j"]) and len(rows) == 54


@pytest.mark.parametrize(
    "head,want",
    [
        (bytes.fromhex("D0CF11E0A1B11AE1") + b"\x00\xd8\xff\xdc" * 100, "xls"),
        (bytes.fromhex("D0CF11E0A1B11AE1") + b"\x00\xd8" + "EncryptedPackage".encode("utf-16-le"), "encrypted"),
        (b"PK\x03\x04rest", "xlsx"),
        (b"\xef\xbb\xbf <TABLE><tr>", "html"),
        (b"a,b", "csv"),
        (b"", "csv"),
        (None, "csv"),
    ],
)
def test_format_by_first_bytes(spark, head, want):
    frame = spark.createDataFrame([(bytearray(head) if head is not None else None, "dir/file.csv")], "content binary, path string")
    assert frame.select(files.file_format(F.col("content"), F.col("path"))).first()[0] == want


def test_flags_of_incomplete_rows(spark):
    rows = spark.createDataFrame(
        [("A", "1", None, True, "VALID"), (None, None, None, True, "incomplete_missing_name_and_contact"), (None, "1", None, True, "incomplete_missing_name"), ("A", None, None, False, "incomplete_missing_contact"), ("A", None, "a@b.c", False, "incomplete_missing_property_info")],
        "name string, mobile_1 string, email_address string, has_context boolean, want string",
    ).withColumns({"is_valid": F.lit(True), "duplicate_flag": F.lit(None).cast("string"), "validation_flags": F.array().cast("array<string>")})
    for r in quality.classify(rows).collect():
        assert (r.validation_flags or [r.status]) == [r.want]


def test_a_batch_tried_again_replaces_what_it_wrote(spark, tmp_path):
    write = ingest.append_batch(f"{tmp_path}/records", f"{tmp_path}/counters")
    rows = views.register(spark, SF).drop("k", "copy").where("source_row < 40")
    write(rows, 0)
    first = sorted(map(str, spark.read.parquet(f"{tmp_path}/records").select("source_row", "status").collect()))
    write(rows, 0)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/records").select("source_row", "status").collect())) == first and first
    write(rows, 1)
    again = spark.read.parquet(f"{tmp_path}/records").where("batch_id = 1 AND status NOT IN ('DUPLICATE', 'INVALID')")
    assert again.count() == 0 and spark.read.parquet(f"{tmp_path}/counters").select("batch_id").distinct().count() == 2


def test_fallback_takes_the_first_heading_there_is(spark):
    rows = spark.createDataFrame([(None, {"PHONE": "1", "MOBILE": None}), ("9", {"MOBILE": "1"}), (" ", {"CONTACT": "3", "PHONE": "2"}), (None, {}), (None, None)], "mapped string, cells map<string,string>")
    got = [r[0] for r in rows.select(legacy.fallback("mobile", F.col("cells"), F.col("mapped"))).collect()]
    assert got == [None, "9", "2", "", ""]


def test_reference_rows_are_numbered_in_order_of_the_files(spark, tmp_path):
    for name, n in (("b.json", 3), ("a.json", 400), ("c.json", 1)):
        (tmp_path / name).write_text("".join(f'{{"name": "{name} {i}", "region": "-"}}\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = files.read_developments(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.ord for r in rows] == list(range(404)) and rows[0].region is None
    assert [r.name for r in rows] == [f"{f} {i}" for f, n in (("a.json", 400), ("b.json", 3), ("c.json", 1)) for i in range(n)]


def test_inventory_of_files_by_their_bytes(spark, tmp_path):
    """Size, digest and format of every file below a folder, held against the bytes themselves."""
    ole = bytes.fromhex("D0CF11E0A1B11AE1")
    bodies = {
        "a.xlsx": (b"PK\x03\x04rest", "xlsx"), "sub/b.xls": (ole + b"\x00" * 600, "xls"), "c.xls": (ole + b"\x01" * 300 + "EncryptedPackage".encode("utf-16-le"), "encrypted"),
        "late.xls": (ole + b"\x01" * 4000 + "EncryptedPackage".encode("utf-16-le"), "xls"), "d.xls": (b"  <HTML><TABLE>", "html"), "e.CSV": (b"NAME,UNIT\n", "csv"), "f.csv": (b"<table><tr>", "html"),
        "g.pdf": (b"%PDF", "unknown"), "empty.xlsx": (b"", "unknown"), "empty.csv": (b"", "csv"), "big.csv": (b"x,1\n" * 500_000, "csv"), "same.csv": (b"NAME,UNIT\n", "csv"), "é 100%.csv": (b"", "csv"), "ü+%20.csv": (b"x", "csv"),
    }
    (tmp_path / "sub").mkdir()
    for name, (body, _) in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.filename: (r.size_bytes, r.content_sha256, r.detected_format) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {name.split("/")[-1]: (len(body), hashlib.sha256(body).hexdigest(), kind) for name, (body, kind) in bodies.items()}


def test_inventory_query_equals_the_files(spark):
    from ledgerloom.plans import catalogue_sheets

    got = {r.filename: (r.size_bytes, r.content_sha256) for r in catalogue_sheets.file_inventory(spark, SF).collect()}
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in pathlib.Path(SF).glob("*.parquet")}
    assert got == want


def test_inventory_of_large_files_by_their_lines(spark, tmp_path):
    """Files that are not loaded whole: read in parts, digest, size and format as by their bytes."""
    import random

    noise = random.Random(5)
    bodies = {
        "mark.csv": b"\xef\xbb\xbfa,b\nc,d\n", "mark and no break.csv": b"\xef\xbb\xbfa,b\nc,d", "two marks.csv": b"\xef\xbb\xbf\xef\xbb\xbfa", "é 100%.csv": b"a\r\nb\r\n\r", "breaks.csv": b"\n" * 50_000, "ends.csv": b"x\n\n", "none.csv": b"x" * 40_000,
        "long.csv": b"y" * 70_000 + b"\n" + b"z" * 3_000_000, "lines.csv": b"x,1\n" * 900_000, "noise.xls": noise.randbytes(5_000_000), "zeros.xls": bytes(100_000), "page.html": b"\n\n <html>\n" + b"<p>" * 9_000, "packed.csv.gz": b"not packed at all " * 100, "small.csv": b"s", "[ab12] {x} *?.csv": b"odd,name\n" * 9,
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700000b")
    try:
        found = files.file_inventory(spark, str(tmp_path), whole_bytes=6).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.filename: (r.size_bytes, r.content_sha256) for r in found}
    assert len(found) == len(bodies) and got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    assert {r.filename: r.detected_format for r in found}["page.html"] == "html"
