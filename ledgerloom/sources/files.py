"""Read registers: delimited text, HTML tables, file inventories and reference tables."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.shared import written

# Delimiters told apart, file suffixes taken, and first characters of files to pass over.
DELIMITERS = [",", ";", "\t", "|"]
SUFFIXES = [".xlsx", ".xlsm", ".xls", ".csv"]
PASSED_OVER = ["~$", "._", "0-"]

# Named entities that cells may hold.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


HEAD_BYTES = 64 * 1024
CHUNK_BYTES = 1 << 20
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"


def best_delimiter(lines: DataFrame, column: str = "value", by: str = "source_file") -> DataFrame:
    """(by, delimiter, n): the delimiter that the texts of each file hold most often outside quotes; the first listed on ties."""
    bare = F.regexp_replace(F.col(column), '"[^"]*("|$)', "")
    counts = lines.select(by, bare.alias("_bare")).groupBy(by).agg(*[F.sum(F.length("_bare") - F.length(F.replace(F.col("_bare"), F.lit(d), F.lit("")))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)])
    pairs = F.array(*[F.struct(F.coalesce(f"d{i}", F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)])
    return counts.select(by, F.array_max(pairs).alias("p")).select(by, "p.delimiter", "p.n")


def _heads(lines: DataFrame) -> DataFrame:
    """(path, value): the first 64 KiB of each file as one text, line by line; a line counts with its break, and the first line always counts."""
    first = lines.where("block = 0").groupBy("path").agg(F.min("_at").alias("_first"))
    near = lines.where("block = 0").join(first, "path").where(F.col("_at") - F.col("_first") < HEAD_BYTES)  # a line has a byte at least
    before = F.coalesce(F.sum(F.octet_length("value") + 1).over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = near.withColumn("_before", before).where(F.col("_before") < HEAD_BYTES).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_lines"))
    return texts.select("path", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _split(text: Column, delimiter: Column) -> Column:
    return F.split(text, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def _opens(piece: Column) -> Column:
    """Whether a field that begins with this piece goes on behind its delimiter or line break: only a quote at its start opens one."""
    return F.ltrim(piece).startswith('"') & (_quotes(piece) % 2 == 1)


def _ends_open(line: Column, delimiter: Column, start: bool) -> Column:
    """Whether a line that starts inside (or outside) quotes ends inside them."""
    step = lambda inside, p: F.when(inside, _quotes(p) % 2 == 0).otherwise(_opens(p))
    return F.when(line.contains('"'), F.aggregate(_split(line, delimiter), F.lit(start), step)).otherwise(F.lit(start))


def _cells(text: Column, delimiter: Column) -> Column:
    """The cells of a record: pieces between delimiters, those inside quotes joined again."""
    none = F.lit(None).cast("string")
    joined = lambda acc, p: F.concat(acc["held"], delimiter, p)
    closes = lambda acc, p: acc["held"].isNotNull() & (_quotes(p) % 2 == 1)
    cells = lambda acc, p: F.when(closes(acc, p), F.concat(acc["cells"], F.array(joined(acc, p)))).when(acc["held"].isNotNull() | _opens(p), acc["cells"]).otherwise(F.concat(acc["cells"], F.array(p)))
    held = lambda acc, p: F.when(acc["held"].isNotNull() & ~closes(acc, p), joined(acc, p)).when(acc["held"].isNull() & _opens(p), p)
    last = lambda acc: F.when(acc["held"].isNull(), acc["cells"]).otherwise(F.concat(acc["cells"], F.array(acc["held"])))
    start = F.struct(F.array().cast("array<string>").alias("cells"), none.alias("held"))
    folded = F.aggregate(_split(text, delimiter), start, lambda acc, p: F.struct(cells(acc, p).alias("cells"), held(acc, p).alias("held")), last)
    return F.when(text.contains('"'), folded).otherwise(_split(text, delimiter))


def _state(rows: DataFrame, by: list[str], order: str, whole: bool = False) -> DataFrame:
    """Compose the steps (out, inn: the state behind a step that starts outside or inside quotes) of each group in order.

    Adds from_out and from_in: the state before each step (``whole``: one row a group, behind all of them) by the state before the
    group. A step forgets its start, keeps it or turns it over, so the state is what the last forgetting step gave, turned
    over once for each turning step since.
    """
    window = Window.partitionBy(*by).orderBy(order)
    steps = rows.withColumns({"_set": F.when(F.col("out") == F.col("inn"), F.col("out")), "_turns": F.sum((F.col("out") & ~F.col("inn")).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0))})
    mark = F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("state"), F.col("_turns").alias("turns")))
    if whole:
        ends = steps.withColumn("_mark", mark).groupBy(*by).agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(order))).alias("_mark"), F.max("_turns").alias("_turns"))
    else:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        ends = steps.withColumns({"_mark": F.last(mark, ignorenulls=True).over(before), "_turns": F.coalesce(F.max("_turns").over(before), F.lit(0))})
    odd = (F.col("_turns") - F.coalesce("_mark.turns", F.lit(0))) % 2 == 1
    after = lambda start: F.coalesce("_mark.state", F.lit(start)) != odd
    return ends.withColumns({"from_out": after(False), "from_in": after(True)}).drop("_set", "_mark", "_turns")


def numbered(rows: DataFrame, name: str, *, across: bool = False) -> DataFrame:
    """Rows of a scan with ``path`` and ``block`` (their file and their part's start in it), numbered from 0 by place in their file, or ``across`` all files in order of their paths."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    order = Window.orderBy("path", "block") if across else Window.partitionBy("path").orderBy("block")  # one row a part of a file
    before = blocks.select("path", "block", "_first", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    return placed.join(before, ["path", "block"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_before")


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, sheet: str = "Sheet1") -> DataFrame:
    """Delimited files as raw rows: (source_file, source_sheet, source_row, cells), cells trimmed and empty ones null.

    Without a delimiter each file gets the one that its first 64 KiB hold most often outside quotes. Rows may have any number of cells. A field is quoted if it begins
    with a quote; quoted fields hold delimiters, doubled quotes and line breaks, and other quotes are text. A quote that its
    file never closes is text too: from its row on, each line is a row. Rows are numbered from 0 within their file.

    Files are read in parts, and whether a part starts inside quotes depends on all parts before it. So each part first tells its end state for both
    start states, these are composed along the file (one row a part), and then each part knows where its rows begin. Only rows of
    several lines are gathered; a row that crosses parts is one of them.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block")).withColumn("_at", F.monotonically_increasing_id())
    if delimiter is None:
        lines = lines.join(best_delimiter(_heads(lines), by="path").drop("n"), "path")
    else:
        lines = lines.withColumn("delimiter", F.lit(delimiter))
    d = F.col("delimiter")
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    steps = lines.withColumns({"out": _ends_open(F.col("value"), d, False), "inn": _ends_open(F.col("value"), d, True)})
    part = ["path", "block"]
    # the parts' own steps, then the state at the start of each part, then that of each line
    parts = _state(steps, part, "_at", whole=True).select(*part, F.col("from_out").alias("out"), F.col("from_in").alias("inn"))
    starts = _state(parts, ["path"], "block").select(*part, F.col("from_out").alias("_inside"))
    ends = _state(parts, ["path"], "block", whole=True).select("path", F.col("from_out").alias("_unclosed"))
    placed = _state(steps, part, "_at").join(starts, part).withColumn("_begins", ~F.when(F.col("_inside"), F.col("from_in")).otherwise(F.col("from_out")))
    # numbers of rows: those that begin in the part, after those of the parts before
    begun = placed.groupBy(*part).agg(F.count_if("_begins").alias("_n"))
    begun = begun.select(*part, (F.sum("_n").over(Window.partitionBy("path").orderBy("block")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("path")).alias("_all"))
    own = Window.partitionBy(*part).orderBy("_at")
    rows = placed.join(begun, part).join(ends, "path").withColumn("source_row", F.col("_before") + F.count_if("_begins").over(own.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    # the last row of a file that ends inside quotes is taken apart: its lines are rows, and their quotes text
    loose = F.col("_unclosed") & (F.col("source_row") == F.col("_all") - 1)
    keep = ["path", "source_file", "source_row", "delimiter"]
    rows = rows.select(*keep, "block", "_at", "value", loose.alias("_loose"), (F.col("_begins") & ~F.col("out")).alias("_whole"))
    whole = rows.where("_whole AND NOT _loose").select(*keep, "value", F.lit(True).alias("_quoted"))
    several = rows.where("NOT _whole AND NOT _loose").groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("block", "_at", "value"))).alias("_lines"))
    several = several.select(*keep, F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"), F.lit(True).alias("_quoted"))
    torn = rows.where("_loose").withColumn("source_row", F.col("source_row") + F.row_number().over(Window.partitionBy("path").orderBy("block", "_at")) - 1).select(*keep, "value", F.lit(False).alias("_quoted"))
    found = whole.unionByName(several).unionByName(torn)
    cells = F.when(F.col("_quoted"), _cells(F.col("value"), d)).otherwise(_split(F.col("value"), d))
    unquoted = lambda c: F.when(F.col("_quoted"), F.regexp_replace(F.regexp_replace(F.trim(c), '(?s)^"(.*)"$', "$1"), '""', '"')).otherwise(c)
    return found.select("source_file", F.lit(sheet).alias("source_sheet"), "source_row", F.transform(cells, lambda c: F.nullif(F.trim(unquoted(c), F.lit(" \t\r\n\x0b\x0c")), F.lit(""))).alias("cells"))


def cell_text(cell: Column) -> Column:
    """A cell's text without tags, entities or extra white space."""
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(F.translate(out, " ", " "), r"\s+", " ")), F.lit(""))


def html_rows(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", row_tag: str = "tr", cell_tag: str = "t[dh]") -> DataFrame:
    """(id, source_row, cells) of each table row of each page; pages without rows give none."""
    row = rf"(?is)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"
    cell = rf"(?is)<{cell_tag}\b[^>]*>(.*?)</{cell_tag}>"
    rows = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(html_col, F.lit(row), F.lit(1))).alias("source_row", "row"))
    return rows.select(id_col, "source_row", F.transform(F.regexp_extract_all("row", F.lit(cell), F.lit(1)), cell_text).alias("cells"))


def allowed(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    good = F.lit(False)
    for s in SUFFIXES:
        good = good | name.endswith(s)
    for p in PASSED_OVER:
        good = good & ~name.startswith(p)
    return good & ~name.contains("done")


def file_format(content: Column, path: Column) -> Column:
    """xlsx, encrypted, xls, html, csv or unknown, by the first bytes and not by the suffix (but for csv)."""
    head = F.hex(F.substring(content, 1, 8))
    wide = F.hex(F.substring(content, 1, 2048))
    holds = lambda name: wide.contains(name.encode("utf-16-le").hex().upper())  # noqa: E731  bytes of any kind, so they are not decoded
    start = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    ole = head == "D0CF11E0A1B11AE1"
    return (
        F.when(head.startswith("504B0304"), "xlsx").when(ole & (holds("EncryptedPackage") | holds("StrongEncryption")), "encrypted").when(ole, "xls")
        .when(start.contains("<html") | start.contains("<table"), "html").when(F.lower(path).endswith(".csv"), "csv").otherwise("unknown")
    )


def legacy_format(content: Column, path: Column) -> Column:
    """The older loader's guess: four bytes of OLE, html in 500 bytes, csv by suffix, else EXCEL."""
    start = F.lower(F.decode(F.substring(content, 1, 500), "ISO-8859-1"))
    return F.when(F.hex(F.substring(content, 1, 4)) == "D0CF11E0", "EXCEL").when(start.contains("<html") | start.contains("<table"), "HTML").when(F.lower(path).endswith(".csv"), "CSV").otherwise("EXCEL")


def _uri() -> Column:
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")


def _hashed(chunks):
    """Digest and first bytes of each file, whose chunks come in order; one batch of them at a time is held."""
    of, left = None, 0
    for batch in chunks:
        rows = []
        for path, size, mark, chunk in zip(*(batch.column(c) for c in ("path", "size", "mark", "chunk"))):
            path, size, data = path.as_py(), size.as_py(), memoryview(chunk.as_buffer())
            if of != path:
                if left:
                    raise RuntimeError(f"{of} lacks {left} bytes")
                of, head = path, BYTE_ORDER_MARK if mark.as_py() else b""
                digest, left = hashlib.sha256(head), size - len(head)
            data = data[:left]  # the last line has no break, unless the file has
            digest.update(data)
            left -= len(data)
            head += bytes(data[: max(0, 2048 - len(head))])
            if not left:
                rows.append((path, size, digest.hexdigest(), head))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.binary()))], names=["path", "length", "content_sha256", "content"])
    if left:
        raise RuntimeError(f"{of} lacks {left} bytes")


def _chunks(batches):
    """Lines of a part of a file as chunks of about a MB, each line with its break."""
    for batch in batches:
        out, held, of = [], [], None
        for path, block, size, line in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size", "line"))):
            if held and (of != (path, block, size) or weight > CHUNK_BYTES):
                out.append((*of, held))
                held = []
            if not held:
                of, weight = (path, block, size), 0
            held.append(line)
            weight += len(line) + 1
        if held:
            out.append((*of, held))
        columns = [[o[0] for o in out], [o[1] for o in out], [o[2] for o in out], [b"\n".join(o[3]) + b"\n" for o in out]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["path", "block", "size", "chunk"])


def _by_lines(lines: DataFrame) -> DataFrame:
    """(uri, length, content_sha256, content: the first 2048 bytes) of large files, read in parts as lines and hashed in order, a batch of chunks at a time.

    Spark's reader of whole files refuses those of 2 GB and more. Its reader of lines gives all bytes but the breaks, a byte order mark and whether the last line has a
    break; the size of the file tells the last two. A digest needs its bytes in order, so one task a file sees all of them, as a stream.
    """
    lines = lines.select(_uri().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    chunks = written(lines.mapInArrow(_chunks, "path string, block long, size long, chunk binary").withColumns({"at": F.monotonically_increasing_id(), "n_bytes": F.octet_length("chunk")}))
    # lines hold all bytes and one more where the last line has no break; three are missing where a byte order mark was left out
    marks = chunks.groupBy("path").agg((F.sum("n_bytes") < F.max("size")).alias("mark"))
    ordered = chunks.join(F.broadcast(marks), "path").repartition("path").sortWithinPartitions("path", "block", "at")  # marks: a row a large file
    return ordered.select("path", "size", "mark", "chunk").mapInArrow(_hashed, "path string, length long, content_sha256 string, content binary").withColumnRenamed("path", "uri")


def file_inventory(spark: SparkSession, path: str, *, pattern: str = "*", whole_bytes: int = 256 << 20) -> DataFrame:
    """(filename, path, size_bytes, content_sha256, detected_format, allowed) of the files below a folder; contents go no further.

    Spark's readers leave out empty files; those come from the listing, which the driver has for the scan. Files over ``whole_bytes``
    are not loaded whole.
    """
    below = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").load(path)
    files = below("binaryFile")
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", uri), unquote(re.sub("^file:/+", "file:/", uri))) for uri in files.inputFiles()], "uri string, path string")
    empty = names.join(files.select(_uri().alias("uri")), "uri", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.sha2(F.lit(b""), 256).alias("content_sha256"), F.lit(b"").alias("content"))
    # packed files are left to the reader of whole files, as that of lines unpacks them; the scans read no files that these tests leave out
    large = (F.col("_metadata.file_size") > whole_bytes) & ~F.lower("_metadata.file_path").rlike(PACKED)
    whole = files.where(~large).select("path", "length", F.sha2("content", 256).alias("content_sha256"), F.substring("content", 1, 2048).alias("content"))
    found = whole.unionByName(empty)
    if not files.where(large).select("path").isEmpty():
        found = found.unionByName(_by_lines(below("text").where(large)).join(names, "uri").drop("uri"))
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "path", F.col("length").alias("size_bytes"), "content_sha256", file_format(F.col("content"), F.col("path")).alias("detected_format"), allowed(F.col("path")).alias("allowed"))


def repeated_files(inventory: DataFrame, source_files: DataFrame, jobs: DataFrame, *, force: bool = False) -> DataFrame:
    """The inventory with ``prior_job``: the latest job that did not fail over a file of the same content (none with ``force``)."""
    done = source_files.select(F.col("id").alias("source_file_id"), "content_sha256").join(jobs.where("status <> 'FAILED'").select("source_file_id", F.col("id").alias("job_id")), "source_file_id")
    latest = done.groupBy("content_sha256").agg(F.max("job_id").alias("prior_job"))
    out = inventory.join(latest, "content_sha256", "left")
    return out.withColumn("prior_job", F.lit(None).cast("bigint")) if force else out


def read_developments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The reference table (name, emirate, region, developer, dev_type, confidence) with ``ord``, a row's place in it; dashes and blanks are null, rows without a name are left out."""
    rows = spark.read.format(fmt).load(path)
    names = ("name", "emirate", "region", "developer", "dev_type", "confidence")
    tidy = lambda c: F.when(~F.trim(F.col(c)).isin("", "-", "–", "—"), F.trim(F.col(c)))
    out = rows.select(*[(tidy(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in names], F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return numbered(out, "ord", across=True).where("name IS NOT NULL").drop("path", "block")
