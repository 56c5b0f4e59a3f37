"""Re-run what has changed: files whose content, headings' aliases or reference table differ from their last run, and no others.

A store is a folder with records/ and errors/ (a folder a run), runs/ (counters of each batch) and manifest/ (versions of one small table: which run of each
file counts), failures/ (what left no rows). A run's rows are staged first and count only once the manifest names them, in one file written last. So a batch that fails leaves
no rows, a re-run replaces all rows of a file even if it gives none, and readers see the old rows until then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import cleaners as C
from ledgerloom.operators import mapping
from ledgerloom.plans.pipeline import normalise
from ledgerloom.sources.shared import written

MANIFEST = "source_file string, fingerprint string, run string"
ERRORS = "source_file string, source_sheet string, source_row long, severity string, code string, message string, payload string"
COUNTED = ["VALID", "INCOMPLETE", "DUPLICATE"]


def _sum(*columns) -> F.Column:
    """A checksum of rows in any order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def fingerprints(raw_rows: DataFrame, aliases: DataFrame, developments: DataFrame | None = None) -> DataFrame:
    """(source_file, fingerprint, n_rows): changes with a file's cells, with the aliases of headings that stand in its first rows, and with the reference table."""
    content = raw_rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), _sum("source_sheet", "source_row", "cells").alias("content"))
    heads = raw_rows.where(F.col("source_row") < mapping.SCAN_ROWS).select("source_file", F.explode("cells").alias("cell")).select("source_file", C.normal_header(F.col("cell")).alias("header_norm")).distinct()
    named = heads.join(aliases.select("header_norm", "target", "ord"), "header_norm").groupBy("source_file").agg(_sum("header_norm", "target", "ord").alias("headings"))
    out = content.join(named, "source_file", "left")
    if developments is not None:
        out = out.crossJoin(F.broadcast(developments.agg(_sum(*[c for c in developments.columns if c != "ord"]).alias("reference"))))  # one row
    else:
        out = out.withColumn("reference", F.lit("none"))
    return out.select("source_file", F.concat_ws(":", F.col("n_rows").cast("string"), "content", F.coalesce("headings", F.lit("-")), F.coalesce("reference", F.lit("-"))).alias("fingerprint"), "n_rows")


def _missing(e: Exception) -> bool:
    return any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def _versions(spark: SparkSession, store: str) -> int:
    """The latest version of the manifest; 0 where there is none."""
    try:
        return spark.read.schema(f"{MANIFEST}, version int").parquet(f"{store}/manifest").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except Exception as e:
        if _missing(e):
            return 0
        raise


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(source_file, fingerprint, run): the run of each file that counts. A version that lists no files has one row without a file."""
    version = _versions(spark, store)
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/version={version}").where("source_file IS NOT NULL")


def current(spark: SparkSession, store: str, kind: str = "records") -> DataFrame:
    """The rows that count: records, or errors."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{store}/{kind}")
    return rows.join(manifest(spark, store).select("source_file", "run"), ["source_file", "run"], "left_semi").drop("run")


def _publish(entries: DataFrame, store: str, version: int) -> None:
    none = entries.sparkSession.createDataFrame([(None, None, None)], MANIFEST)
    entries.select("source_file", "fingerprint", "run").unionByName(none).coalesce(1).write.parquet(f"{store}/manifest/version={version}")  # a row a file, in one file


def _write(rows: DataFrame, aliases: DataFrame, store: str, name: str, run, told: list[tuple] = (), **more) -> dict[str, int]:
    """Records and errors of one run, with ``told`` among the errors; counters are observed while the records are written."""
    records, errors, _ = run(rows, aliases, **more)
    seen = Observation()
    watched = records.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in COUNTED])
    watched.write.parquet(f"{store}/records/run={name}")
    if told:
        errors = errors.unionByName(rows.sparkSession.createDataFrame(list(told), ERRORS))
    errors.write.parquet(f"{store}/errors/run={name}")
    return seen.get


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"


def _failed_sheets(rows: DataFrame, aliases: DataFrame, run, **more) -> tuple[dict[str, str], int]:
    """(sheet and reason for each sheet of one file that fails when it runs alone, number of its sheets)."""
    sheets = [r[0] for r in rows.select("source_sheet").distinct().orderBy("source_sheet").collect()]  # the sheets of one file
    failed = {}
    for sheet in sheets if len(sheets) > 1 else ():
        try:
            for out in run(rows.where(F.col("source_sheet").eqNullSafe(sheet)), aliases, **more)[:2]:
                out.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  it is told
            failed[sheet] = _reason(e)
    return failed, len(sheets)


def rerun(raw_rows: DataFrame, aliases: DataFrame, store: str, *, developments: DataFrame | None = None, files_a_batch: int = 1000, most_alone: int = 20, force: bool = False, run=normalise, **more) -> DataFrame:
    """Bring a store up to date with its raw rows, aliases and reference table. One row a file: source_file, action, run.

    action is new, changed, kept, removed, partial or failed. New and changed files (all, with ``force``) are normalised in batches of
    ``files_a_batch``; a removed file's rows no longer count. A batch that fails leaves no rows and is halved until its bad files stand
    alone, so that the others count. A bad file runs without those of its sheets that fail alone (partial): each is one error SHEET_FAILED among the
    file's errors. Files that fail whole keep what they had, and one BATCH_INSERT_FAILED tells their rows and files, and the
    file's name where it stands alone. Where ``most_alone`` files of a batch have
    failed, its other parts are halved no more. Partial and failed files are tried at the next call. Counters of each run are observed while its
    records are written, so that no second pass is made; they go to ``store``/runs. A call that finds nothing new writes nothing.
    """
    spark = raw_rows.sparkSession
    more["developments"] = developments
    now, before = written(fingerprints(raw_rows, aliases, developments)), written(manifest(spark, store))
    old = before.select("source_file", F.col("fingerprint").alias("was"), F.col("run").alias("old_run"))
    action = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("was").isNull(), "new").when((F.col("was") != F.col("fingerprint")) | F.lit(force), "changed").otherwise("kept")
    files = now.join(old, "source_file", "full").withColumn("action", action)
    todo = F.col("action").isin("new", "changed")
    place = F.when(todo, F.sum(todo.cast("int")).over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, 0)))  # a row a file
    files = written(files.withColumn("pos", place).withColumn("batch", F.ceil(F.col("pos") / files_a_batch).cast("int")))
    some = [F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sum("n_rows").alias("rows")]
    open_ = [tuple(b) for b in files.where("batch IS NOT NULL").groupBy("batch").agg(*some).orderBy("batch").collect()]  # a row a batch
    runs, ends, alone, version = [], [], {}, _versions(spark, store)
    none = {"total": 0, **{s.lower(): 0 for s in COUNTED}}
    while open_:
        batch, lo, hi, n_rows = open_.pop(0)
        name, counts, partial = uuid.uuid4().hex, none, False
        part = files.where(F.col("pos").between(lo, hi))
        rows = raw_rows.join(part.select("source_file"), "source_file", "left_semi")
        try:
            counts, failed = _write(rows, aliases, store, name, run, **more), None
        except Exception as e:  # noqa: BLE001  the job goes on; what failed is told
            failed = _reason(e)
        if failed and hi > lo and alone.get(batch, 0) < most_alone:
            middle = (lo + hi) // 2
            halves = [(x, y) for x, y in ((lo, middle), (middle + 1, hi))]
            open_[:0] = [(batch, x, y, files.where(F.col("pos").between(x, y)).agg(F.sum("n_rows")).first()[0]) for x, y in halves]
            continue
        if failed and hi == lo:
            bad, n_sheets = _failed_sheets(rows, aliases, run, **more)
            if 0 < len(bad) < n_sheets:
                name, file = uuid.uuid4().hex, part.select("source_file").first()[0]
                told = [(file, sheet, None, "ERROR", "SHEET_FAILED", reason, None) for sheet, reason in bad.items()]
                others = F.lit(True)
                for sheet in bad:
                    others &= ~F.col("source_sheet").eqNullSafe(sheet)
                try:
                    counts, failed, partial = _write(rows.where(others), aliases, store, name, run, told, **more), None, True
                except Exception as e:  # noqa: BLE001
                    failed = _reason(e)
        if failed:
            alone[batch] = alone.get(batch, 0) + 1
            file = part.select("source_file").first()[0] if hi == lo else None
            told = spark.createDataFrame([(file, None, None, "ERROR", "BATCH_INSERT_FAILED", failed, f'{{"files":{hi - lo + 1},"rows":{n_rows}}}')], ERRORS)
            told.write.parquet(f"{store}/failures/run={name}")
        runs.append((batch, name, failed is None, hi - lo + 1, n_rows, *(counts[k] for k in none)))
        ends.append((lo, hi, name, failed is None, partial))
    if runs:
        spark.createDataFrame(runs, f"batch int, run string, done boolean, files long, rows long, total long, {', '.join(f'{s.lower()} long' for s in COUNTED)}").write.mode("append").parquet(f"{store}/runs")
    done = spark.createDataFrame(ends, "lo long, hi long, new_run string, done boolean, partial boolean")  # a row a run
    judged = written(files.join(done.select(F.explode(F.sequence("lo", "hi")).alias("pos"), "new_run", "done", "partial"), "pos", "left"))
    kept_now = F.coalesce("done", F.lit(False))
    if runs or not judged.where("action = 'removed'").isEmpty():
        mark = F.when(F.col("partial"), F.concat("fingerprint", F.lit(":partial"))).otherwise(F.col("fingerprint"))  # differs at the next call
        entries = judged.where("action <> 'removed'").select("source_file", F.when(kept_now, mark).otherwise(F.col("was")).alias("fingerprint"), F.when(kept_now, F.col("new_run")).otherwise(F.col("old_run")).alias("run")).where("run IS NOT NULL")
        _publish(entries, store, version + 1)
    told = F.when(F.col("partial"), "partial").when(F.col("batch").isNotNull() & ~kept_now, "failed").otherwise(F.col("action"))
    return judged.select("source_file", told.alias("action"), F.when(kept_now, F.col("new_run")).when(F.col("action") != "removed", F.col("old_run")).alias("run"))
