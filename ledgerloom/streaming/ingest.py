"""Registers as they arrive: each micro-batch is normalised, held against known identities and appended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerloom.operators.stats import run_counters
from ledgerloom.plans.pipeline import identified, judged
from ledgerloom.sources.shared import written
from ledgerloom.sources.sinks import write_records

STATUSES = ("VALID", "INCOMPLETE", "DUPLICATE", "INVALID")

#: State in RocksDB: a lookup a key, and a batch writes what it changed; the default store keeps all keys in the executors' memory.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _append(checked: DataFrame, known: DataFrame | None, batch_id: int, target: str, counters: str | None, totals: str | None) -> None:
    """Classify one batch and write it. Its totals are observed while its records are written; counters of its files come from the written statuses."""
    spark, seen = checked.sparkSession, Observation()
    records = judged(checked, known=known, scope="global")
    watched = records.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    write_records(watched.withColumn("batch_id", F.lit(batch_id)), target, replace=True, parts=("batch_id", "source_file"))
    if totals:
        counts = seen.get
        columns = ", ".join(f"{c} long" for c in ("batch_id", *counts))
        write_records(spark.createDataFrame([(batch_id, *counts.values())], columns), totals, replace=True, parts=("batch_id",))
    if counters:
        stored = spark.read.schema("source_file string, status string, batch_id long").parquet(target).where(F.col("batch_id") == batch_id)
        write_records(run_counters(stored).withColumn("batch_id", F.lit(batch_id)), counters, replace=True, parts=("batch_id",))


def append_batch(target: str, counters: str | None = None, totals: str | None = None):
    """A function (rows of mapped text, batch id) for single batches outside a stream.

    A row whose identity the record table at ``target`` holds already from another batch is a DUPLICATE and is kept as such: the identities of the
    whole table are read for it, which :func:`ingest_stream` does not do. Counters of each batch go to ``counters`` (by file) and ``totals``.
    All tables are parted by batch_id, and a batch that is tried again replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(target).where(F.col("batch_id") < batch_id).select("identity_hash", "source_file")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        _append(written(identified(batch)), known, batch_id, target, counters, totals)

    return write


def seen_before(checked: DataFrame) -> DataFrame:
    """(identity_hash): identities of a stream's valid rows that an earlier batch had, once a batch.

    Identities are keyed state, so a batch looks up its own ones and no others, however many are known. Repeats within an
    Arrow batch are dropped before the shuffle, so an identity that a third of the rows share reaches its task as a few rows.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(batch.column(0))], names=["identity_hash"])

    def remember(key, rows, state) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        if state.exists:
            yield pd.DataFrame({"identity_hash": [key[0]]})
        else:
            state.update((True,))

    keys = checked.where("is_valid AND identity_hash IS NOT NULL").select("identity_hash").mapInArrow(once, "identity_hash string")
    return keys.groupBy("identity_hash").applyInPandasWithState(remember, "identity_hash string", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(rows: DataFrame, target: str, checkpoint: str, *, counters: str | None = None, totals: str | None = None) -> StreamingQuery:
    """Run over all that has arrived and stop; ``rows`` is a streaming DataFrame of mapped text rows.

    A valid row whose identity a valid row of an earlier batch had is a DUPLICATE. Identities known so far are state under ``checkpoint``: a batch reads what
    its own rows need, not the record table, and one that is tried again finds the state that it found before. The rows and the
    identities that were known arrive in one union, which is written once and then judged. The stream's progress reports
    ``arrived``: rows and valid rows of each batch, observed on the way.

    Call it again as files arrive: the checkpoint remembers which files are done. A checkpoint made before identities were state cannot be continued.
    """
    spark = rows.sparkSession
    checked = identified(rows.repartition(spark.sparkContext.defaultParallelism))  # a file of a few MB is one task of a scan, and its cleaning is dear
    shape = checked.schema
    watched = checked.observe("arrived", F.count(F.lit(1)).alias("rows"), F.count_if("is_valid").alias("valid"))
    arrived = watched.select(F.struct("*").alias("row"), F.lit(None).cast("string").alias("seen"))
    known = seen_before(checked).select(F.lit(None).cast(shape).alias("row"), F.col("identity_hash").alias("seen"))

    def write(batch: DataFrame, batch_id: int) -> None:
        both = written(batch, spark)  # a stream's own session has no adaptive planning: each small shuffle of the steps below would be 200 tasks
        _append(both.where("row IS NOT NULL").select("row.*"), both.where("seen IS NOT NULL").select(F.col("seen").alias("identity_hash")), batch_id, target, counters, totals)

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it started with
        return arrived.unionByName(known).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def register_stream(spark: SparkSession, path: str, schema: str, *, files_a_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(fmt).load(path)
