"""Tables that one step writes and the next ones read, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that setting is missing, a local session gets a temporary folder; on a cluster, whose executors
    could not see such a folder, this is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def spread(rows: DataFrame, *keys: str, rows_a_part: int = 20_000, n: int | None = None) -> DataFrame:
    """``rows`` dealt by ``keys`` over all cores, and over more parts where a part would hold more than ``rows_a_part``.

    Work on each row is dear where the rows themselves are small, so a file of a few MB, which a scan gives to one task, is
    hours of that task's work. The rows are counted first, from Parquet footers where nothing but their number is asked,
    unless ``n`` tells how many there are.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows.count() if n is None else n) // rows_a_part))
    return rows.repartition(parts, *keys)


def written(rows: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """Write ``rows`` as Parquet into the shared folder and read them from there, by another session where one is given: later steps start from a scan, and a lost executor costs none of what came before."""
    path = f"{shared_root(rows.sparkSession)}/step-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return (session or rows.sparkSession).read.schema(rows.schema).parquet(path)
