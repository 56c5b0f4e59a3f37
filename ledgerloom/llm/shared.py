"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import shared_root


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the cluster's shared folder and read it from there.

    Partitions and their order stay as they are, and nothing depends on an executor's own disk.
    """
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it from there.

    Smaller than what :func:`kept` writes, and the planner starts afresh: what it has inferred about the columns
    of a checkpoint is carried along and doubles with each round of an iteration. Partitions may change.
    """
    path = f"{shared_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for pause in (0.5, 0.5, 0):  # Spark's listeners hold a step for a moment after its end
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


#: Bits a value in which :func:`maybe_among` looks, and bits in all at most (32 MB).
LEAST_BITS, MOST_BITS = 16, 1 << 28


def maybe_among(df: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose 64-bit hash ``on`` is one of ``wanted``'s, and up to a sixteenth of the others (more, if ``wanted`` has over 16 million rows).

    So a join of the two need not move all rows. What is sent is a table of bits of bounded size.
    """
    bits = min(MOST_BITS, max(1 << 20, 1 << (LEAST_BITS * wanted.count()).bit_length()))
    place = wanted.select((F.pmod(on, F.lit(bits)) + 1).alias("place"))
    held = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect():
        held[(r.part - 1) * len(r.bits) : r.part * len(r.bits)] = np.frombuffer(r.bits, np.uint8)

    def look(key: pa.Array) -> pa.Array:
        at = key.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
        return pa.array(held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1)

    return df.where(F.arrow_udf(look, "boolean")(F.col(on)))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_hash(text: str = "text"):
    """A 64-bit key that tells apart rows which share a document id but not their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def plain_strings(values) -> pa.StringArray:
    """One string array with 32-bit offsets and no nulls (null: empty)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.type != pa.string():
        values = values.cast(pa.string())
    return pc.fill_null(values, "") if values.null_count else values


def release() -> None:
    """Give memory that this Python worker no longer uses back to the machine; workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that broadcasts neither side.

    Spark sizes a written table by its compressed files, and what an explode makes by the rows before it. So it may take a table of ten
    times its threshold for a small one, which the driver's memory then has to hold. For tables that grow with the input.
    """
    return df.hint("merge")


#: Keys that hold more than one row in so many are joined on their own; there are fewer than this.
HOT_SHARE = 1000


def hot_keys(sized: DataFrame, n: str = "n", total: int | None = None) -> DataFrame:
    """The keys that hold over a thousandth of all rows, without ``n``: fewer than a thousand rows. ``sized`` has a row a key, with its rows in ``n``."""
    if total is None:
        total = sized.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long")).first()[0]
    return written(sized.where(F.col(n) > max(64, total // HOT_SHARE)).drop(n))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Inner join that sends the rows of hot keys nowhere.

    ``hot`` lists the keys of which ``left`` holds many rows (:func:`hot_keys`: under a thousand of them), and ``right`` has a small bounded number
    of rows a key. So right's rows of hot keys are bounded and are broadcast; all other keys meet in a shuffle.
    """
    few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
    return left.join(few, on).unionByName(left.join(F.broadcast(hot), on, "left_anti").join(right, on))
