"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import kept, shuffle_width


def _totals(batches):
    """One row for each partition: its number, rows and bytes."""
    from pyspark import TaskContext

    rows = size = 0
    for batch in batches:
        rows += batch.num_rows
        size += int(np.sum(batch.column("size").to_numpy()))
    yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "rows": [rows], "bytes": [size]})


def assign_shards(docs: DataFrame, n_shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows into ``n_shards`` contiguous shards of nearly equal byte sizes.

    Rows are ordered by id (null first; ties by the text's checksum and size, so repeated rows
    lie side by side). A row's size is the UTF-8 length of its text plus 8. Each partition of
    that order reports its total; prefix sums over the totals (one number a partition) give
    every row its place in the whole, and the whole is cut at equal byte targets: a row goes
    to the shard in which the middle of its bytes lies. No shard is further from the target
    than the largest row; a row above the target can leave a shard empty.

    Returns id_col, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... within the shard)
    and grown_shard (null: it belongs to another law). An empty table gives an empty result.
    Only the two columns named are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    ordered = kept(rows.repartitionByRange(shuffle_width(spark), "id", "crc", "size").sortWithinPartitions("id", "crc", "size"))
    before, n, total = {}, 0, 0
    for part in sorted(ordered.mapInArrow(_totals, "part long, rows long, bytes long").collect()):  # one row a partition
        before[part["part"]] = (n, total)
        n, total = n + part["rows"], total + part["bytes"]

    def place(batches):
        from pyspark import TaskContext

        rank, ahead = before[TaskContext.get().partitionId()]
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = ahead + np.cumsum(size)
            # twice the middle of the row's bytes, against twice the total: whole numbers only
            middle = [int(e) * 2 - int(s) for e, s in zip(ends, size)]
            shard = [min(n_shards - 1, m * n_shards // (2 * total)) for m in middle]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("size"), batch.column("crc"), pa.array(shard, pa.int32()), pa.array(rank + np.arange(len(size)), pa.int64())],
                names=["id", "size", "crc", "shard", "rank"],
            )
            rank, ahead = rank + len(size), int(ends[-1]) if len(size) else ahead

    id_type = rows.schema["id"].dataType.simpleString()
    placed = ordered.mapInArrow(place, f"id {id_type}, size long, crc long, shard int, rank long")
    first = placed.groupBy(F.col("shard").alias("of")).agg(F.min("rank").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), F.col("shard") == F.col("of")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
