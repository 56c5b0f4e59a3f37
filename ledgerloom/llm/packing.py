"""Pack token pieces into fixed windows: best-fit decreasing over a segment tree of open windows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import kept
from ledgerloom.llm.tokens import Encoder

#: Tokens that one packing task gets on average; a task holds its pieces in memory.
TOKENS_A_TASK = 4_000_000


def token_pieces(docs: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, append ``end_id`` and cut it into full windows and one rest.

    Returns for each piece id_col, start, length, ids_crc32, doc_tokens and, if ``with_ids``,
    ids (little-endian unsigned 32-bit ids). A null or empty text is a document of the end id
    alone. Repeated rows are documents of their own. Only the two columns named are read.
    """
    def encode(batches):
        coder = Encoder.of(tokenizer_path)
        for batch in batches:
            names = batch.column("id")
            for first, ids, ends in coder.encode(batch.column("text")):
                rows: list[tuple] = []
                for k in range(len(ends) - 1):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), window):
                        part = own[start : start + window].tobytes()
                        rows.append((first + k, start, len(part) // 4, zlib.crc32(part), len(own), part if with_ids else None))
                if not rows:
                    continue
                who, start, length, crc, total, body = zip(*rows)
                columns = [names.take(pa.array(who)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                labels = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(body, pa.binary()))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return source.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; ``lengths`` come in decreasing order and fit the capacity.

    A segment tree over remaining capacities holds how many open windows have each; the first
    filled leaf at or right of a piece's length is the tightest window that takes it.
    """
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def add(leaf: int, by: int) -> None:
        at = leaves + leaf
        while at:
            tree[at] += by
            at >>= 1

    for i, length in enumerate(lengths.tolist()):
        at = leaves + length
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at > 1:
                at += 1
                while at < leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
        if at > 1:
            room = at - leaves
            own = open_at[room].pop()
            add(room, -1)
        else:
            room, own, used = capacity, used, used + 1
        window[i], offset[i] = own, capacity - room
        if room > length:
            open_at[room - length].append(own)
            add(room - length, 1)
    return window, offset


def pack(pieces: DataFrame, *, capacity: int = 4096, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "start"), tokens_a_task: int = TOKENS_A_TASK) -> DataFrame:
    """Give each piece a sequence_id and an offset in it; no sequence exceeds ``capacity``.

    Pieces are dealt by the hash of their place in the table (so equal keys spread too) into tasks of about ``tokens_a_task`` tokens, and
    each task packs its own pieces, longest first (ties by key), so a task's memory does not grow
    with the input and at most a few windows a task stay part-empty. sequence_id is the task's
    number times 2**32 plus the window's number there. All columns of ``pieces`` are kept;
    an empty table gives an empty result. Every length must lie in 1..capacity.
    """
    pieces = kept(pieces)
    total = pieces.agg(F.sum(length_col)).first()[0] or 0
    tasks = max(1, -(-total // tokens_a_task))
    sequence, place = "sequence_id", "offset"

    def fill(batches):
        from pyspark import TaskContext

        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[(length_col, "descending"), *((k, "ascending") for k in key_cols)])
        table = table.take(order)
        window, offset = best_fit(table.column(length_col).to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        table = table.append_column(sequence, pa.array(base + window)).append_column(place, pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    schema = T.StructType([*pieces.schema.fields, T.StructField(sequence, T.LongType()), T.StructField(place, T.LongType())])
    return pieces.repartition(int(tasks), F.monotonically_increasing_id()).mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Encode, cut and pack all documents: one row a piece, with sequence_id and offset.

    Columns: those of :func:`token_pieces`, sequence_id, offset. Null and empty texts are pieces of the end id alone, null and
    repeated ids are documents of their own, an empty table gives an empty result. Texts go through the tokenizer as it is: one that
    holds the text of an added token gets that token's id.
    """
    return pack(token_pieces(docs, tokenizer_path, window=window, end_id=end_id, with_ids=with_ids), capacity=window)
