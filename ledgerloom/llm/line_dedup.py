"""Line dedup: range-partitioned line hashes, streamed in order, give each document a bitmap of dropped lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import kept, shuffle_width, text_hash

_BLANKS = b" \t\n\x0b\x0c\r"
#: Stands for a null id inside tasks; ids are 64-bit whole numbers above it.
_NO_ID = -(2**63)


def line_hashes(docs: DataFrame, *, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (h1, h2, id, version, pos) for each line whose key has ``least_chars`` code points or more.

    A key is the line without white space at both ends and with A-Z in lower case; h1 and h2 are its 128-bit hash.
    ``version`` is a hash of the text, so rows that repeat an id with other texts stay apart.
    """

    def split(batches):
        import xxhash

        for batch in batches:
            ids, versions = batch.column("id"), batch.column("version")
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            row, pos, digests = [], [], []
            for i, text in enumerate(texts):
                for k, line in enumerate(text.as_py().lower().split(b"\n")):  # bytes: only A-Z change
                    key = line.strip(_BLANKS)
                    if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars):
                        row.append(i)
                        pos.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), ids.take(row), versions.take(row), pa.array(pos, pa.int32())], names=["h1", "h2", "id", "version", "pos"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(split, "h1 long, h2 long, id long, version long, pos int")


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    ids = pc.fill_null(batch.column("id"), _NO_ID)
    return [x.to_numpy(zero_copy_only=False) for x in (batch.column("h1"), batch.column("h2"), ids, batch.column("version"), batch.column("pos"))]


def _runs(h1, h2, ids) -> tuple[np.ndarray, np.ndarray]:
    """(where a key begins, whether a row begins a document of its key) of sorted rows."""
    new_key = np.ones(len(h1), bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new_key), new_doc


def _edges(batches):
    """The first and the last key of a partition, each with its largest id and its number of documents there."""
    from pyspark import TaskContext

    first = last = None  # [h1, h2, largest id, documents, last id seen]
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, _, _ = _arrays(batch)
        heads, new_doc = _runs(h1, h2, ids)
        docs = np.add.reduceat(new_doc, heads)
        ends = np.append(heads[1:], len(h1)) - 1
        for k in sorted({0, len(heads) - 1}):
            own = [int(h1[heads[k]]), int(h2[heads[k]]), int(ids[heads[k]]), int(docs[k]), int(ids[ends[k]])]
            if last is not None and last[:2] == own[:2]:
                last[3] += own[3] - (last[4] == own[2])
                last[4] = own[4]
            else:
                last = own
            first = first or last
    if first is not None:
        rows = [first] if first is last else [first, last]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], names=["part", "h1", "h2", "largest", "docs"])


def dropped_lines(lines: DataFrame, *, least_docs: int = 3) -> DataFrame:
    """(id, version, pos) of each line whose key is in ``least_docs`` documents or more, but for those in the largest id.

    Rows are range-partitioned by key and id, so a key that a third of all documents hold lies in many
    partitions. Ids run downwards within a key: its first occurrence names the document that keeps it. Each partition
    reports its first and last key (two rows a partition go to the driver); the second pass streams
    the partition and needs to hold the rows of a key only until its third document shows.
    """
    down = F.col("id").desc_nulls_last()
    ordered = kept(lines.repartitionByRange(shuffle_width(lines.sparkSession), "h1", "h2", down).sortWithinPartitions("h1", "h2", down, "version", "pos"))
    known: dict[tuple[int, int], list[int]] = {}
    for r in sorted(ordered.mapInArrow(_edges, "part long, h1 long, h2 long, largest long, docs long").collect()):
        own = known.setdefault((r["h1"], r["h2"]), [r["largest"], 0])
        own[1] += r["docs"]

    def stream(batches):
        state = None  # of the last key: (h1, h2, keeper, documents so far, last id)
        held = None  # rows of a key of which too few documents are known

        def judge(rows, at_end):
            nonlocal state, held
            h1, h2, ids, version, pos = rows
            heads, new_doc = _runs(h1, h2, ids)
            if state is not None and (h1[0], h2[0]) == state[:2] and ids[0] == state[4]:
                new_doc[0] = False
            docs, keeper = np.add.reduceat(new_doc, heads), ids[heads].copy()
            if state is not None and (h1[0], h2[0]) == state[:2]:
                docs[0] += state[3]
                keeper[0] = state[2]
            for k in {0, len(heads) - 1}:  # only these can be keys of other partitions too
                if (key := (int(h1[heads[k]]), int(h2[heads[k]]))) in known:
                    keeper[k], docs[k] = known[key][0], max(known[key][1], docs[k])
            sizes = np.diff(np.append(heads, len(h1)))
            drop = np.repeat(docs >= least_docs, sizes) & (np.repeat(keeper, sizes) != ids)
            tail = heads[-1]
            if docs[-1] >= least_docs or at_end:
                held, state = None, (h1[-1], h2[-1], keeper[-1], int(docs[-1]), ids[-1])
                tail = len(h1)
            else:
                held = [x[tail:] for x in rows]
                if tail:
                    state = None
            return [x[:tail][drop[:tail]] for x in (ids, version, pos)]

        def out(found):
            ids, version, pos = found
            none = ids == _NO_ID
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none), pa.array(version, pa.int64()), pa.array(pos, pa.int32())], names=["id", "version", "pos"])

        for batch in batches:
            if batch.num_rows:
                rows = _arrays(batch)
                rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
                yield out(judge(rows, False))
        if held is not None:
            yield out(judge(held, True))

    return ordered.mapInArrow(stream, "id long, version long, pos int")


def bitmap(positions: Column) -> Column:
    """A zstandard frame of one bit a line up to the last position: 1 keeps the line, 0 drops it; lines beyond it stay."""

    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for own in batch.to_pylist():
                bits = np.ones(max(own) // 8 * 8 + 8, np.uint8)  # whole bytes; lines that do not exist stay
                bits[own] = 0
                out.append(press.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.array(out, pa.binary())

    return F.arrow_udf(build, "binary")(positions)


def keep_bitmaps(docs: DataFrame, *, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, n_dropped, bitmap) of the documents that lose lines: no text is moved or returned."""
    gone = dropped_lines(line_hashes(docs, least_chars=least_chars, id_col=id_col, text_col=text_col), least_docs=least_docs)
    by_doc = gone.groupBy("id", "version").agg(F.collect_set("pos").alias("gone"))  # no more than a document's lines
    return by_doc.select("id", "version", F.size("gone").cast("long").alias("n_dropped"), bitmap(F.col("gone")).alias("bitmap"))


def kept_text(text: Column, bits: Column) -> Column:
    """The lines that a bitmap keeps, joined by line feeds."""

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for texts, bitmaps in batches:
            out = []
            for text, own in zip(texts.to_pylist(), bitmaps.to_pylist()):
                if own is None:
                    out.append(None)
                    continue
                lines = (text or "").split("\n")
                keep = np.unpackbits(np.frombuffer(press.decompress(own), np.uint8), bitorder="little").tolist()
                keep += [1] * (len(lines) - len(keep))
                out.append("\n".join([x for x, k in zip(lines, keep) if k]))
            yield pa.array(out, pa.string())

    return F.arrow_udf(apply, "string")(text, bits)


def dedup_lines(docs: DataFrame, *, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` in a struct ``row``, with n_lines, n_dropped and the text that stays (kept_text).

    A line whose key (see :func:`line_hashes`) is in ``least_docs`` documents or more goes, except from the
    document with the largest id that holds it, which keeps all its lines with that key. Ids are
    64-bit whole numbers; a null id counts as one document below all others, and rows that share an
    id count as one document. A null or empty text is one empty line; a text that keeps no line becomes empty. An empty
    table gives an empty result, and other columns pass through under any name.
    """
    maps = keep_bitmaps(docs, least_chars=least_chars, least_docs=least_docs, id_col=id_col, text_col=text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("_id"), text_hash(f"`{text_col}`").alias("_version"))
    joined = rows.join(maps, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version")), "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    touched = F.when(F.col("bitmap").isNotNull(), text)
    return joined.select(
        "row",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce(kept_text(touched, F.col("bitmap")), text).alias("kept_text"),
    )
