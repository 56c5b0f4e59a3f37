"""Token files of compressed bit planes, written in document order and read back.

A file set is a folder of two Parquet tables, so it lies on any storage that Spark reaches:

``chunks``  one row for each block of ``block`` ids of a file: file, chunk, first (ids of the file
            before it), n_ids, planes (one zstandard frame for each bit or byte plane, lowest first),
            kind (of the planes) and the documents that have ids in it: doc_ids, doc_firsts (place in the file), doc_tokens.
``index``   one row for each chunk without its planes: file, chunk, first, n_ids, n_docs (with ids there), n_bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import shuffle_width, text_hash
from ledgerloom.llm.tokens import Encoder


def to_planes(ids: np.ndarray, kind: str = "bit", level: int = 1) -> list[bytes]:
    """The planes of unsigned ids: bit i of all ids, or byte i of all ids, each compressed; none above the highest in use."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level, write_checksum=True)
    width = max(1, int(ids.max(initial=0)).bit_length())
    small = np.ascontiguousarray(ids, "<u2" if width <= 16 else "<u4")
    if kind == "byte":
        octets = small.view(np.uint8).reshape(len(small), small.dtype.itemsize)
        return [press.compress(octets[:, i].tobytes()) for i in range(-(-width // 8))]
    return [press.compress(np.packbits((small & small.dtype.type(1 << bit)) != 0, bitorder="little").tobytes()) for bit in range(width)]


def from_planes(planes: list[bytes], n_ids: int, kind: str = "bit") -> np.ndarray:
    import zstandard

    press = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(press.decompress(p), np.uint8) for p in planes]
    if kind == "byte":
        octets = np.zeros((n_ids, 4), np.uint8)
        for i, x in enumerate(raw):
            octets[:, i] = x
        return octets.view("<u4").reshape(-1)
    out = np.zeros(n_ids, "<u2" if len(raw) <= 16 else "<u4")
    for bit, x in enumerate(raw):
        out |= np.unpackbits(x, count=n_ids, bitorder="little").astype(out.dtype) << out.dtype.type(bit)
    return out.astype("<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, block: int = 65_536, kind: str = "bit", end_id: int = 2, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each and write the ids in ascending id order.

    ``files`` ranges of ids (default: the session's shuffle width) are encoded side by side, one file
    each. A null or empty text writes the end id alone; null ids come first; rows that repeat an id
    are documents of their own, ordered by a hash of their text; many of them are dealt over several files. Other columns are not read.
    Texts go through the tokenizer as it is: one that holds the text of an added token gets that token's id.
    """

    def encode(batches):
        from pyspark import TaskContext

        coder, file = Encoder.of(tokenizer_path), TaskContext.get().partitionId()
        held, n_held, chunk, first, at, starts = [], 0, 0, 0, 0, []

        def row(ids):
            stop = first + len(ids)
            docs_in = [d for d in starts if d[1] < stop]
            starts[:] = [d for d in starts if d[1] + d[2] > stop]
            return pa.RecordBatch.from_pylist(
                [{"file": file, "chunk": chunk, "first": first, "n_ids": len(ids), "planes": to_planes(ids, kind), "kind": kind, "doc_ids": [d[0] for d in docs_in], "doc_firsts": [d[1] for d in docs_in], "doc_tokens": [d[2] for d in docs_in]}],
                schema=pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("kind", pa.string()), ("doc_ids", pa.list_(id_type)), ("doc_firsts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))]),
            )

        for batch in batches:
            names = batch.column("id")
            id_type = names.type
            names = names.to_pylist()
            for begin, ids, ends in coder.encode(batch.column("text")):
                sizes = np.diff(ends) + 1
                full = np.full(len(ids) + len(sizes), end_id, np.uint32)
                body = np.ones(len(full), bool)
                body[np.cumsum(sizes) - 1] = False
                full[body] = ids
                for k, n in enumerate(sizes.tolist()):
                    starts.append((names[begin + k], at, n))
                    at += n
                held.append(full)
                n_held += len(full)
                if n_held >= block:
                    flat = np.concatenate(held)
                    for i in range(0, len(flat) - block + 1, block):
                        yield row(flat[i : i + block])
                        chunk, first = chunk + 1, first + block
                    held = [flat[len(flat) // block * block :]]
                    n_held = len(held[0])
        if n_held:
            yield row(np.concatenate(held))

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind_of_id = source.schema["id"].dataType.simpleString()
    ordered = source.repartitionByRange(files or shuffle_width(docs.sparkSession), F.col("id"), text_hash(), F.rand(7)).sortWithinPartitions(F.col("id"), text_hash())
    ordered.mapInArrow(encode, f"file int, chunk int, first long, n_ids int, planes array<binary>, kind string, doc_ids array<{kind_of_id}>, doc_firsts array<long>, doc_tokens array<long>").write.parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.parquet(f"{path}/chunks")
    chunks.select("file", "chunk", "first", "n_ids", F.size("doc_ids").alias("n_docs"), F.expr("aggregate(planes, 0L, (n, p) -> n + octet_length(p))").alias("n_bytes")).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """One row a document in the files: id_col, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    pieces = _document_pieces(spark.read.parquet(f"{path}/chunks"), whole_ids=True)
    whole = pieces.groupBy("file", "first").agg(F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    return _placed(spark, whole.withColumn("ids", ids).drop("parts"), path, id_col)


def document_checksums(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """As :func:`read_token_files`, with ids_crc32 in place of the ids; only documents on the edge of a chunk move with their ids."""
    pieces = _document_pieces(spark.read.parquet(f"{path}/chunks"), whole_ids=False)
    whole = pieces.groupBy("file", "first").agg(
        F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), F.max("crc").alias("crc"), F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("chunk", "ids")))).alias("parts")
    )
    ids = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    return _placed(spark, whole.withColumn("ids_crc32", F.coalesce("crc", F.crc32(ids))).drop("parts", "crc"), path, id_col)


def _placed(spark: SparkSession, rows: DataFrame, path: str, id_col: str) -> DataFrame:
    """Add to each file's own places the ids of the files before it (one row a file)."""
    totals = {r["file"]: r["n"] for r in spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    before, at = [], 0
    for file in sorted(totals):
        before.append((file, at))
        at += totals[file]
    base = spark.createDataFrame(before, "file int, before long")
    return rows.join(F.broadcast(base), "file").select(F.col("id").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", *[c for c in rows.columns if c in ("ids", "ids_crc32")])


def _document_pieces(chunks: DataFrame, whole_ids: bool) -> DataFrame:
    """The part of each document that each chunk holds; documents inside one chunk get their checksum at once."""
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        import zlib

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, at = from_planes(r["planes"], r["n_ids"], r["kind"]), r["first"]
                for name, first, n in zip(r["doc_ids"], r["doc_firsts"], r["doc_tokens"]):
                    part = ids[max(0, first - at) : first + n - at].tobytes()
                    whole = len(part) == 4 * n
                    rows.append({"file": r["file"], "chunk": r["chunk"], "first": first, "id": name, "n_tokens": n, "crc": zlib.crc32(part) if whole else None, "ids": part if whole_ids or not whole else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("id", batch.column("doc_ids").type.value_type), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())]))

    return chunks.mapInArrow(decode, f"file int, chunk int, first long, id {id_type}, n_tokens long, crc long, ids binary")
