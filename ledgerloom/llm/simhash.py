"""SimHash near-duplicates: fingerprints of word shingles, candidates by equal blocks of bits, exact distances, components."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import hot_join, hot_keys, plain_strings, release, written
from ledgerloom.llm.words import SPACED, pieces_of, word_codes

BITS = 64
#: Members of a block that one task compares with as many others; larger blocks are dealt into parts.
PART = 8192
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def shingle_hashes(texts: pa.StringArray, width: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each space-joined shingle, repeats included, end to end; shingles of each text)."""
    import xxhash

    words, codes, offsets = word_codes(texts, SPACED)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = words.take(pa.array(codes))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_py().encode()
    lengths = pc.binary_length(flat).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    counts = np.diff(offsets)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    # the first word of each shingle, and its last: width words on, or the text's last word
    before = np.cumsum(n) - n
    first = np.arange(n.sum()) - np.repeat(before, n) + np.repeat(offsets[:-1], n)
    last = np.minimum(first + width, np.repeat(offsets[1:], n)) - 1
    xxh = xxhash.xxh64_intdigest
    hashes = np.fromiter((xxh(joined[a:b], seed) for a, b in zip((ends[first] - lengths[first]).tolist(), ends[last].tolist())), np.uint64, len(first))
    return hashes, n


def fingerprints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint a text: a bit is 1 if it is set in over half of the text's hashes; none: 0."""
    votes = np.zeros((len(n), BITS), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = of[at : at + STEP]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _signed(texts: DataFrame, width: int) -> DataFrame:
    def sign(batches):
        for batch in batches:
            for start, part in pieces_of(plain_strings(batch.column("text")), 1 << 20):
                prints = fingerprints(*shingle_hashes(part, width))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(part)), pa.array(prints.view(np.int64))], names=["id", "fp"])
        release()

    return texts.mapInArrow(sign, "id long, fp long")


def masks(n_prints: int, most: int) -> list[int]:
    """Bit masks of which at least one is equal in two fingerprints that differ in at most ``most`` bits.

    64 bits are cut into k blocks, and a mask joins k - ``most`` of them: ``most`` differing bits touch ``most`` blocks, so all
    blocks of some mask are equal. k is the smallest for which ``n_prints`` evenly spread fingerprints leave one in a bucket.
    """
    k = most + 1
    while (BITS * (k - most)) // k < np.log2(max(n_prints, 2)) and comb(k + 1, most) <= 500:
        k += 1
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(BITS), k)]
    return [int(np.uint64(sum(chosen)).view(np.int64)) for chosen in combinations(blocks, k - most)]


def spanning(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (numbers of fingerprints) that join all those within ``most`` bits of each other, directly or through others, and no more than that takes.

    One fingerprint at a time is compared with all that are not reached yet.
    """
    out, rest = [], np.arange(len(prints))
    while len(rest):
        found, rest = [int(rest[0])], rest[1:]
        while found and len(rest):
            i = found.pop()
            near = np.bitwise_count(prints[rest] ^ prints[i]) <= most
            if near.any():
                new = rest[near].tolist()
                out += [(i, j) for j in new]
                found += new
                rest = rest[~near]
    return out


def _links(groups: DataFrame, most: int) -> DataFrame:
    """(a, b): links between the members (fp, rep) of each group."""

    def link(batches):
        for batch in batches:
            members = batch.column("members")
            offsets = members.offsets.to_numpy().astype(np.int64)
            flat = members.flatten()
            prints, reps = flat.field("fp").to_numpy().view(np.uint64), flat.field("rep").to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= most]
            a, b = [reps[two]], [reps[two + 1]]
            for at in np.flatnonzero(sizes > 2).tolist():
                found = np.array(spanning(prints[offsets[at] : offsets[at + 1]], most), np.int64).reshape(-1, 2) + offsets[at]
                a.append(reps[found[:, 0]])
                b.append(reps[found[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return groups.select("members").mapInArrow(link, "a long, b long")


def similar_links(classes: DataFrame, most: int, part: int = PART) -> DataFrame:
    """Links (a, b) that join the classes (rep, fp; distinct fingerprints) as all pairs within ``most`` bits would.

    Each class goes once to the bucket of each mask. A bucket of more than ``part`` members is dealt into parts, and each pair of parts is a
    group of its own, so that no task gathers more than twice ``part`` members. A group returns spanning links only.
    """
    chosen = masks(classes.count(), most)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in chosen])
    keyed = classes.select("rep", "fp", F.posexplode(keys).alias("mask", "block"))
    on = ["mask", "block"]
    sized = written(keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    dealt = hot_join(keyed, sized.select(*on, F.ceil(F.col("n") / part).cast("int").alias("parts")), on, hot_keys(sized))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # a bucket in one part is one group; else each part meets each other part
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    placed = dealt.withColumn("own", own).select(*on, "own", "rep", "fp", F.explode(others).alias("other"))
    groups = placed.groupBy(*on, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
    return written(_links(groups.where(F.size("members") > 1), most).distinct())


def simhash_components(docs: DataFrame, *, width: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Link documents whose fingerprints differ in at most ``most`` bits.

    A fingerprint takes the XXH64 (seed 42) of all ``width``-word shingles, repeats included (white space between words, A-Z in lower case; a text
    of fewer words has its whole sequence). Texts without words and null texts have fingerprint zero, which links like any other.
    Equal fingerprints are one class, named by its smallest id; only classes are compared. Rows that share an id are one document.
    A null id links with nothing: its component_id is null. Ids are whole numbers. Other columns are not read.

    Returns id_col, fingerprint (16 lower-case hex digits) and component_id (smallest id reachable), one row for each row.
    """
    signed = written(_signed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), width))
    usable = signed.where("id IS NOT NULL")
    classes = written(usable.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    repeated = written(usable.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id"))
    hot = hot_keys(classes.select("fp", "n"))
    # an id with several texts joins their classes
    same_id = hot_join(usable.join(repeated, "id", "left_semi"), classes.select("fp", "rep"), ["fp"], hot).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    names = classes.select("fp", "rep")
    final = written(components(similar_links(names, most, part).union(same_id)))
    named = names.join(final, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    rows = hot_join(usable, written(named), ["fp"], hot).unionByName(signed.where("id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
