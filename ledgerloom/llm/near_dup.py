"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import kept, plain_strings, release, written
from ledgerloom.llm.words import SPACED, pieces_of, word_codes

_K = np.uint64(0x9E3779B97F4A7C15)
#: Ids that are sent to all executors at most; more are joined by a shuffle.
SENT_IDS = 500_000
#: Weight (shingles, and 1024 a set) of the part of a group whose sets are verified together, on average.
PART = 1 << 20
#: The same for members that are compared with each other, or with another part.
BLOCK = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.StringArray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of each text, end to end; offsets).

    A shingle is ``width`` consecutive words (white space between, A-Z in lower case); a text of fewer words, but
    not none, has its whole sequence as its only shingle.
    """
    import xxhash

    words, codes, offsets = word_codes(texts, SPACED)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes]
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _K + hashes[k : k + len(rolled)]
    rolled = _mix(rolled)
    out, sizes = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = short * _K + h
            out.append(_mix(np.array([short])))
        else:
            continue
        sizes[i] = len(out[-1])
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def min_hashes(sets: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """One row of ``n`` 32-bit minima for each non-empty set."""
    factors = np.random.default_rng(20_11).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), n), np.uint32)
    if len(starts):
        for k, factor in enumerate(factors):
            out[:, k] = np.minimum.reduceat((sets * factor) >> np.uint64(32), starts)
    return out


def least_matches(threshold: float, n: int, step: int, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that go on): below, the posterior chance of a similarity of
    ``threshold`` or more, under a uniform prior, is under ``miss``."""
    out = []
    for seen in range(step, n + 1, step):
        tail, m = 0.0, 0
        while m <= seen:
            tail += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((seen, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, schedule: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs of signature rows that no batch of hashes prunes."""
    alive, matches, last = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for seen, fewest in schedule:
        matches = matches + (left[alive, last:seen] == right[alive, last:seen]).sum(axis=1)
        go = matches >= fewest
        alive, matches, last = alive[go], matches[go], seen
    return alive


def _signed(docs: DataFrame, width: int, n: int) -> DataFrame:
    """id, n_shingles, a 128-bit hash of the set (s1, s2) and the signature of every row."""

    def sign(batches):
        import xxhash

        for batch in batches:
            for start, part in pieces_of(plain_strings(batch.column("text")), 1 << 20):
                sets, offsets = shingle_sets(part, width)
                sizes = np.diff(offsets)
                filled = sizes > 0
                key = np.zeros((len(part), 2), np.int64)
                signature: list = [None] * len(part)
                rows = min_hashes(sets, offsets, n)
                for k, i in enumerate(np.flatnonzero(filled).tolist()):
                    key[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[offsets[i] : offsets[i + 1]].tobytes()), np.int64)
                    signature[i] = rows[k].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(part)), pa.array(sizes), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(signature, pa.binary())], names=["id", "n", "s1", "s2", "signature"])
        release()

    return docs.mapInArrow(sign, "id long, n long, s1 long, s2 long, signature binary")


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One row of bucket numbers for each row of signatures."""
    bands = signatures.shape[1] // rows
    key = np.zeros((len(signatures), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * _K + signatures[:, k::rows][:, :bands].astype(np.uint64))
    return key.view(np.int64)


def _buckets(classes: DataFrame, rows: int) -> DataFrame:
    """(bucket, rep): one row for each band of each class."""

    def band(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key = band_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, -1), rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(batch.column("rep").to_numpy(), key.shape[1]))], names=["bucket", "rep"])

    return classes.select("rep", "signature").mapInArrow(band, "bucket long, rep long")


def _prune(a: Column, b: Column, schedule) -> Column:
    def go(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            keep = np.zeros(len(x), bool)
            if len(x):
                left, right = (np.frombuffer(b"".join(z.to_pylist()), np.uint32).reshape(len(x), -1) for z in (x, y))
                keep[surviving(left, right, schedule)] = True
            yield pa.array(keep)

    return F.arrow_udf(go, "boolean")(a, b)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for start, part in pieces_of(plain_strings(batch.column("text")), 1 << 20):
                sets, offsets = shingle_sets(part, width)
                body = [sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(part)), pa.array(body, pa.binary())], names=["id", "shingles"])

    # a row that repeats an id and its text gives one set
    return texts.mapInArrow(make, "id long, shingles binary").groupBy("id", F.xxhash64("shingles").alias("of")).agg(F.first("shingles").alias("shingles")).drop("of")


def similar(a: np.ndarray, b: np.ndarray, codes: np.ndarray, offsets: np.ndarray, percent: int, most: int = 1 << 22) -> np.ndarray:
    """Whether 100 * intersection >= ``percent`` * union for each pair of set numbers.

    ``codes`` holds all sets end to end as small numbers. One set is marked at a time and its partners are counted
    against the marks, ``most`` codes at a time.
    """
    order = np.lexsort((b, a))
    a, b, sizes = a[order], b[order], np.diff(offsets)
    marks, common = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool), np.zeros(len(a), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else ()
    for head, end in zip(heads, [*heads[1:], len(a)]):
        own = codes[offsets[a[head]] : offsets[a[head] + 1]]
        marks[own] = True
        ends = np.cumsum(sizes[b[head:end]])
        at = head
        while at < end:
            done = ends[at - head - 1] if at > head else 0
            stop = min(end, max(at + 1, head + int(np.searchsorted(ends, done + most, side="right"))))
            each = sizes[b[at:stop]]
            begins = np.cumsum(each) - each
            place = np.arange(each.sum()) + np.repeat(offsets[b[at:stop]] - begins, each)
            common[at:stop] = np.add.reduceat(marks[codes[place]], begins, dtype=np.int64)
            at = stop
        marks[own] = False
    out = np.zeros(len(a), bool)
    out[order] = 100 * common >= percent * (sizes[a] + sizes[b] - common)
    return out


def _sets_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the ids in ``wanted``; other texts are not read into sets."""
    wanted = kept(wanted.select("id").distinct())
    few = wanted.count() <= SENT_IDS
    return kept(_sets(texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), width))


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (unit, a, b) whose full shingle sets are similar enough.

    Only texts in a pair are read into sets, and a set moves once to each unit that needs it, not once a pair.
    """
    pairs = written(pairs)
    needs = written(pairs.select("unit", F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = _sets_of(texts, needs, width)

    def check(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        # an id with more than one text has more than one set here; a pair of texts that are alike links their ids
        ids, body = theirs.column("id").to_numpy(), theirs.column("shingles").to_pylist()
        sizes = np.fromiter((len(x) // 8 for x in body), np.int64, len(body))
        codes = np.unique(np.frombuffer(b"".join(body), np.uint64), return_inverse=True)[1]
        by = np.argsort(ids, kind="stable")
        a, b = ours.column("a").to_numpy(), ours.column("b").to_numpy()
        first, last = ([np.searchsorted(ids, x, side=side, sorter=by) for x in (a, b)] for side in ("left", "right"))
        n_a, n_b = last[0] - first[0], last[1] - first[1]
        each = n_a * n_b
        pair = np.repeat(np.arange(len(a)), each)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, y = by[first[0][pair] + nth // np.maximum(n_b[pair], 1)], by[first[1][pair] + nth % np.maximum(n_b[pair], 1)]
        good = np.unique(pair[similar(x, y, codes, np.concatenate([[0], np.cumsum(sizes)]), percent)]) if len(pair) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a[good], pa.int64()), "b": pa.array(b[good], pa.int64())})

    moved = needs.join(sets.where(F.length("shingles") > 0), "id").select(F.col("unit").alias("for_unit"), "id", "shingles")
    return written(pairs.groupBy("unit").cogroup(moved.groupBy("for_unit")).applyInArrow(check, "a long, b long"))


def near_duplicates(docs: DataFrame, *, percent: int = 85, width: int = 5, rows: int = 5, bands: int = 24, miss: float = 1e-6, step: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of ``width``-word shingles have 100 * intersection >= ``percent`` * union.

    Documents with equal sets form a class, named by its smallest id, and only the class goes on.
    Signatures of ``rows * bands`` minima are cut into bands; classes that share a band are
    candidates (a pair at 0.85 shares none of 24 bands of 5 with chance 8e-7). The smallest member of a bucket leads it.
    Each class is compared with the smallest of its leaders; then with its other leaders, where components
    still differ; then members of one smallest leader that still lie in different components are compared with each other, and last
    members of one bucket with different smallest leaders. So every candidate pair is either compared or already linked through
    others; the last two steps compare and verify part by part of a group and return links, so no group is listed pair by pair.
    Comparing means: batches of ``step`` hashes, dropping a pair once the posterior chance that it reaches the
    threshold is under ``miss``; survivors are verified on their full sets.

    Returns id_col, n_shingles, component_id (smallest id reachable) and kept (id_col = component_id) for every
    row. Texts without words have an empty set and link with nothing. Rows that share an id
    are one document. A null id links with nothing: component_id null, kept true. Ids are whole numbers. Other columns are not read.
    """
    schedule = least_matches(percent / 100, rows * bands, step, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = kept(_signed(texts, width, rows * bands))
    usable = signed.where("n > 0 AND id IS NOT NULL")
    classes = kept(usable.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    buckets = _buckets(classes, rows)
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("members")).where("lead < last").drop("last")
    members = kept(buckets.join(kept(shared), "bucket"))
    stars = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    first = kept(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    # where a class is verified: with others of its smallest leader, in parts of bounded weight
    grouped = classes.groupBy("rep").agg(F.sum("n").alias("n")).join(first.withColumnRenamed("b", "rep"), "rep", "left").select("rep", "n", F.coalesce("a", "rep").alias("lead"))
    parts = grouped.groupBy("lead").agg(F.ceil(F.sum(F.col("n") + 1024) / PART).alias("parts"))
    home = grouped.join(parts, "lead").select("rep", F.xxhash64("lead", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("home"))
    signature = kept(classes.select("rep", "n", "signature").join(home, "rep"))

    def side(name: str) -> DataFrame:
        return signature.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"sig_{name}"), F.col("home").alias(f"home_{name}"))

    alike_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")

    def alike(pairs: DataFrame) -> DataFrame:
        signed_pairs = pairs.join(side("b"), "b").join(side("a"), "a").where(alike_size)
        alive = signed_pairs.where(_prune(F.col("sig_a"), F.col("sig_b"), schedule))
        return _links(alive.select(_unit("home_a", "home_b"), "a", "b"), texts, width, percent)

    def placed_by(links: DataFrame, rows_: DataFrame, node: str, name: str) -> DataFrame:
        known = links.select(F.col("node").alias(node), F.col("component").alias(name))
        return rows_.join(known, node, "left").withColumn(name, F.coalesce(name, node))

    # an id with more than one text joins their classes
    repeated = usable.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("id")
    same_id = usable.select("id", "s1", "s2").join(kept(repeated), "id", "left_semi").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # one pair a class: with the smallest of its leaders, which in a group of copies is the same for nearly all
    known = _joined(None, alike(first).union(same_id))
    # then the other leaders, of which that has not made the components one
    apart = placed_by(known, placed_by(known, stars.distinct(), "a", "of_a"), "b", "of_b").where("of_a <> of_b").select("a", "b")
    apart = written(apart.join(first, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        known = _joined(known, alike(apart))
    # then the members of one smallest leader that lie in different components still
    groups = placed_by(known, grouped.select("rep", "lead"), "rep", "component")
    mixed = kept(groups.groupBy("lead").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("lead"))
    if not mixed.isEmpty():
        own = placed_by(known, groups.join(mixed, "lead", "left_semi"), "lead", "of_lead")
        own = own.select(F.col("lead").alias("group"), "rep", "component", (F.col("component") == F.col("of_lead")).alias("settled"), F.col("rep").alias("done"))
        known = _joined(known, _within(own, signature, texts, width, percent, schedule))
    # then members of one bucket with different smallest leaders
    placed = kept(placed_by(known, members.where("rep <> lead").select("bucket", "rep"), "rep", "component").join(grouped.select("rep", "lead"), "rep"))
    mixed = kept(placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("lead").alias("common"), F.max("lead").alias("z")).where("x < y AND common < z").select("bucket", "common"))
    if not mixed.isEmpty():
        rest = placed.join(mixed, "bucket").select(F.col("bucket").alias("group"), "rep", "component", (F.col("lead") == F.col("common")).alias("settled"), F.col("lead").alias("done"))
        known = _joined(known, _within(rest, signature, texts, width, percent, schedule, rows))
    final = known

    named = classes.select("s1", "s2", "rep").join(final, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    rows_ = signed.select("id", "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), F.when(F.col("n") > 0, F.col("s2")).alias("s2"))
    # a row without words has no class; its null key is spread over the tasks of an outer join
    out = rows_.join(kept(named), ["s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) of those known so far and more links. A component known stands for all links inside it, and where no link joins two, nothing is done."""
    links = written(links)
    if known is not None:
        if links.isEmpty():
            return known
        links = links.union(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return written(components(links))


def _unit(a: str, b: str) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b)).alias("unit")


def _within(members: DataFrame, signature: DataFrame, texts: DataFrame, width: int, percent: int, schedule, rows: int | None = None) -> DataFrame:
    """Links (a, b) between similar members of one group that join different components, no more than make them one.

    ``members`` has group, rep, component, settled and done. Two settled members and two with one ``done`` have been compared
    before. A group's settled and other members are dealt into parts of bounded weight. Each pair of parts, of which
    one at least is not settled, is a task of its own: it prunes by batches of hashes, verifies what is left on the full sets and
    returns links only, so no pair leaves it. With ``rows`` the groups are buckets, and a pair that shares several is compared in the first.
    """
    members = written(members)
    sets = _sets_of(texts, members.select(F.col("rep").alias("id")), width).withColumnRenamed("id", "rep")
    light = members.join(signature.select("rep", (F.col("n") + 1024).alias("weight")), "rep")
    weight = lambda which: F.coalesce(F.ceil(F.sum(F.when(which, F.col("weight"))) / BLOCK), F.lit(0)).cast("int")
    sized = light.groupBy("group").agg(weight(~F.col("settled")).alias("n_open"), weight(F.col("settled")).alias("n_rest")).where("n_open > 0 AND n_open + n_rest > 0")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = members.join(sized, "group").withColumn("part", F.when(F.col("settled"), F.col("n_open") + part("n_rest")).otherwise(part("n_open")))
    full = dealt.join(signature.select("rep", "n", "signature"), "rep").join(sets.where(F.length("shingles") > 0), "rep")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("settled"), F.col("n_open")).otherwise(F.col("n_open") + F.col("n_rest")) - 1)).alias("other")
    placed = full.select("group", "part", other, "rep", "component", "settled", "done", "signature", "shingles")
    units = placed.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")

    def check(table: pa.Table) -> pa.Table:
        read = lambda name: table.column(name).to_numpy(zero_copy_only=False)
        rep, part, done, settled = read("rep"), read("part"), read("done"), read("settled")
        body = table.column("shingles").to_pylist()
        sizes = np.fromiter((len(x) // 8 for x in body), np.int64, len(body))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.unique(np.frombuffer(b"".join(body), np.uint64), return_inverse=True)[1]
        del body
        signed = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
        of = np.unique(read("component"), return_inverse=True)[1]
        low, high, group = (table.column(c)[0].as_py() for c in ("low", "high", "group"))
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        keys = band_keys(signed, rows) if rows else None
        band = int(np.argmax((keys == group).any(axis=0))) if rows else 0
        out = []
        for k, i in enumerate(left.tolist()):
            j = right[k + 1 :] if low == high else right
            j = j[(of[j] != of[i]) & (done[j] != done[i]) & ~(settled[j] & settled[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
            if band and len(j):
                j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
            if len(j):
                j = j[surviving(np.broadcast_to(signed[i], (len(j), signed.shape[1])), signed[j], schedule)]
            if len(j):
                j = j[similar(np.full(len(j), i), j, codes, offsets, percent)]
            for x in j[np.unique(of[j], return_index=True)[1]].tolist():
                out.append((rep[i], rep[x]))
                of[of == of[x]] = of[i]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.groupBy("group", "low", "high").applyInArrow(check, "a long, b long")
