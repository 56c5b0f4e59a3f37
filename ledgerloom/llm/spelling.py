"""Spelling variants: words one edit apart, found by walking a trie with states (word, position, node, edits), level by level."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import hot_join, hot_keys, plain_strings, release, unsent, written
from ledgerloom.llm.words import SPACED, pieces_of, word_codes

_SAME = np.arange(256, dtype=np.uint8)
_LETTER = np.isin(_SAME, [*range(65, 91), *range(97, 123)])
_LEAD = 0xC3  # the first byte of all of U+00C0 to U+00FF, and of nothing else
_END = -1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def letter_runs(texts: pa.StringArray) -> pa.StringArray:
    """The texts with A-Z in lower case and all but A-Z, a-z and U+00C0 to U+00FF replaced by spaces, byte by byte."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    lead = body == _LEAD
    letter = _LETTER[body] | lead
    letter[1:] |= lead[:-1]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(np.where(letter, SPACED[body], np.uint8(32))))


def counted_words(ids: list, texts: pa.StringArray, every: int, least_chars: int) -> tuple[list[str], list[int]]:
    """The distinct words of some documents and their counts, a letter deleted where ``every`` divides the checksum of id and run."""
    words, codes, offsets = word_codes(letter_runs(texts), _SAME)
    if not len(codes):
        return [], []
    pair = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets)) * len(words) + codes
    pair, n = np.unique(pair, return_counts=True)
    doc, code = pair // len(words), pair % len(words)
    raw, crc = [w.encode() for w in words.to_pylist()], zlib.crc32
    begun = [crc(f"{'' if i is None else i}:".encode()) for i in ids]
    checks = np.fromiter((crc(raw[c], begun[d]) for c, d in zip(code.tolist(), doc.tolist())), np.int64, len(pair))
    cut = checks % every == 0
    whole = np.bincount(code[~cut], n[~cut], len(words)).astype(np.int64)
    wide = (pc.utf8_length(words).to_numpy() >= least_chars) & (whole > 0)
    out, counts = words.filter(pa.array(wide)).to_pylist(), whole[wide].tolist()
    for c, h, k in zip(code[cut].tolist(), checks[cut].tolist(), n[cut].tolist()):
        run = raw[c].decode()
        at = h % len(run)
        if len(run) > least_chars:
            out.append(run[:at] + run[at + 1 :])
            counts.append(k)
    return out, counts


def word_table(docs: DataFrame, *, least_chars: int, least_count: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(id, word, n): each piece of a partition sends one row a distinct word, so the shuffle grows with words and not with text."""

    def count(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for start, part in pieces_of(plain_strings(batch.column("text"))):
                words, n = counted_words(ids[start : start + len(part)], part, every, least_chars)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
        release()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    counted = rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return written(counted.withColumn("id", F.monotonically_increasing_id()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def prefix_rows(words: list[str], least: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, depth, node, next code point or -1 at the end) of each prefix of ``least`` letters or more.

    A node is a 64-bit hash of a prefix and its side: a running sum over mixed letters and places, so that all prefixes take one pass.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    running = np.cumsum(_mixed(_mixed(letters * _A + place.astype(np.uint64) * _B) + np.uint64(side + 1)))
    before = np.where(starts > 0, running[starts - 1], np.uint64(0))
    number = np.repeat(np.arange(len(words)), sizes)
    node = _mixed(running - before[number] + (place + 1).astype(np.uint64) * _A).view(np.int64)
    after = np.append(letters[1:], 0).astype(np.int64)
    after[starts + sizes - 1] = _END
    deep = place + 1 >= least
    return number[deep], place[deep] + 1, node[deep], after[deep]


def _prefixes(words: DataFrame, least: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for start, part in pieces_of(plain_strings(batch.column("word")), 1 << 18):
                ids, forms = batch.column("id").slice(start, len(part)), part.to_pylist()
                for side in (0, 1):
                    number, depth, node, after = prefix_rows([w[::-1] for w in forms] if side else forms, least, side)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(number)), pa.array(np.full(len(number), side, np.int32)), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(after.astype(np.int32))], names=["id", "side", "depth", "node", "after"])

    return words.select("id", "word").mapInArrow(make, "id long, side int, depth int, node long, after int")


def _tail(text: Column, at: Column) -> Column:
    """What follows the first ``at`` letters."""
    return F.substring(text, at + 1, F.length(text))


def near_words(words: DataFrame, least_chars: int) -> DataFrame:
    """Pairs (a, b) of ids of words that differ by exactly one letter inserted, deleted or replaced, both ways round.

    Two tries hold all words, one forwards and one backwards. A node is kept where paths part or a word ends, and an edge carries the letters
    up to the next kept node. Two words one edit apart share the first half of the shorter one, or its last half, so the walk of a word
    starts in each trie behind half of its letters: at each kept node from there on, its state (word, position, node, 0 edits) takes
    the other edges with one letter replaced or inserted, which gives states of one edit. These follow the one edge that
    equals their next letters, level by level, until none is left; those that end with the word at an end of another are neighbours.
    Rounds follow the number of partings on a path, not its letters. Pairs are checked at last, as nodes are hashes.
    """
    least = least_chars // 2
    prefixes = _prefixes(words, least)
    nodes = written(prefixes.groupBy("node").agg(F.min("after").alias("low"), F.max("after").alias("high"), F.max(F.when(F.col("after") == _END, F.col("id"))).alias("ends"), F.count(F.lit(1)).alias("n")).where(f"low <> high OR low = {_END}"))
    hot = hot_keys(nodes.select("node", "n"))
    steps = hot_join(prefixes.select("id", "side", "depth", "node"), unsent(nodes.select("node", "ends")), ["node"], hot)
    paths = steps.groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "ends"))).alias("path"))  # at most a step a letter
    forms = words.select("id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("form")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("form")))).alias("f")).select("id", "f.*")
    walks = written(forms.join(unsent(paths), ["id", "side"]))

    pair = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("top"), F.slice("path", 2, F.size("path")).alias("end"))).alias("e")
    parted = walks.where(F.size("path") > 1).select("form", pair)
    label = F.substring("form", F.col("e.top.depth") + 1, F.col("e.end.depth") - F.col("e.top.depth"))
    edges = parted.select(F.col("e.top.node").alias("node"), F.col("e.end.node").alias("child"), label.alias("label"), F.col("e.end.ends").alias("ends"))
    edges = written(edges.groupBy("node", "child").agg(F.first("label").alias("label"), F.first("ends").alias("ends")).withColumn("letter", F.substring("label", 1, 1)))

    half = F.when(F.col("side") == 0, F.floor(F.length("form") / 2)).otherwise(F.ceil(F.length("form") / 2))
    unedited = walks.select("id", "form", F.explode(F.filter("path", lambda p: p["depth"] >= half)).alias("p")).select("id", "form", F.col("p.depth").alias("pos"), F.col("p.node").alias("node"))
    rest, more = _tail(F.col("form"), F.col("pos")), _tail(F.col("label"), F.lit(1))
    replaced = F.when((F.length("label") <= F.length(rest)) & _tail(rest, F.lit(1)).startswith(more), F.col("pos") + F.length("label"))
    inserted = F.when((F.length("label") <= F.length(rest) + 1) & rest.startswith(more), F.col("pos") + F.length("label") - 1)
    left = hot_join(unedited, unsent(edges), ["node"], hot).where(F.substring(rest, 1, 1) != F.col("letter"))
    states = left.select("id", "form", F.explode(F.array_compact(F.array(replaced, inserted))).alias("pos"), F.col("child").alias("node"), "ends")
    open_ = F.col("pos") < F.length("form")
    found = []
    while True:
        states = written(states)
        found.append(states.where(~open_ & F.col("ends").isNotNull()).select(F.col("id").alias("a"), F.col("ends").alias("b")))
        going = states.where(open_).select("id", "form", "pos", "node", F.substring("form", F.col("pos") + 1, F.lit(1)).alias("letter"))
        if going.isEmpty():
            break
        on = ["node", "letter"]
        last = hot_join(going, unsent(edges), on, hot_keys(going.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))))
        states = last.where(_tail(F.col("form"), F.col("pos")).startswith(F.col("label"))).select("id", "form", (F.col("pos") + F.length("label")).alias("pos"), F.col("child").alias("node"), "ends")
    pairs = found[0]
    for more_pairs in found[1:]:
        pairs = pairs.union(more_pairs)
    pairs = pairs.union(pairs.select("b", "a")).distinct()
    ours = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    theirs = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    named = pairs.join(unsent(ours), "a").join(unsent(theirs), "b")
    return named.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b", "word_b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) by doubling: the count of a form is a multiple of its word's, so chains are short and have no rings."""
    links = written(forms)
    while True:
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        longer = written(links.join(unsent(ahead), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = longer.select("id", "root")
        if longer.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, *, least_chars: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group words with the frequent words that they may be misspellings of.

    Words are the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower case) of all texts. Where ``every`` divides the unsigned
    CRC-32 h of ``<id>:<run>``, the run's letter h % length is deleted first. Words of fewer than ``least_chars`` letters or
    ``least_count`` occurrences are left out. Null texts have no words; a null id counts as an empty one; a repeated row counts again. Texts
    and words of any length are taken whole; an empty table gives no rows. Only the two columns are read.

    Returns word, n, n_near (words one edit apart), form (the near word of largest n, the smallest by code points on ties, if that is at
    least ``ratio`` times the word's own), form_n and root (where the forms lead in the end; the word itself if it has none).
    """
    words = word_table(docs, least_chars=least_chars, least_count=least_count, every=every, id_col=id_col, text_col=text_col)
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("word_b").alias("form"), F.col("b").alias("of"))).alias("best")
    near = near_words(words, least_chars).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = words.join(unsent(near), "id", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    judged = written(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_form"), c).alias(name) for c, name in ((F.col("best.form"), "form"), (-F.col("best.less"), "form_n"), (F.col("best.of"), "of"))]))
    roots = _roots(judged.where("of IS NOT NULL").select("id", F.col("of").alias("root")))
    last = roots.join(unsent(words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))), "root").select("id", "root_word")
    return judged.join(unsent(last), "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
