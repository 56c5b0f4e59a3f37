"""Benchmark decontamination with an FM-index over each shard of training text.

A shard is a run of whole documents that one task holds. Its words become symbols; the index is a
suffix order, the symbols before the suffixes as a wavelet matrix, and sampled suffix places. All
benchmark windows are searched backwards in it at once, word by word from their ends, and what is
found is located and merged into spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import plain_strings, release, written
from ledgerloom.llm.words import ALPHANUMERIC, pieces_of, word_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Bytes of benchmark text that are searched for together; a larger benchmark goes in as many blocks as it needs.
BLOCK_BYTES = 2 << 20
#: Blocks that one scan searches at most.
BLOCKS_A_SCAN = 8
#: Bytes of training text in one index.
SHARD_BYTES = 8 << 20


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class FMIndex:
    """Words are symbols of 1 and more; 0 ends a stretch of words and is part of no phrase."""

    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 16):
        n = len(symbols)
        order = self._suffixes(symbols, largest)
        last = symbols[order - 1]  # the symbol before each suffix; before the first: the final 0
        self.n, self.bits = n, max(1, int(largest).bit_length())
        self.levels, rest = [], last
        for level in range(self.bits - 1, -1, -1):
            bit = (rest >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((level, ones, n - int(ones[-1])))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        self.origin = self._descend(np.arange(largest + 1), np.zeros(largest + 1, np.int64))
        keep = (order % sample == 0) | (last == 0)  # no walk crosses the start of a stretch
        self.marks = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.places = order[keep]

    @staticmethod
    def _suffixes(symbols: np.ndarray, largest: int) -> np.ndarray:
        """Suffix order by doubling. Every 0 counts as a sign of its own, so no comparison runs past it."""
        n = len(symbols)
        ends = symbols == 0
        rank = symbols.astype(np.int64) + n
        rank[ends] = np.arange(np.count_nonzero(ends))
        ahead = 0
        while True:
            after = np.zeros(n, np.int64)
            if ahead:
                after[: n - ahead] = rank[ahead:] + 1
            key = rank * (n + largest + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                return order
            ahead = max(1, 2 * ahead)

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            up = ones[place]
            place = np.where((symbol >> level) & 1 == 1, zeros + up, place - up)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the given places."""
        return self._descend(symbol, place) - self.origin[symbol]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long phrases: (numbers of those found, their first and last suffix + 1)."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for at in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, at]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: step back until a sampled one."""
        place, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            mark = self.marks[rows]
            known = self.marks[rows + 1] > mark
            place[open_[known]] = self.places[mark[known]] + steps
            open_, rows = open_[~known], rows[~known]
            symbol, at = np.zeros(len(rows), np.int64), rows
            for level, ones, zeros in self.levels:
                up = ones[at]
                one = ones[at + 1] > up
                symbol |= one.astype(np.int64) << level
                at = np.where(one, zeros + up, at - up)
            rows = self.first[symbol] + at - self.origin[symbol]
            steps += 1
        return place


class Phrases:
    """The windows of a block of benchmark items: ``window`` words each, or a shorter item as a whole."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        by_words: dict[tuple[str, ...], list[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            words = item_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                by_words.setdefault(tuple(words[i : i + window]), []).append(number[name])
        vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in by_words for w in p}))}
        self.vocabulary = pa.array(list(vocabulary), pa.string())
        self.shortest = min(map(len, by_words), default=0)
        self.by_length = []
        for n in sorted({len(p) for p in by_words}):
            own = [(p, sorted(set(of))) for p, of in by_words.items() if len(p) == n]
            self.by_length.append((n, np.array([[vocabulary[w] for w in p] for p, _ in own], np.int64), np.cumsum([0, *(len(of) for _, of in own)]), np.array([i for _, of in own for i in of], np.int64)))

    def find(self, texts: pa.StringArray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """For each text: its number of words, its merged word spans inside windows, the items whose windows occur."""
        words, codes, offsets = word_codes(texts, ALPHANUMERIC)
        n_docs, n_words = len(texts), np.diff(offsets)
        spans: list = [[] for _ in range(n_docs)]
        items: list = [[] for _ in range(n_docs)]
        if not self.by_length or not len(codes):
            return n_words, spans, items
        known = pc.index_in(words, value_set=self.vocabulary)
        symbol_of = pc.add(pc.fill_null(known, -1), 1).to_numpy(zero_copy_only=False)
        symbols = symbol_of[codes]
        # stretches of benchmark words; one shorter than every window can hold none
        edge = np.zeros(len(codes) + 1, bool)
        edge[offsets] = True
        inside = symbols > 0
        begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return n_words, spans, items
        sizes = ends - begins + 1  # with the 0 behind each
        total = np.cumsum(sizes)
        place = np.arange(total[-1]) + np.repeat(begins - (total - sizes), sizes)
        shard = symbols[np.minimum(place, len(symbols) - 1)].astype(np.int64)
        shard[total - 1] = 0
        index = FMIndex(shard, len(self.vocabulary))
        starts, lengths, doc_item = [], [], []
        for n, phrases, cut, of in self.by_length:
            alive, low, high = index.ranges(phrases)
            if not len(alive):
                continue
            times = high - low
            which = np.repeat(alive, times)
            ahead = np.cumsum(times) - times
            rows = np.arange(times.sum()) - np.repeat(ahead, times) + np.repeat(low, times)
            at = place[index.locate(rows)]
            starts.append(at)
            lengths.append(np.full(len(at), n))
            docs = np.searchsorted(offsets, at, side="right") - 1
            pairs = np.unique(docs * len(phrases) + which)  # a window counts once a document
            docs, which = pairs // len(phrases), pairs % len(phrases)
            many = cut[which + 1] - cut[which]
            more = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[which], many)
            doc_item.append(np.repeat(docs, many) * len(self.names) + of[more])
        if not starts:
            return n_words, spans, items
        for pair in np.unique(np.concatenate(doc_item)).tolist():  # names are sorted as strings
            items[pair // len(self.names)].append(self.names[pair % len(self.names)])
        at, n = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(at, kind="stable")
        at, stop = at[order], (at + n)[order]
        reach = np.maximum.accumulate(stop)
        doc = np.searchsorted(offsets, at, side="right") - 1
        new = np.concatenate([[True], (at[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(at)]]) - 1
        for d, a, b in zip(doc[head].tolist(), at[head].tolist(), reach[tail].tolist()):
            spans[d].append((a - int(offsets[d]), b - int(offsets[d])))
        return n_words, spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FOUND = "struct<n_words: bigint, spans: array<struct<start: bigint, stop: bigint>>, items: array<string>>"


def _found(n_words, spans, items) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])


def blocks_of(benchmark: DataFrame, window: int, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark's windows in blocks of about ``block_bytes``, however large it is."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        yield Phrases([(r["name"], r["text"]) for r in part.collect()], window)


def with_occurrences(rows: DataFrame, benchmark: DataFrame, text: Column, *, window: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, blocks_a_scan: int = BLOCKS_A_SCAN) -> DataFrame:
    """The rows with a struct column ``found``: n_words, merged spans of hit words (start, stop) and sorted items of ``text``.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z in lower case.
    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. Items with a null id or text have no windows; rows that repeat an item id add theirs to it. A null text has
    no words. Each task indexes whole documents, so nothing is shuffled. A scan searches ``blocks_a_scan`` blocks of the
    benchmark at most, which bounds what is broadcast; a larger benchmark takes further scans over the rows,
    written with what has been found by then, and the blocks of a scan are released after it.
    """
    spark = rows.sparkSession
    blocks, sent, scans = blocks_of(benchmark, window, id_col=item_col, text_col=item_text_col, block_bytes=block_bytes), [], 0
    while own := list(islice(blocks, blocks_a_scan)):
        if scans:
            rows = written(rows)
            for old in sent:
                old.destroy()
        sent = [spark.sparkContext.broadcast(b) for b in own]
        rows = rows.withColumn("found", _finder(sent)(text, F.col("found") if scans else F.lit(None).cast(_FOUND)))
        scans += 1
    return rows


def _finder(sent: list):
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in batches:
            out = [_found([], [], [])]
            for at, part in pieces_of(plain_strings(texts), SHARD_BYTES):
                found = [b.value.find(part) for b in sent]
                n_words, spans, items = found[0]
                earlier = before.slice(at, len(part))
                if earlier.null_count < len(earlier):
                    known = earlier.to_pylist()
                    found.append((n_words, [[(s["start"], s["stop"]) for s in k["spans"]] for k in known], [k["items"] for k in known]))
                for _, more, other in found[1:]:
                    spans = [merged(a, b) for a, b in zip(spans, more)]
                    items = [sorted({*a, *b}) for a, b in zip(items, other)]
                out.append(_found(n_words, spans, items))
            yield pa.concat_arrays(out)
        release()

    return F.arrow_udf(find, _FOUND)


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; spans that touch become one."""
    out: list[list[int]] = []
    for start, stop in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(x, y) for x, y in out]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items (sorted as strings), spans, contaminated. Other columns are not read."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    found = with_occurrences(rows, benchmark, F.col("_text"), window=window, **more).select(id_col, "found.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of each span and what stands between them; a line feed marks each cut."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, where in batches:
            out = []
            for text, own in zip(texts.to_pylist(), where.to_pylist()):
                if not text or not own:
                    out.append(text)
                    continue
                places, kept, last = [m.span() for m in WORD.finditer(text.translate(_LOWER))], [], 0
                for span in own:
                    kept.append(text[last : places[span["start"]][0]])
                    last = places[span["stop"] - 1][1]
                out.append("\n".join([*kept, text[last:]]))
            yield pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(text, spans)
