"""Secrets in text: fixed forms, and strings near sensitive words that a primed compressor finds new."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import plain_strings

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words after which a string may be a secret.
CONTEXT = re.compile(r"(?ai)passw|passphrase|pwd|secret|token|api.?key|credential|authorization|bearer|private.?key|access.?key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
#: Any of these, in lower case, is in every text that ASSIGN or CONTEXT can match.
_ANCHORS = ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "authorization", "bearer", "private", "access")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def _texts_with_hex(texts: pa.StringArray, least: int = 16) -> np.ndarray:
    """Whether each text holds a run of ``least`` hex digits (a run across two texts only adds a text to look at)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    found = np.zeros(len(texts), bool)
    if texts.buffers()[2] is None:
        return found
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    edge = np.diff(np.concatenate([[False], _IS_HEX[data], [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - begins >= least
    for b, e in zip(begins[long] + offsets[0], ends[long] + offsets[0] - 1):
        found[np.searchsorted(offsets, b, side="right") - 1 : np.searchsorted(offsets, e, side="right")] = True
    return found


class Novelty:
    """Marginal compressed bytes of a string, given the code around it and the identifiers of its text.

    An identifier counts for a string unless it stands nowhere but in that string and its repeats among the ``candidates``. A string's dictionary
    holds, for each of its positions in turn, the longest run that continues there in any identifier: a compressor needs no more of them. The
    runs are looked up in a sorted array of the identifiers' suffixes, so that work grows with the text and not with strings times identifiers.
    """

    #: Bytes of a suffix that are sorted, and the least run that goes into a dictionary.
    SORTED, RUN = 16, 4

    def __init__(self, text: str, candidates: list[str], around: int = 1024, block: int = 1 << 22):
        self.text, self.around = text, around
        count, repeats = Counter(_IDENTIFIER.findall(text)), Counter(candidates)
        self.strings = list(repeats)
        self.number = {own: i for i, own in enumerate(self.strings)}
        owner = {name: i for i, own in enumerate(self.strings) for name, n in Counter(_IDENTIFIER.findall(own)).items() if count[name] <= n * repeats[own]}
        names = sorted(count)
        self.best = [np.zeros(len(own), np.int64) for own in self.strings]
        self.place = [np.zeros(len(own), np.int64) for own in self.strings]
        self.names = (" ".join(names) + " ").encode()
        sizes = np.array([len(name) + 1 for name in names], np.int64)
        owners = np.repeat(np.array([owner.get(name, -1) for name in names], np.int32), sizes)
        for at in range(0, len(self.names), block):
            self._look_up(at, min(len(self.names), at + block), owners[at : at + block])

    def _suffixes(self, data: bytes, filler: bytes) -> np.ndarray:
        """The first bytes of every suffix, a row each."""
        return np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + filler * (self.SORTED - 1), np.uint8), self.SORTED)

    def _look_up(self, start: int, stop: int, owners: np.ndarray) -> None:
        """Set for each position of each string where its longest run begins, if these identifiers hold a longer one."""
        suffixes = self._suffixes(self.names[start : stop + self.SORTED - 1], b" ")[: stop - start]
        as_text = np.ascontiguousarray(suffixes).view(f"S{self.SORTED}").ravel()
        order = np.argsort(as_text, kind="stable")
        as_text, owners = as_text[order], owners[order]
        # a string's own identifiers stand in stretches, which are stepped over at once; what nobody owns is never stepped over
        new = np.concatenate([[True], owners[1:] != owners[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(owners)), 0))
        last = np.concatenate([np.flatnonzero(new)[1:], [len(owners)]])[np.cumsum(new) - 1]
        for i, own in enumerate(self.strings):
            wanted = self._suffixes(own.encode(), b"\0")
            found = np.searchsorted(as_text, np.ascontiguousarray(wanted).view(f"S{self.SORTED}").ravel())
            below, above = found - 1, found
            mine = (below >= 0) & (owners[below] == i)
            below = np.where(mine, first[below] - 1, below)
            mine = (above < len(owners)) & (owners[np.minimum(above, len(owners) - 1)] == i)
            above = np.where(mine, last[np.minimum(above, len(owners) - 1)], above)
            for side, there in ((below, below >= 0), (above, above < len(owners))):
                at = order[np.where(there, side, 0)]
                same = suffixes[at] == wanted
                run = np.where(there, np.where(same.all(1), self.SORTED, same.argmin(1)), 0)
                longer = run > self.best[i]
                self.best[i][longer] = run[longer]
                self.place[i][longer] = at[longer] + start

    def known_runs(self, own: str) -> list[bytes]:
        """Runs of the identifiers that make up as much of the string as they can, from its start on."""
        i, bytes_, out, at = self.number[own], own.encode(), [], 0
        best, place = self.best[i].tolist(), self.place[i].tolist()
        while at < len(bytes_):
            size, begin = best[at], place[at]
            if size < self.RUN:
                at += 1
                continue
            while at + size < len(bytes_) and self.names[begin + size] == bytes_[at + size]:
                size += 1
            out.append(self.names[begin : begin + size])
            at += size
        return out

    def share(self, start: int, stop: int) -> float:
        """Bytes that the string adds to what stands before it, over its length: about 0 for known text, about 0.8 and more for random characters."""
        import zstandard

        own = self.text[start:stop]
        before, after = self.text[max(0, start - self.around) : start], self.text[stop : stop + self.around]
        lead = before.encode()[-200:]
        prime = zstandard.ZstdCompressionDict(b" ".join([*self.known_runs(own), after.encode(), before.encode()]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_checksum=False)
        return (len(press.compress(lead + own.encode())) - len(press.compress(lead))) / len(own.encode())


def spans_of(text: str, *, least_share: float = 0.75, reach: int = 64) -> list[tuple[int, int, str]]:
    """(start, stop, kind) in code points, by start and then by kind; a check on each step is in the tests."""
    base = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    sensitive = [m.end() for m in CONTEXT.finditer(text)]
    if sensitive:
        ends, near = np.array(sensitive), []
        taken = sorted((s, e) for s, e, _ in base)
        begins, reached = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for m in CANDIDATE.finditer(text):
            at = np.searchsorted(ends, m.start(), side="right") - 1
            if at < 0 or m.start() - ends[at] > reach or "\n" in text[ends[at] : m.start()] or (n := bisect_left(begins, m.end())) and reached[n - 1] > m.start():
                continue
            near.append(m)
        novelty = Novelty(text, [m[0] for m in near]) if near else None
        base += [(m.start(), m.end(), "novel") for m in near if novelty.share(m.start(), m.end()) >= least_share]
    return sorted(base, key=lambda s: (s[0], KINDS.index(s[2])))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def secrets(text: Column, *, least_share: float = 0.75) -> Column:
    """An array of struct(start, stop, kind) for each whole text; null and empty texts have none.

    Kinds assign, access and hex are fixed forms, leftmost and non-overlapping within a kind; ``novel``
    is a string of 16 or more characters in the line and within 64 characters after a sensitive word,
    outside those forms, of which a zstandard compressor primed with the text's identifiers and the code around it
    needs ``least_share`` bytes a byte or more.
    """

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = plain_strings(batch)
            lower = pc.ascii_lower(texts)
            look = _texts_with_hex(texts) | pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
            for anchor in _ANCHORS:
                look |= pc.match_substring(lower, anchor).to_numpy(zero_copy_only=False)
            out: list = [[]] * len(texts)
            for i in np.flatnonzero(look).tolist():
                out[i] = [{"start": s, "stop": e, "kind": k} for s, e, k in spans_of(texts[i].as_py(), least_share=least_share)]
            yield pa.array(out, _SPANS)

    return F.arrow_udf(scan, "array<struct<start: bigint, stop: bigint, kind: string>>")(text)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id_col, spans) for every row; repeated rows each have their own. Other columns are not read."""
    return docs.select(F.col(id_col), secrets(F.col(text_col), **more).alias("spans"))
