"""Token ids of whole texts with the tokenizers library.

Words repeat, so each task encodes a distinct chunk of text once. Texts are cut only where the
tokenizer's own pre-tokenizer is certain to cut, so joined chunk ids equal the ids of the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.shared import plain_strings, release
from ledgerloom.llm.words import pieces_of

#: Chunks that a Python worker remembers, and their bytes; later ones are encoded again.
REMEMBERED, REMEMBERED_BYTES = 800_000, 32 << 20
#: Bytes of text that are cut and encoded at a time.
PIECE_BYTES = 6 << 20

_LETTER, _STOP, _SPACE, _LINE = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.zeros(256, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[[ord("."), ord(",")]] = _STOP
    kind[32], kind[10] = _SPACE, _LINE
    solid = np.zeros(256, bool)  # bytes that no white space holds
    solid[33:127] = True
    solid[0x80:] = True
    solid[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # these lead the non-ASCII white space
    return kind, solid


_KIND, _SOLID = _classes()


def _solid_before(data: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each byte is certainly no white space."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    # a two-byte character led by 0xC3-0xDF
    out[2:] |= (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    return out


def cut(texts: pa.StringArray, whole: np.ndarray | None = None) -> tuple[pa.StringArray, np.ndarray]:
    """(chunks of all texts in order, offsets of each text's chunks).

    Cuts lie before a single space, around a single line feed, and between an ASCII letter and a
    full stop or comma. Byte-level and word-level pre-tokenizers all end a token there. Texts that ``whole`` marks are one chunk.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    starts = np.zeros(len(data) + 1, bool)
    if len(data):
        after = np.zeros(len(data), bool)
        after[:-1] = _SOLID[data[1:]]
        alone = ((kind == _SPACE) | (kind == _LINE)) & after & _solid_before(data)
        starts[:-1] |= alone
        starts[1:] |= alone & (kind == _LINE)
        letter = np.zeros(len(data), bool)
        letter[1:] = kind[:-1] == _LETTER
        starts[:-1] |= (kind == _STOP) & letter
    for i in np.flatnonzero(whole).tolist() if whole is not None else ():
        starts[offsets[i] : offsets[i + 1]] = False
    starts[offsets] = True
    places = np.flatnonzero(starts).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.searchsorted(places, offsets)


class Encoder:
    """Encodes batches of texts; one lives in each Python worker."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text with an added token in it is never cut: what stands beside that token may belong to it
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(sorted(added, key=len, reverse=True))
        # what is remembered: chunks, and the ids of all of them end to end
        self.chunks = pa.array([], pa.string())
        self.ids, self.begins = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # chunks are encoded many at a time, apart from each other by a character that is a token of its own
        self.between, self.mark = self._separator()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _separator(self) -> tuple[str, int]:
        """A separator whose single id shows where one chunk ends, and that id."""
        for between in ("\n", " | "):
            alone, both = self._plain([between, f"ab{between}cd{between} ef"])
            parts = self._plain(["ab", "cd", " ef"])
            if len(alone) == 1 and both == parts[0] + alone + parts[1] + alone + parts[2]:
                return between, alone[0]
        return "", -1

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the chunks' places in the order in which they were encoded, sizes, ids end to end)."""
        shape = self.between.strip() or self.between
        order, sizes, ids, rest = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], []
        joined = []
        for i, c in enumerate(chunks):
            (joined if self.mark >= 0 and len(c) < 1000 and c.isprintable() and shape not in c and c[:2] != "  " and c[-1] != " " else rest).append(i)
        for at in range(0, len(joined), 2000):
            own = joined[at : at + 2000]
            got = np.array(self._plain([self.between.join([chunks[i] for i in own])])[0], np.uint32)
            marks = got == self.mark
            if np.count_nonzero(marks) != len(own) - 1:
                rest += own  # encoded one by one below
                continue
            order += own
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(marks), [len(got)]])) - 1)
            ids.append(got[~marks])
        for at in range(0, len(rest), 1000):
            got = self._plain([chunks[i] for i in rest[at : at + 1000]])
            order += rest[at : at + 1000]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids += [np.array(x, np.uint32) for x in got]
        return np.array(order, np.int64), np.concatenate(sizes), np.concatenate(ids)

    def encode(self, texts: pa.Array):
        """Yield (number of the first text, ids of a run of texts as one array, offsets of each text's ids)."""
        for first, part in pieces_of(plain_strings(texts), PIECE_BYTES):
            whole = pc.match_substring_regex(part, self.added, ignore_case=True).to_numpy(zero_copy_only=False) if self.added else None
            chunks, offsets = cut(part, whole)
            coded = chunks.dictionary_encode()
            words = coded.dictionary
            known = pc.fill_null(pc.index_in(words, value_set=self.chunks), -1).to_numpy().astype(np.int64)
            new = np.flatnonzero(known < 0)
            order, sizes, ids = self._encode(words.take(pa.array(new)).to_pylist())
            held = len(self.chunks)
            known[new[order]] = held + np.arange(len(new))
            flat, begins = np.concatenate([self.ids, ids]), np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            if held < REMEMBERED and self.chunks.nbytes < REMEMBERED_BYTES and len(new):
                self.chunks = pa.concat_arrays([self.chunks, words.take(pa.array(new[order][: REMEMBERED - held]))])
                held = len(self.chunks)
                self.ids, self.begins = flat[: begins[held]], begins[: held + 1]
            codes = known[coded.indices.to_numpy(zero_copy_only=False)]
            each = (begins[1:] - begins[:-1])[codes]
            ends = np.cumsum(each)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[codes] - (ends - each), each)
            yield first, flat[place], np.concatenate([[0], ends])[offsets]
            del chunks, coded, words, known, flat, codes, each, place
        release()
