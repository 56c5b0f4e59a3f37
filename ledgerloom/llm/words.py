"""Words of a batch of texts as integer codes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.shared import plain_strings

UPPER = np.arange(65, 91)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[UPPER] += 32
    return table


def _letters_table() -> np.ndarray:
    """Lower-case A-Z; every ASCII character that is no letter or digit becomes a space."""
    table = _lower_table()
    for code in range(128):
        if not (48 <= code <= 57 or 97 <= int(table[code]) <= 122):
            table[code] = 32
    return table


#: Words between white space (space and \x09-\x0D), A-Z in lower case.
SPACED = _lower_table()
#: Words of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case.
ALPHANUMERIC = _letters_table()


def translated(texts, table: np.ndarray) -> pa.StringArray:
    """The texts with each byte replaced by way of ``table``, which must leave bytes over 127 alone."""
    texts = plain_strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    body = table[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(body))


def word_codes(texts, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct words, one code for each word of all texts in order, offsets of each text's words)."""
    lists = pc.ascii_split_whitespace(translated(texts, table))
    offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        flat = flat.filter(pa.array(filled))
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
    encoded = flat.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), offsets


def pieces_of(texts: pa.StringArray, most_bytes: int = 2 << 20):
    """Slices of the array that hold about ``most_bytes`` each, one text at least."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop
