import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bitplanes, packing
from ledgerloom.llm.registry import tokenizer_path
from ledgerloom.llm.tokens import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@functools.cache
def loaded(name):
    return Tokenizer.from_file(tokenizer_path(name))


def plain(name, text):
    return loaded(name).encode(text or "", add_special_tokens=False).ids


def coded(name, texts):
    out = []
    for _, ids, ends in Encoder.of(tokenizer_path(name)).encode(pa.array(texts, pa.string())):
        out += [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(ends) - 1)]
    return out


@pytest.mark.parametrize("name", NAMES)
def test_chunked_ids_equal_plain_ids(name, odd_texts):
    assert coded(name, odd_texts) == [plain(name, t) for t in odd_texts]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"ab Z.,\n\t|'s3é 　́×日!\r\x1c", "<|endoftext|>", "<|StartOfText|>"]), max_size=40).map("".join), max_size=6))
def test_chunked_ids_of_any_text(name, texts):
    assert coded(name, texts) == [plain(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_added_tokens_keep_their_ids(name):
    texts = ["one <|endoftext|> two", "a\n<|startoftext|>\nb, c", "<|ENDOFTEXT|> x", " <|endoftext|><|startoftext|> ", "x.<|endoftext|>.y <|endo text|>", "none. of them\nhere"]
    assert coded(name, texts) == [plain(name, t) for t in texts]
    special = {t: i for i, t in loaded(name).get_added_tokens_decoder().items() if t.content == "<|endoftext|>"}
    assert set(special.values()) <= set(coded(name, texts)[0])


def test_equal_rows_spread_over_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two three " * 50)] * 400, "doc_id long, text string").repartition(4)
    pieces = packing.pack(packing.token_pieces(docs, tokenizer_path(NAMES[1])), tokens_a_task=8000)
    assert len({r.sequence_id >> 32 for r in pieces.select("sequence_id").collect()}) > 3
    bitplanes.write_token_files(docs, f"file://{tmp_path}/same", tokenizer_path(NAMES[0]), files=4)
    assert spark.read.parquet(f"file://{tmp_path}/same/index").select("file").distinct().count() > 2
    assert bitplanes.document_checksums(spark, f"file://{tmp_path}/same").count() == 400


def test_packing_covers_each_id_once(odd_docs, odd_texts):
    rows = packing.pack_documents(odd_docs, tokenizer_path(NAMES[1]), window=512).collect()
    want = {i: [*plain(NAMES[1], t), 2] for i, t in enumerate(odd_texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 2048
        by_sequence[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 7:
            by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in by_doc.items()} == {d: x for d, x in want.items() if d != 7}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    filled = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * filled / 512


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 400))[::-1]
    window, offset = packing.best_fit(lengths, 64)
    room: dict[int, int] = {}
    for n, w, o in zip(lengths.tolist(), window.tolist(), offset.tolist()):
        fits = [r for r in room.values() if r >= n]
        if fits:
            assert room[w] == min(fits)
        else:
            assert w not in room
        assert o == 64 - room.get(w, 64)
        room[w] = room.get(w, 64) - n


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), rng.integers(0, 50257, 1001).astype(np.uint32), np.array([2**32 - 1, 5], np.uint32)):
        assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), len(ids), kind).tolist() == ids.tolist()


@pytest.mark.parametrize("kind,block", [("bit", 64), ("byte", 1000), ("bit", 65_536)])
def test_token_files_round_trip(spark, odd_docs, odd_texts, tmp_path, kind, block):
    path = f"file://{tmp_path}/files"
    bitplanes.write_token_files(odd_docs, path, tokenizer_path(NAMES[0]), block=block, kind=kind)
    rows = sorted(bitplanes.read_token_files(spark, path).collect(), key=lambda r: r.start)
    sums = {(r.doc_id, r.start): r for r in bitplanes.document_checksums(spark, path).collect()}
    assert len(rows) == len(sums) == len(odd_texts) + 4
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        assert (sums[r.doc_id, r.start].ids_crc32, sums[r.doc_id, r.start].n_tokens) == (zlib.crc32(bytes(r.ids)), r.n_tokens)
        at += r.n_tokens
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*plain(NAMES[0], odd_texts[r.doc_id]), 2]
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_empty_tables(spark, no_docs, tmp_path):
    assert packing.pack_documents(no_docs, tokenizer_path(NAMES[1])).collect() == []
    bitplanes.write_token_files(no_docs, f"file://{tmp_path}/files", tokenizer_path(NAMES[0]))
    assert bitplanes.document_checksums(spark, f"file://{tmp_path}/files").collect() == []
