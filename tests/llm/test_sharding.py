import zlib
from collections import defaultdict

from ledgerloom.llm.sharding import assign_shards


def test_shards_are_contiguous_and_even(odd_docs, odd_texts):
    rows = assign_shards(odd_docs, 6).collect()
    assert len(rows) == len(odd_texts) + 4
    size, slots, span = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            body = (odd_texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        span[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) <= set(range(6))
    flat = [d for s in sorted(span) for _, d in sorted(span[s])]
    assert flat == sorted(flat)
    target, largest = sum(size.values()) / 6, max(r.size for r in rows)
    assert all(abs(size[s] - target) <= largest for s in range(6))


def test_no_rows(no_docs):
    assert assign_shards(no_docs).collect() == []


def test_shards_and_slots_equal_a_prefix_sum_over_all_rows(odd_docs):
    """The law again in plain Python: order, running bytes, the middle of each row's bytes against equal targets."""
    body = lambda r: (r.text or "").encode()
    ordered = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32(body(r)), len(body(r))))
    total, ahead, taken, want = sum(len(body(r)) + 8 for r in ordered), 0, defaultdict(int), []
    for r in ordered:
        size = len(body(r)) + 8
        shard = (2 * ahead + size) * 24 // (2 * total)
        want.append((r.doc_id, size, zlib.crc32(body(r)), shard, taken[shard]))
        ahead, taken[shard] = ahead + size, taken[shard] + 1
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in assign_shards(odd_docs, 24).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
