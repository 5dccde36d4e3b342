from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tidewatch.llm import packing, rans, token_files, tokens
from tidewatch.session import scratch_path

BYTES, LOWER = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("word_bpe_49k.json"))


def plain(path, text):
    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return np.asarray(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, LOWER])
def test_pieces_give_the_ids_of_the_whole_text(path):
    rnd = random.Random(3)
    parts = ["a", "Bc", "é", " ", "  ", "\n", " \n", "\t", ".", ",", "'s", "12", "<|endoftext|>", "中", " ", "İ",
             "́", "_", "-", "\x1c", "🙂", "I'll", "(x)"]
    encoder, whole = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        want = np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder.encode(text) == want, repr(text)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARS", 200)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    encoder, rnd = tokens.PieceEncoder(BYTES), random.Random(4)
    for _ in range(30):
        text = prose(rnd, 30)
        assert encoder.encode(text) == plain(BYTES, text)


@pytest.mark.parametrize("ids", [[], [7], [5] * 3000, list(range(700)) * 9])
def test_segment_round_trip(ids, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 2500)
    monkeypatch.setattr(rans, "STEPS", 16)
    packed = [np.asarray(part, dtype="<u4").tobytes() for part in (ids[:1], ids[1:], [])]
    segment = rans.Segment(rans.encode_segment([4, None, 9], packed))
    assert segment.decode().tolist() == ids
    assert segment.lengths.tolist() == [len(ids[:1]), len(ids[1:]), 0]
    if len(ids) > 2500:  # from a checkpoint inside the first block on
        lanes = 2500 // 64
        assert segment.decode_block(0, 1).tolist() == ids[16 * lanes : 2500]


def test_damage_is_seen():
    data = bytearray(rans.encode_segment([1], [np.arange(500, dtype="<u4").tobytes()]))
    data[-3] ^= 1
    with pytest.raises(rans.Damaged):
        rans.Segment(bytes(data)).decode()


def test_quantised_frequencies_fill_the_scale():
    for counts in ([1], [1] * 50_000, [10**9, 1, 1], list(range(1, 3000))):
        freq = rans.quantise(np.array(counts))
        assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1


def test_token_files(llm, make_docs, corpus):
    folder = scratch_path(llm, "test-tokens")
    token_files.write_token_files(make_docs(corpus), folder, BYTES, 2, segment_ids=3000)
    got = [tuple(r) for r in token_files.digest(token_files.read_token_files(llm, folder)).collect()]
    start, want = 0, []
    for doc_id, text in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(BYTES, text) + np.array([2], dtype="<u4").tobytes()
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_of_nothing(llm, make_docs):
    folder = scratch_path(llm, "test-tokens")
    token_files.write_token_files(make_docs([]), folder, BYTES, 2)
    assert token_files.read_token_files(llm, folder).count() == 0


def test_packing(llm, make_docs, corpus):
    capacity = 128
    rows = packing.pack_documents(make_docs(corpus), LOWER, 0, capacity).collect()
    want = Counter()
    for doc_id, text in corpus:
        ids = plain(LOWER, text) + bytes(4)
        for at in range(0, len(ids), 4 * capacity):
            part = ids[at : at + 4 * capacity]
            want[(doc_id, at // 4 // capacity, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(by_sequence) <= least + 2
    whole = packing.sequences(make_docs(corpus), LOWER, 0, capacity).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_packing_of_nothing(make_docs):
    assert packing.pack_documents(make_docs([]), LOWER, 0).count() == 0


def best_fit_decreasing(sizes, capacity):
    import bisect
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        opened += k >= len(gaps) + (gap != capacity)
        if gap > size:
            bisect.insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_tight_as_sequential_best_fit(seed):
    rnd = random.Random(seed)
    sizes = [min(500, int(rnd.lognormvariate(rnd.choice([3, 5]), 1.1)) + 1) for _ in range(rnd.choice([40, 900, 5000]))]
    placed, opened = packing.plan(Counter(sizes), 500)
    assert sum(p.count for p in placed) == len(sizes)
    fill = Counter()
    for p in placed:
        for j in range(p.count):
            assert fill[p.sequence + j // p.each] == p.offset + (j % p.each) * p.length
            fill[p.sequence + j // p.each] += p.length
    assert max(fill.values()) <= 500 and len(fill) == opened
    want = packing_bound = -(-sum(sizes) // 500)
    assert opened <= max(packing_bound + 1, int(1.02 * want) + 1) or opened <= 1.01 * best_fit_decreasing(sizes, 500) + 1
