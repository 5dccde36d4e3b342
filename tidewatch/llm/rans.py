"""Static range asymmetric numeral system over token ids, interleaved over lanes.

A segment holds one frequency table that all its blocks share, and blocks that decode
independently. A block runs up to ``LANES`` coder states side by side: token i
belongs to lane i % lanes, so one numpy step codes a whole row of lanes. Every
``STEPS`` rows a checkpoint keeps the states and the place in the word stream, from
which decoding can start, and the crc32 of the ids up to the next checkpoint.

Layout of a segment, little endian::

    magic 4s | documents u32 | symbols u32 | blocks u32
    symbols: ids u32[], frequencies u32[]      (sum 2**SCALE)
    documents: ids i64[], id counts u32[]
    per block: size u32, crc32 of the body u32, body
    body: ids u32 | lanes u32 | checkpoints u32 | words u32
          per checkpoint: place u32, crc32 u32, states u64[lanes]
          words u32[]

Sections of integer arrays are stored deflated with their size in front.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TWR1"
SCALE = 20
LANES = 1024
BLOCK_IDS = 1 << 20
STEPS = 256
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)


class Damaged(ValueError):
    """A checksum or the layout does not fit."""


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each counted symbol."""
    total = int(counts.sum())
    if len(counts) > 1 << SCALE:
        raise ValueError("more symbols than the scale can hold")
    freq = np.maximum(1, counts.astype(np.float64) * ((1 << SCALE) / total)).astype(np.int64)
    left = (1 << SCALE) - int(freq.sum())
    if left > 0:
        freq[int(np.argmax(freq))] += left
    order = np.argsort(-freq, kind="stable")
    at = 0
    while left < 0:  # rounding up rare symbols is paid by the frequent ones
        take = min(-left, max(0, int(freq[order[at]]) // 2))
        freq[order[at]] -= take
        left += take
        at = (at + 1) % len(order)
    return freq


def _pack(array: np.ndarray) -> bytes:
    raw = zlib.compress(np.ascontiguousarray(array).tobytes(), 6)
    return struct.pack("<I", len(raw)) + raw


def _unpack(view: memoryview, at: int, kind: str) -> tuple[np.ndarray, int]:
    (size,) = struct.unpack_from("<I", view, at)
    end = at + 4 + size
    return np.frombuffer(zlib.decompress(view[at + 4 : end]), dtype=kind), end


def _encode_block(index: np.ndarray, ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    n = len(index)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    limit = freq << np.uint64(63 - SCALE)
    words: list[np.ndarray] = []
    sizes = np.zeros(steps, dtype=np.int64)
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        row = index[step * lanes : (step + 1) * lanes]
        x, f = state[: len(row)], freq[row]
        full = x >= limit[row]
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            sizes[step] = len(out)
            x[full] >>= _WORD
        high, low = np.divmod(x, f)
        state[: len(row)] = (high << _BITS) + low + start[row]
        if step % STEPS == 0:
            marks.append((step, state.copy()))
    words.reverse()
    before = np.concatenate([[0], np.cumsum(sizes)])
    parts = [struct.pack("<IIII", n, lanes, len(marks), int(before[-1]))]
    for step, states in reversed(marks):
        piece = ids[step * lanes : (step + STEPS) * lanes]
        parts.append(struct.pack("<II", int(before[step]), zlib.crc32(piece.astype("<u4").tobytes())))
        parts.append(states.astype("<u8").tobytes())
    parts.append(b"".join(w.tobytes() for w in words))
    return b"".join(parts)


def encode_segment(doc_ids: list[int | None], packed: list[bytes]) -> bytes:
    """``packed``: the ids of each document as little-endian u32. A null doc_id is
    kept as the smallest 64-bit integer."""
    ids = np.frombuffer(b"".join(packed), dtype="<u4")
    lengths = np.fromiter((len(p) // 4 for p in packed), dtype="<u4", count=len(packed))
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    symbols = np.flatnonzero(counts)
    blocks: list[bytes] = []
    freq = np.zeros(0, dtype=np.int64)
    if len(ids):
        freq = quantise(counts[symbols])
        begin = (np.cumsum(freq) - freq).astype(np.uint64)
        where = np.zeros(len(counts), dtype=np.int64)
        where[symbols] = np.arange(len(symbols))
        index = where[ids]
        for at in range(0, len(ids), BLOCK_IDS):
            body = _encode_block(
                index[at : at + BLOCK_IDS], ids[at : at + BLOCK_IDS], freq.astype(np.uint64), begin
            )
            blocks.append(struct.pack("<II", len(body), zlib.crc32(body)) + body)
    keys = np.array([NULL_ID if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([
        struct.pack("<4sIII", MAGIC, len(packed), len(symbols), len(blocks)),
        _pack(symbols.astype("<u4")), _pack(freq.astype("<u4")), _pack(keys), _pack(lengths), *blocks,
    ])


NULL_ID = -(1 << 63)


class Segment:
    """Reader of one segment; ``decode`` gives all ids, ``decode_block`` those of one
    block, from any of its checkpoints on."""

    def __init__(self, data: bytes) -> None:
        view = memoryview(data)
        magic, _, _, blocks = struct.unpack_from("<4sIII", view, 0)
        if magic != MAGIC:
            raise Damaged("not a token segment")
        self.symbols, at = _unpack(view, 16, "<u4")
        freq, at = _unpack(view, at, "<u4")
        self.doc_ids, at = _unpack(view, at, "<i8")
        self.lengths, at = _unpack(view, at, "<u4")
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.bodies: list[memoryview] = []
        for _ in range(blocks):
            size, crc = struct.unpack_from("<II", view, at)
            body = view[at + 8 : at + 8 + size]
            if len(body) != size or zlib.crc32(body) != crc:
                raise Damaged("a block does not fit its checksum")
            self.bodies.append(body)
            at += 8 + size

    def decode_block(self, number: int, checkpoint: int = 0) -> np.ndarray:
        body = self.bodies[number]
        n, lanes, marks, total = struct.unpack_from("<IIII", body, 0)
        size = 8 + 8 * lanes
        words = np.frombuffer(body, dtype="<u4", count=total, offset=16 + marks * size)
        at = 16 + checkpoint * size
        place, _ = struct.unpack_from("<II", body, at)
        state = np.frombuffer(body, dtype="<u8", count=lanes, offset=at + 8).astype(np.uint64)
        first = checkpoint * STEPS
        out = np.empty(n - first * lanes, dtype=np.uint32)
        for step in range(first, -(-n // lanes)):
            begin = (step - first) * lanes
            m = min(lanes, len(out) - begin)
            x = state[:m]
            slot = x & _MASK
            got = self.slots[slot]
            out[begin : begin + m] = got
            x = self.freq[got] * (x >> _BITS) + slot - self.start[got]
            low = x < _LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << _WORD) | words[place : place + k].astype(np.uint64)
                place += k
            state[:m] = x
        ids = self.symbols[out]
        for mark in range(checkpoint, marks):
            _, crc = struct.unpack_from("<II", body, 16 + mark * size)
            piece = ids[(mark - checkpoint) * STEPS * lanes : (mark - checkpoint + 1) * STEPS * lanes]
            if zlib.crc32(piece.astype("<u4").tobytes()) != crc:
                raise Damaged("ids do not fit their checksum")
        return ids

    def decode(self) -> np.ndarray:
        parts = [self.decode_block(i) for i in range(len(self.bodies))]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
