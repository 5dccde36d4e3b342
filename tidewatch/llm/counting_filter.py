"""Counting quotient filters over packed word-id n-grams, as sorted arrays.

An n-gram of at most three ids (from 1; 0 fills up) is packed into two halves of equal
width and permuted by a keyed Feistel network. The permutation is invertible, so the
permuted key *is* the n-gram, and it spreads evenly. Its upper bits are the quotient,
all others the remainder, which is stored in full: no two n-grams share a counter.

A filter keeps its keys in order. Stored, it has per quotient one occupied bit, per key
one run-end bit, the remainder in as many bytes as it needs, and a counter that takes
one bit for 1, one byte more up to 255, and eight bytes beyond. The quotient takes
about one bit pattern per key, so its width depends on the filter's own size; keys are
the same at every width, and filters of all widths merge.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

ROUNDS = 4
_KEYS = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]
_HEAD = "<QBBBBQ"  # keys, half width, slice bits, quotient bits, bytes of a remainder, slice


def _round(half: np.ndarray, key: int, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (half + np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(64 - width)) if width < 64 else x


class Keys:
    """The key space of n-grams over ids below 2**bits."""

    def __init__(self, bits: int) -> None:
        if not 1 <= bits <= 40:
            raise ValueError("ids need 1 to 40 bits")
        self.bits = bits
        self.width = -(-3 * bits // 2)  # of one half
        self.narrow = 2 * self.width <= 64  # a key is one number, else two

    def _join(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Keys that sort: uint64, or pairs of uint64 for wide spaces."""
        if self.narrow:
            return high << np.uint64(self.width) | low
        out = np.empty(len(high), dtype=[("high", "<u8"), ("low", "<u8")])
        out["high"], out["low"] = high, low
        return out

    def _halves(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.narrow:
            return keys >> np.uint64(self.width), keys & np.uint64((1 << self.width) - 1)
        return keys["high"], keys["low"]

    def pack(self, a: np.ndarray, b: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        bits, width = self.bits, self.width
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        c = np.broadcast_to(np.asarray(c, dtype=np.uint64), a.shape)
        # the middle id is split between the halves
        low_bits = width - bits
        high = a << np.uint64(bits - low_bits) | b >> np.uint64(low_bits)
        low = (b & np.uint64((1 << low_bits) - 1)) << np.uint64(bits) | c
        for key in _KEYS[:ROUNDS]:
            high, low = low, high ^ _round(low, key, width)
        return self._join(high, low)

    def unpack(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, width = self.bits, self.width
        high, low = self._halves(keys)
        for key in reversed(_KEYS[:ROUNDS]):
            high, low = low ^ _round(high, key, width), high
        low_bits = width - bits
        a = high >> np.uint64(bits - low_bits)
        b = (high & np.uint64((1 << (bits - low_bits)) - 1)) << np.uint64(low_bits) | low >> np.uint64(bits)
        return a, b, low & np.uint64((1 << bits) - 1)

    def top(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """The upper ``bits`` (at most a half's width) of each key."""
        return self._halves(keys)[0] >> np.uint64(self.width - bits)

    def rest(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """What lies below the upper ``bits``, as the halves' (high, low)."""
        high, low = self._halves(keys)
        return high & np.uint64((1 << (self.width - bits)) - 1), low

    def whole(self, top: np.ndarray, bits: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return self._join(top << np.uint64(self.width - bits) | high, low)


def merge(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of several filters (or of unsorted key arrays)."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    if not len(keys):
        return keys, counts
    if keys.dtype.names:
        order = np.lexsort((keys["low"], keys["high"]))
    else:
        order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _pack_low(values: np.ndarray, size: int) -> np.ndarray:
    return values.astype("<u8").view("u1").reshape(-1, 8)[:, :size]


def _unpack_low(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), dtype="u1")
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8").ravel()


def stored(space: Keys, keys: np.ndarray, counts: np.ndarray, slice_bits: int, number: int) -> bytes:
    """A filter of sorted keys that all share the upper ``slice_bits``, ``number``."""
    n = len(keys)
    bits = min(space.width, slice_bits + max(n.bit_length() - 1, 0))
    quotient = (space.top(keys, bits) & np.uint64((1 << (bits - slice_bits)) - 1)).astype(np.int64)
    occupied = np.zeros(1 << (bits - slice_bits), dtype=bool)
    occupied[quotient] = True
    ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else np.zeros(0, dtype=bool)
    high, low = space.rest(keys, bits)
    high_size, low_size = -(-(space.width - bits) // 8), -(-space.width // 8)
    more = counts > 1
    small = np.minimum(counts[more] - 1, 255).astype("u1")
    return b"".join([
        struct.pack(_HEAD, n, space.bits, slice_bits, bits, high_size, number),
        np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
        _pack_low(high, high_size).tobytes(), _pack_low(low, low_size).tobytes(),
        np.packbits(more).tobytes(), small.tobytes(), counts[more][small == 255].astype("<u8").tobytes(),
    ])


def loaded(data: bytes) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Key space, keys and counts of a stored filter."""
    n, id_bits, slice_bits, bits, high_size, number = struct.unpack_from(_HEAD, data)
    space, at = Keys(id_bits), struct.calcsize(_HEAD)
    low_size = -(-space.width // 8)

    def take(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, "u1", size, at)
        at += size
        return part

    def flags(count: int) -> np.ndarray:
        return np.unpackbits(take(-(-count // 8)), count=count).astype(bool)

    occupied, ends = flags(1 << (bits - slice_bits)), flags(n)
    run = np.cumsum(ends) - ends  # runs that ended before each key
    quotient = np.flatnonzero(occupied)[run] if n else np.zeros(0, dtype=np.int64)
    high = _unpack_low(take(n * high_size).reshape(n, high_size))
    low = _unpack_low(take(n * low_size).reshape(n, low_size))
    more = flags(n)
    small = take(int(more.sum())).astype(np.int64)
    beyond = take(8 * int((small == 255).sum())).view("<u8").astype(np.int64)
    extra = small + 1
    extra[small == 255] = beyond
    counts = np.ones(n, dtype=np.int64)
    counts[more] = extra
    top = np.uint64(number << (bits - slice_bits)) | quotient.astype(np.uint64)
    return space, space.whole(top, bits, high, low), counts


def slices(space: Keys, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """The filter cut by the upper ``bits`` of its sorted keys; empty slices are left out."""
    if not len(keys):
        return []
    number = space.top(keys, bits).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    ends = [*starts[1:].tolist(), len(keys)]
    return [
        (int(number[a]), stored(space, keys[a:b], counts[a:b], bits, int(number[a])))
        for a, b in zip(starts.tolist(), ends, strict=True)
    ]
