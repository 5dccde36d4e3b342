"""A lexicon of words as a minimal acyclic transducer, in one file for memory mapping.

Words are byte strings. States that accept the same endings are one state, so suffixes
are shared. An arc carries a whole number; the sum along a word's path is the word's
place in byte order, and the id sequences lie in that order in one array. Numbers
depend on the state alone, so they never keep two equal states apart.

The file holds a header and plain arrays, little endian; a reader maps it and looks up
many words at once, one byte position a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from tidewatch.session import scratch_path

MAGIC = 0x31584C57  # "WLX1"
_HEAD = 8  # 64-bit numbers: magic, arcs, words, ids, states, root, longest word, unused


def _minimal(words: Sequence[bytes]) -> tuple[list[tuple[bool, tuple]], list[int], int]:
    """States (accepting, arcs) with the number of words below each, and the root, from
    distinct words in ascending order."""
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            below.append(node[0] + sum(below[target] for _, target in node[1]))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))

    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        fold(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    fold(0)
    return states, below, close(path[0])


def compiled(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The file for ``entries``: ids by word."""
    words = sorted(entries)
    states, below, root = _minimal(words)
    keys, targets, sums = [], [], []
    for number, (accepts, arcs) in enumerate(states):
        so_far = int(accepts)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            targets.append(target)
            sums.append(so_far)
            so_far += below[target]
    ends = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = [i for w in words for i in entries[w]]
    head = [MAGIC, len(keys), len(words), len(ids), len(states), root, max(map(len, words), default=0), 0]
    return b"".join([
        np.array(head, "<i8").tobytes(), np.array(keys, "<i8").tobytes(), np.array(targets, "<u4").tobytes(),
        np.array(sums, "<u4").tobytes(), ends.astype("<u4").tobytes(), np.array(ids, "<u4").tobytes(),
        np.array([accepts for accepts, _ in states], "u1").tobytes(),
    ])


class Lexicon:
    """Reader over a mapped file (or bytes)."""

    def __init__(self, data: np.ndarray | bytes) -> None:
        raw = np.frombuffer(data, "u1") if isinstance(data, bytes) else data
        head = raw[: 8 * _HEAD].view("<i8")
        magic, arcs, words, ids, states, self.root, self.longest = (int(x) for x in head[:7])
        if magic != MAGIC:
            raise ValueError("not a lexicon")
        at = 8 * _HEAD

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            part = raw[at : at + size].view(kind)
            at += size
            return part

        self.keys, self.targets, self.sums = take(arcs, "<i8"), take(arcs, "<u4"), take(arcs, "<u4")
        self.ends, self.ids, self.accepts = take(words + 1, "<u4"), take(ids, "<u4"), take(states, "u1")

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """Place of each word, -1 for words that the lexicon does not hold."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), "u1")
        found = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        alive = np.flatnonzero((lengths <= self.longest) & (lengths > 0))
        state = np.full(len(alive), self.root, dtype=np.int64)
        place = np.zeros(len(alive), dtype=np.int64)
        step = 0
        while len(alive):
            key = state << 8 | text[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            alive, arc, place = alive[on], arc[on], place[on]
            state = self.targets[arc].astype(np.int64)
            place += self.sums[arc]
            step += 1
            over = lengths[alive] == step
            good = over & (self.accepts[state] == 1)
            found[alive[good]] = place[good]
            alive, state, place = alive[~over], state[~over], place[~over]
        return found

    def id_bytes(self, place: int) -> bytes:
        return self.ids[self.ends[place] : self.ends[place + 1]].tobytes()


def publish(spark: SparkSession, data: bytes) -> str:
    """Put the file into the shared folder and have Spark hand it to every executor,
    also to those that join later. Returns its name there."""
    path = scratch_path(spark, "lexicon")
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    context.addFile(path)
    return path.rsplit("/", 1)[-1]


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    """The published file, mapped once per worker process; workers of a machine share
    its pages."""
    return Lexicon(np.memmap(SparkFiles.get(name), dtype="u1", mode="r"))
