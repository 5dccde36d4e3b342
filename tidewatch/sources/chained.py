"""SHA-256 of files too large for one task. The hash is a chain, so its parts are read one
after another, but by a new task each: the state between two parts is a hundred bytes."""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

from pyspark import RDD
from pyspark.serializers import NoOpSerializer
from pyspark.sql import SparkSession

from tidewatch.errors import DataQualityError

PART_BYTES = 1 << 26
BLOCK_BYTES = 1 << 20
# Every level cuts what the last one left into parts of one eighth.
STEP = 8
# Hadoop's last split may be longer than the others by this factor.
SLOP = 1.1

# OpenSSL's SHA256_CTX is 112 bytes of plain integers.
_CONTEXT_BYTES = 128


class RunningHash:
    """SHA-256 with a state that can be handed on, over the OpenSSL that Python itself uses:
    ``hashlib`` keeps its state to itself."""

    def __init__(self, state: bytes | None = None) -> None:
        self._lib = _openssl()
        self._context = ctypes.create_string_buffer(state, _CONTEXT_BYTES) if state else (
            ctypes.create_string_buffer(_CONTEXT_BYTES)
        )
        if state is None:
            self._lib.SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._context, bytes(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        last = ctypes.create_string_buffer(self.state(), _CONTEXT_BYTES)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()


@cache
def _openssl() -> ctypes.CDLL:
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


@cache
def can_chain() -> bool:
    """Whether this Python's OpenSSL lets a hash go on from a state."""
    try:
        head = RunningHash()
        head.update(b"a" * 100)
        tail = RunningHash(head.state())
        tail.update(b"b" * 100)
    except (ImportError, AttributeError, OSError):
        return False
    return tail.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


def literal_path(path: str) -> str:
    """A path that Hadoop's glob takes as it is."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def is_packed(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's readers take the file for a compressed one, going by its name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return codecs.getCodec(hadoop.fs.Path(path)) is not None


def _blocks(spark: SparkSession, path: str, split_bytes: int, block_bytes: int) -> RDD:
    """The blocks of one file, a partition for each split: ``SparkContext.binaryRecords``
    with splits of a given size."""
    context = spark.sparkContext
    conf = context._jvm.org.apache.hadoop.conf.Configuration(context._jsc.hadoopConfiguration())
    for bound in ("minsize", "maxsize"):
        conf.setLong(f"mapreduce.input.fileinputformat.split.{bound}", split_bytes)
    # a comma ends a path, unless it stands in braces
    one = literal_path(path).replace(",", "{\\,}")
    records = context._jsc.sc().binaryRecords(one, block_bytes, conf)
    return RDD(records.toJavaRDD(), context, NoOpSerializer())


class _Chain:
    """One file, hashed up to ``at``."""

    def __init__(self, path: str, length: int) -> None:
        self.path, self.length = path, length
        self.at, self.state = 0, RunningHash().state()


def _round(spark: SparkSession, blocks: RDD, turn: dict[int, _Chain], single: bool) -> None:
    """One part of every file in ``turn`` (by partition), each read by its own task; single
    bytes, a block of them at most, are joined first."""
    states = {index: chain.state for index, chain in turn.items()}

    def absorb(index: int, records: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
        running, count = RunningHash(states[index]), 0
        for block in [b"".join(records)] if single else records:
            running.update(block)
            count += len(block)
        yield index, count, running.state()

    done = spark.sparkContext.runJob(
        blocks.mapPartitionsWithIndex(absorb), lambda rows: rows, sorted(states)
    )
    for index, count, state in done:
        turn[index].at += count
        turn[index].state = state


def _level(spark: SparkSession, chains: list[_Chain], split: int, block: int, last: bool) -> None:
    """Read on in parts of ``split`` bytes up to the last split, or read that one."""
    if not chains:
        return
    each = [_blocks(spark, c.path, split, block) for c in chains]
    every = spark.sparkContext.union(each)
    parts = [rdd.getNumPartitions() for rdd in each]
    starts = list(accumulate(parts, initial=0))
    for number in range(1 if last else max(parts)):
        turn = {}
        for chain, start, count in zip(chains, starts, parts):
            part = chain.at // split
            if last and part != count - 1:
                raise DataQualityError(f"{chain.path} changed while it was read")
            if part < count - 1 or last:
                turn[start + part] = chain
        if not turn:
            return
        ends = {index: chain.at + split for index, chain in turn.items()}
        _round(spark, every, turn, single=last)
        for index, chain in turn.items():
            if chain.at != (chain.length if last else ends[index]):
                raise DataQualityError(f"{chain.path} changed while it was read")


def chained_digests(
    spark: SparkSession, sizes: dict[str, int], part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES
) -> dict[str, str]:
    """SHA-256 by path of files of the given sizes, all of them side by side. A task reads
    one split through Spark's own reader, at most ``part_bytes``, so a lost one costs no
    more than that. The reader takes blocks of a fixed length and no shorter rest: each level
    reads all splits but the last, and the last level reads what is left byte by byte."""
    chains = [_Chain(path, length) for path, length in sorted(sizes.items())]
    splits = [block_bytes]
    while splits[0] * STEP <= part_bytes:
        splits.insert(0, splits[0] * STEP)
    for split in splits:
        cut = [c for c in chains if c.length / split > SLOP]
        _level(spark, cut, split, block_bytes, last=False)
    _level(spark, chains, block_bytes, 1, last=True)
    return {c.path: RunningHash(c.state).hexdigest() for c in chains}
