"""Language-model scores from a log-frequency Bloom filter.

Words and one end token per text are the tokens. Every text is turned once into a row
of a chunk table (some hundred texts: their distinct word hashes and codes into them).
From there:

* Unigram counts are exact. Each chunk sends its distinct words to segments of the
  64-bit hash range; a segment adds the counts of the training texts and sends every
  chunk its words' totals back. No table of all words is ever in one place.
* Bigram counts of the training texts meet in segments in the same way, and a segment
  writes its part of the filter: a bigram seen c times is entered once for each level
  up to 1 + floor(log(c / least) / log(base)), under a different hash per level.
  Probing levels until the first miss gives the quantised count back.
* The filter goes to the workers in shards of at most ``SHARD_BYTES``, one broadcast
  after the other. Each bigram of a chunk is laid under the one shard it falls into, so
  all passes together probe every bigram once, however many shards there are. The
  levels go back to the chunks, and weights and scores are computed from them.

P(w | v) = a * count(v w) / count(v) + (1 - a) * P1(w), with P1 the add-one unigram
probability. The weight a depends on the size of count(v) and maximises the likelihood
of the training texts with each token's own occurrence taken away.

Defined cases: a null or blank text is the end token alone; doc_ids may repeat or be
null, rows are scored one by one; an empty training part gives counts of 0 (N = V = 0,
so an unknown token has probability 1); an empty table gives no rows; a text of any
length stays whole. Further columns are ignored. Words are told apart by a 64-bit
hash; two words of a corpus of 10**9 different ones share it with a probability of 3 %.
Bigrams are told apart within their segment by 32 further bits of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column, discard, held_out, mix64, text_list, texts_of, words_of
from tidewatch.session import materialize, scratch_path

END, BEGIN = b"", b" "  # no word is empty or holds a blank
SEGMENT_KEYS = 1 << 19  # keys a segment should hold
FLUSH_TOKENS = 1 << 21  # bigrams a task gathers before it sends them
CHUNK_CHARS = 2_000_000
LEAST_COUNT = 1  # rarer bigrams stay out of the filter
BASE = 2.0
BITS_PER_ENTRY = 14
HASHES = 7
SHARD_BYTES = 32 << 20
WEIGHTS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
BUCKETS = 32

_CHUNK_SCHEMA = (
    "chunk long, doc_ids array<long>, lengths array<int>, train array<boolean>, words binary, codes binary, "
    "n_tokens long, n_words long"
)
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("train", pa.list_(pa.bool_())), ("words", pa.binary()), ("codes", pa.binary()),
    ("n_tokens", pa.int64()), ("n_words", pa.int64()),
])


def _hashes(words: list[bytes]) -> np.ndarray:
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return mix64(pd.util.hash_array(values, categorize=False))


def _squeeze(values: np.ndarray, width: int = 4) -> bytes:
    """Values of ``width`` bytes as byte planes, deflated: planes of small values nearly
    vanish."""
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


_BEGIN_HASH = int(_hashes([BEGIN])[0])


class _Codes(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def chunks(docs: DataFrame, modulus: int, rest: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    fold = F.coalesce(held_out(F.col("doc_id"), modulus, rest), F.lit(False))
    rows = texts_of(docs).withColumn("train", ~fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        train: list[bool] = []
        lengths: list[int] = []
        code = _Codes()
        codes: list[np.ndarray] = []
        chars = 0

        def close() -> pa.RecordBatch:
            # codes by first appearance: frequent words have small ones
            return as_batch({
                "chunk": [(part << 32) + number], "doc_ids": [ids], "lengths": [lengths], "train": [train],
                "words": [_hashes(list(code)).tobytes()], "codes": [_squeeze(np.concatenate(codes))],
                "n_tokens": [sum(lengths)], "n_words": [len(code)],
            }, _CHUNK)

        for batch in batches:
            for key, text, learn in zip(
                column(batch, "doc_id").to_pylist(), text_list(batch), column(batch, "train").to_pylist(), strict=True
            ):
                words = words_of(text)
                words.append(END)
                codes.append(np.fromiter(map(code.__getitem__, words), "<u4", len(words)))
                ids.append(key)
                train.append(learn)
                lengths.append(len(words))
                chars += len(text)
                if chars >= chunk_chars:
                    yield close()
                    number, ids, train, lengths, code, codes, chars = number + 1, [], [], [], _Codes(), [], 0
        if ids:
            yield close()

    return rows.mapInArrow(run, _CHUNK_SCHEMA)


@dataclass
class _Chunk:
    """One row of the chunk table, as arrays."""

    words: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    train: np.ndarray  # per text

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> _Chunk:
        return cls(
            np.frombuffer(column(batch, "words")[i].as_py(), dtype=np.uint64),
            _expand(column(batch, "codes")[i].as_py()),
            np.array(column(batch, "lengths")[i].as_py(), dtype=np.int64),
            np.array(column(batch, "train")[i].as_py(), dtype=bool),
        )

    def first(self) -> np.ndarray:
        """Position of each text's first token."""
        return np.cumsum(self.lengths) - self.lengths

    def bigrams(self) -> np.ndarray:
        current = self.words[self.codes]
        before = np.empty_like(current)
        before[1:] = current[:-1]
        before[self.first()] = np.uint64(_BEGIN_HASH)
        with np.errstate(over="ignore"):
            return mix64(before * np.uint64(0x9E3779B97F4A7C15) + current)


def _segments(total: int, per_segment: int) -> int:
    """Bits of the segment number."""
    return max(0, math.ceil(math.log2(max(1, total / per_segment))))


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each segment in sorted 64-bit keys."""
    if bits == 0:
        return np.array([0]), np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.arange(1 << bits), np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _segment_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def unigram_totals(table: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, totals): counts in the training texts, one u32 per distinct word in the
    order of the words' hashes; and (n, v): all training tokens, distinct ones."""
    sent_schema = pa.schema([
        ("segment", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk.of(batch, i)
                counts = np.bincount(
                    c.codes, weights=np.repeat(c.train, c.lengths), minlength=len(c.words)).astype(np.uint32)
                order = np.argsort(c.words)
                words, counts = c.words[order], counts[order]
                segments, at = _split(words, bits)
                key = column(batch, "chunk")[i].as_py()
                spans = [(int(s), int(a), int(b)) for s, a, b in zip(segments, at, at[1:], strict=False) if b > a]
                yield as_batch({
                    "segment": [s for s, _, _ in spans], "chunk": [key] * len(spans),
                    "keys": [words[a:b].tobytes() for _, a, b in spans],
                    "counts": [counts[a:b].tobytes() for _, a, b in spans],
                }, sent_schema)

    def add(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint64) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(k, dtype=np.uint32) for k in group.column("counts").to_pylist()])
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, weights=counts, minlength=len(found)).astype(np.int64)
        answers = np.minimum(totals, 2**32 - 1).astype(np.uint32)[where]
        ends = np.cumsum([len(k) for k in keys])
        n = group.num_rows
        return pa.table({
            "segment": group.column("segment"), "chunk": group.column("chunk"),
            "totals": pa.array([answers[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)], pa.binary()),
            "n": pa.array([int(totals.sum())] + [0] * (n - 1), pa.int64()),
            "v": pa.array([int((totals > 0).sum())] + [0] * (n - 1), pa.int64()),
        })

    sent = table.select("chunk", "lengths", "train", "words", "codes").mapInArrow(
        send, "segment long, chunk long, keys binary, counts binary")
    back = materialize(sent.groupBy("segment").applyInArrow(
        add, "segment long, chunk long, totals binary, n long, v long"), "word-totals")
    ordered = F.sort_array(F.collect_list(F.struct("segment", "totals")))
    joined = back.groupBy("chunk").agg(F.transform(ordered, lambda s: s["totals"]).alias("totals"))
    return joined, back.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))


def _levels(counts: np.ndarray, least: int, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts / least) / math.log(base) + 1e-9).astype(np.int64)


def _positions(keys: np.ndarray, level: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Bit numbers within parts of ``sizes`` bits, one array per hash function."""
    with np.errstate(over="ignore"):
        a = mix64(keys + np.uint64((level * 0xD6E8FEB86659FD93) % 2**64))
        b = mix64(a) | np.uint64(1)
        for i in range(HASHES):
            yield ((a + np.uint64(i) * b) % sizes).astype(np.int64)


def bigram_filter(table: DataFrame, bits: int, least: int = LEAST_COUNT, base: float = BASE) -> DataFrame:
    """segment, size (bits), part: the segments' pieces of the Bloom filter."""
    sent_schema = pa.schema([("segment", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    # a segment's bits are implied; 32 further ones tell its bigrams apart
    shift = _shift(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            segments, at = _split(keys, bits)
            short = (keys >> shift).astype(np.uint32)
            counts = counts.astype(np.uint32)
            spans = [(int(s), int(a), int(b)) for s, a, b in zip(segments, at, at[1:], strict=False) if b > a]
            return as_batch({
                "segment": [s for s, _, _ in spans],
                # sorted keys travel as differences
                "keys": [_squeeze(np.diff(short[a:b], prepend=np.uint32(0))) for _, a, b in spans],
                "counts": [_squeeze(counts[a:b]) for _, a, b in spans],
            }, sent_schema)

        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk.of(batch, i)
                held.append(c.bigrams()[np.repeat(c.train, c.lengths)])
                if sum(map(len, held)) >= FLUSH_TOKENS:
                    yield flush()
                    held = []
        if held:
            yield flush()

    def build(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_expand(k), dtype=np.uint32) for k in group.column("keys").to_pylist()])
        counts = np.concatenate([_expand(k) for k in group.column("counts").to_pylist()])
        found, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(found))
        kept = total >= least
        found, level = found[kept].astype(np.uint64), _levels(total[kept], least, base)
        size = max(64, int(level.sum()) * BITS_PER_ENTRY)
        field = np.zeros(size, dtype=bool)
        for j in range(1, int(level.max(initial=0)) + 1):
            for at in _positions(found[level >= j], j, np.uint64(size)):
                field[at] = True
        return pa.table({
            "segment": pa.array([group.column("segment")[0].as_py()], pa.int64()),
            "size": pa.array([size], pa.int64()), "part": pa.array([np.packbits(field).tobytes()], pa.binary()),
        })

    sent = table.select("lengths", "train", "words", "codes").mapInArrow(send, "segment long, keys binary, counts binary")
    return sent.groupBy("segment").applyInArrow(build, "segment long, size long, part binary")


@dataclass
class Shard:
    """Consecutive segments of the filter, as one stretch of bytes."""

    bits: int  # of a segment's number
    first: int  # its first segment
    start: np.ndarray  # first byte of each of its segments
    size: np.ndarray  # their bits
    data: np.ndarray

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key, all of them of this shard: probes until they miss."""
        segment = _segment_of(keys, self.bits) - self.first
        alive = np.flatnonzero(self.size[segment] > 0)
        short = ((keys >> _shift(self.bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint64)
        level = np.zeros(len(keys), dtype=np.int64)
        j = 0
        while len(alive):
            j += 1
            sizes, begin = self.size[segment[alive]].astype(np.uint64), self.start[segment[alive]]
            hit = np.ones(len(alive), dtype=bool)
            for at in _positions(short[alive], j, sizes):
                rows = np.flatnonzero(hit)
                if not len(rows):
                    break
                place = at[rows]
                byte = self.data[begin[rows] + (place >> 3)]
                hit[rows] = (byte >> (7 - (place & 7)).astype(np.uint8)) & 1
            alive = alive[hit]
            level[alive] = j
        return level


def shard_starts(pieces: DataFrame, bits: int, most: int = SHARD_BYTES) -> np.ndarray:
    """First segment of each shard; a shard has at most ``most`` bytes, or one segment.
    The driver reads the segments' sizes, not the filter."""
    sizes = {r["segment"]: r["size"] for r in pieces.select("segment", "size").collect()}
    starts, held = [0], 0
    for segment in range(1 << bits):
        wide = -(-sizes.get(segment, 0) // 8)
        if held and held + wide > most:
            starts.append(segment)
            held = 0
        held += wide
    return np.array(starts, dtype=np.int64)


def load_shard(pieces: DataFrame, bits: int, first: int, end: int) -> Shard:
    """Segments ``first`` to ``end``, exclusive."""
    start, size = np.zeros(end - first, dtype=np.int64), np.zeros(end - first, dtype=np.int64)
    parts, at = [], 0
    found = pieces.where((F.col("segment") >= first) & (F.col("segment") < end)).toArrow()
    for segment, bits_, part in zip(*(found.column(c) for c in ("segment", "size", "part")), strict=True):
        place = segment.as_py() - first
        start[place], size[place] = at, bits_.as_py()
        parts.append(np.frombuffer(part.as_buffer(), dtype=np.uint8))
        at += len(parts[-1])
    return Shard(bits, first, start, size, np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8))


def _shift(bits: int) -> np.uint64:
    """A bigram is told by its segment's bits and 32 more; the rest of its hash goes."""
    return np.uint64(max(0, 32 - bits))


def bigram_levels(table: DataFrame, pieces: DataFrame, bits: int, starts: np.ndarray) -> DataFrame:
    """chunk, levels: levels of each chunk's distinct bigrams in the order of their
    hashes, as one packed part per shard.

    A chunk's distinct bigrams are written once, each under its shard. A shard is
    broadcast, its own bigrams are probed, the levels are written and the broadcast is
    destroyed before the next: the driver and each worker hold one shard, and all passes
    together read the bigrams once, however many shards there are."""
    spark = table.sparkSession
    sent_schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary())])
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("levels", pa.binary())])
    shift = _shift(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = np.unique(_Chunk.of(batch, i).bigrams() >> shift)
                at = np.searchsorted(_segment_of(keys << shift, bits), [*starts, 1 << bits])
                spans = [(s, a, b) for s, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
                yield as_batch({
                    "shard": [s for s, _, _ in spans], "chunk": [column(batch, "chunk")[i].as_py()] * len(spans),
                    # sorted keys travel as differences
                    "keys": [_squeeze(np.diff(keys[a:b], prepend=np.uint64(0)), 8) for _, a, b in spans],
                }, sent_schema)

    def probe(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [np.cumsum(_expand(k, 8), dtype=np.uint64) for k in column(batch, "keys").to_pylist()]
                yield as_batch({
                    "shard": column(batch, "shard"), "chunk": column(batch, "chunk"),
                    "levels": [_squeeze(shared.value.level(k << shift), 1) for k in keys],
                }, schema)

        return run

    path = scratch_path(spark, "lm-bigrams")
    sent = table.select("chunk", "lengths", "train", "words", "codes").mapInArrow(send, "shard long, chunk long, keys binary")
    sent.write.partitionBy("shard").option("compression", "uncompressed").parquet(path)
    sent = spark.read.schema("chunk long, keys binary, shard long").parquet(path)
    target = scratch_path(spark, "lm-levels")
    for number, (first, end) in enumerate(zip(starts, [*starts[1:], 1 << bits], strict=True)):
        shared = spark.sparkContext.broadcast(load_shard(pieces, bits, int(first), int(end)))
        found = sent.where(F.col("shard") == number).mapInArrow(probe(shared), "shard long, chunk long, levels binary")
        found.write.mode("append").parquet(target)
        shared.destroy()
    discard(spark, path)
    levels = spark.read.schema("shard long, chunk long, levels binary").parquet(target)
    ordered = F.sort_array(F.collect_list(F.struct("shard", "levels")))
    return levels.groupBy("chunk").agg(F.transform(ordered, lambda s: s["levels"]).alias("levels"))


def _level_of_tokens(chunk: _Chunk, bits: int, packed: list[bytes]) -> np.ndarray:
    _, where = np.unique(chunk.bigrams() >> _shift(bits), return_inverse=True)
    return np.concatenate([_expand(part, 1) for part in packed]).astype(np.int64)[where]


@dataclass(frozen=True)
class _Counts:
    """Per token of a chunk: count, unigram probability, count of its context."""

    count: np.ndarray
    p1: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, chunk: _Chunk, totals: list[bytes], n: int, v: int, begins: int) -> _Counts:
        per_word = np.empty(len(chunk.words))
        per_word[np.argsort(chunk.words)] = np.concatenate([np.frombuffer(t, dtype=np.uint32) for t in totals])
        count = per_word[chunk.codes]
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[chunk.first()] = begins
        return cls(count, (count + 1) / (n + v + 1), context)

    def bucket(self) -> np.ndarray:
        return np.minimum(BUCKETS - 1, np.log2(self.context + 1).astype(np.int64))


def _estimate(level: np.ndarray, least: int, base: float) -> np.ndarray:
    """Mean count of a level if logarithms of counts are spread evenly over its whole
    numbers; a level of one count has that count."""
    means = [0.0]
    for j in range(1, int(level.max(initial=0)) + 1):
        low, high = (math.ceil(least * base**i - 1e-6) for i in (j - 1, j))
        if high - low > 1000:  # as good as continuous
            means.append(least * base ** (j - 1.0) * (base - 1) / math.log(base))
        else:
            counts = np.arange(low, max(high, low + 1))
            means.append(len(counts) / (1 / counts).sum())
    return np.array(means)[level]


def score(
    docs: DataFrame, modulus: int = 7, rest: int = 2, least: int = LEAST_COUNT, base: float = BASE,
    shard_bytes: int = SHARD_BYTES, segment_keys: int = SEGMENT_KEYS, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The texts
    whose crc32(doc_id as text) mod ``modulus`` is ``rest`` are not learnt from."""
    spark = docs.sparkSession
    table = materialize(chunks(docs, modulus, rest, chunk_chars), "lm-chunks")
    learnt = F.size(F.filter("train", lambda t: t))
    sums = table.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w"), F.sum(learnt).alias("b")).first()
    tokens, begins = sums["t"] or 0, sums["b"] or 0
    totals, whole = unigram_totals(table, _segments(sums["w"] or 0, segment_keys))
    n, v = whole.first()
    bits = _segments(tokens, segment_keys)
    filter_path = scratch_path(spark, "lm-filter")
    bigram_filter(table, bits, least, base).write.parquet(filter_path)
    pieces = spark.read.schema("segment long, size long, part binary").parquet(filter_path)
    starts = shard_starts(pieces, bits, shard_bytes)
    levels = bigram_levels(table, pieces, bits, starts)
    discard(spark, filter_path)
    joined = materialize(table.drop("n_words").join(totals, "chunk").join(levels, "chunk"), "lm-counted")

    def counted(batch: pa.RecordBatch, i: int) -> tuple[_Chunk, _Counts, np.ndarray]:
        chunk = _Chunk.of(batch, i)
        level = _level_of_tokens(chunk, bits, column(batch, "levels")[i].as_py())
        return chunk, _Counts.of(chunk, column(batch, "totals")[i].as_py(), n, v, begins), level

    grid = np.array(WEIGHTS)
    trial_schema = pa.schema([("bucket", pa.int32()), ("weight", pa.int32()), ("gain", pa.float64())])

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros((BUCKETS, len(grid)))
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, c, level = counted(batch, i)
                rows = np.flatnonzero(np.repeat(chunk.train, chunk.lengths))
                level = level[rows]
                # without the token's own occurrence; at the filter's edge a count falls out
                rest_ = np.where(level > (least > 1), np.maximum(0.0, _estimate(level, least, base) - 1), 0.0)
                own = np.minimum(1.0, rest_ / np.maximum(1.0, c.context[rows] - 1))
                ratio = own / np.maximum(c.count[rows] / (n + v), 1e-300)
                where = c.bucket()[rows]
                for g, a in enumerate(grid):
                    gain[:, g] += np.bincount(where, weights=np.log10((1 - a) + a * ratio), minlength=BUCKETS)
        yield as_batch({
            "bucket": np.repeat(np.arange(BUCKETS), len(grid)), "weight": np.tile(np.arange(len(grid)), BUCKETS),
            "gain": gain.ravel(),
        }, trial_schema)

    gains = np.zeros((BUCKETS, len(grid)))
    tried = joined.mapInArrow(trial, "bucket int, weight int, gain double")
    for r in tried.groupBy("bucket", "weight").agg(F.sum("gain").alias("gain")).collect():
        gains[r["bucket"], r["weight"]] += r["gain"]
    chosen = grid[gains.argmax(axis=1)]

    out_schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, c, level = counted(batch, i)
                own = np.minimum(1.0, _estimate(level, least, base) / np.maximum(1.0, c.context))
                a = chosen[c.bucket()]
                first = chunk.first()
                yield as_batch({
                    "doc_id": column(batch, "doc_ids")[i].as_py(), "held_out": ~chunk.train,
                    "n_tokens": chunk.lengths,
                    "n_known": np.add.reduceat((c.count > 0).astype(np.int64), first),
                    "train_tokens": [n] * len(first),
                    "base_score": np.add.reduceat(np.log10(c.p1), first),
                    "score": np.add.reduceat(np.log10(a * own + (1 - a) * c.p1), first),
                }, out_schema)

    return joined.mapInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
