"""Phrase collocations per language, counted in quotient filters.

Texts become chunks: the word numbers of some documents of one language in order, and
the chunk's words with their counts. Words are counted over all chunks; those that are
frequent enough get ids and go back to the chunks that hold them. Tasks then count the
n-grams of their chunks in counting quotient filters (see ``counting_filter``: packed
ids, invertibly permuted, full remainders, so counts are exact), cut them into slices
of the key space, and slices of all tasks are merged. A frequent n-gram is one entry
per task, so no slice is hot. Joins of the frequent n-grams with their parts give the
scores.

A phrase can be frequent only if its words are, so n-grams with other words need no
counter. A task emits at most one row per slice, and never more rows than entries.

Defined cases: a null text counts as empty; a null lang is ``und``; rows count as often
as they stand there, whatever their doc_id; further columns are ignored; an empty
table, or one without frequent phrases, gives no rows; ties go to the smaller phrase in
UTF-8 byte order. A text may be of any length up to what a row can hold; it stays in
one chunk. Scores are computed on decimals of 38 digits, exact for counts below 10**16,
and raise beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.cumulative import global_rank
from tidewatch.llm import counting_filter
from tidewatch.llm.common import as_batch, column
from tidewatch.session import materialize

CHUNK_WORDS = 1 << 20
# Keys that a task holds before it hands its filter on, and keys aimed at in a slice.
TASK_KEYS = 1 << 22
SLICE_KEYS = 1 << 20
# A lang's phrases are ranked in so many shares first; what is left of them, at most the
# asked number each, is one sort.
LANG_SHARES = 64
NO_LANG = "und"
SCALE = 1_000_000

_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(_ENDS, _MARK * len(_ENDS))

_CHUNK_SCHEMA = "chunk long, lang string, words array<string>, counts array<long>, stream binary"
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int64())), ("stream", pa.binary()),
])
_SLICE = pa.schema([("slice", pa.int64()), ("filter", pa.binary())])
_GRAMS_SCHEMA = "w1 long, w2 long, w3 long, a long"
_GRAMS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("a", pa.int64())])


class _Numbers(dict):
    """Numbers of words from 1 in order of appearance; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Chunk:
    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        folded = text.encode("utf-8", "surrogatepass").lower().translate(_FOLD) + _MARK
        words = folded.replace(_MARK, b" " + _MARK + b" ").split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), "<u4", len(words)))
        return len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        stream = np.concatenate(self.parts)
        counts = np.bincount(stream, minlength=len(self.numbers))[1:]
        words = pa.array(list(self.numbers)[1:], pa.binary()).cast(pa.string())
        return as_batch({
            "chunk": [number], "lang": [lang], "words": pa.ListArray.from_arrays([0, len(words)], words),
            "counts": [counts], "stream": [stream.tobytes()],
        }, _CHUNK)


def chunked(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """chunk, lang, words, counts, stream (word numbers as little-endian u32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        open_chunks: dict[str, _Chunk] = {}
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            for lang, chunk in open_chunks.items():
                yield chunk.row(number, lang)
                number += 1
            open_chunks.clear()
            held = 0

        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                if lang not in open_chunks:
                    open_chunks[lang] = _Chunk()
                held += open_chunks[lang].add(text)
                if held >= chunk_words:
                    yield from close()
        yield from close()

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return texts.mapInArrow(run, _CHUNK_SCHEMA)


def count_ngrams(
    numbered: DataFrame, id_bits: int, slice_bits: int, least: int, task_keys: int = TASK_KEYS
) -> DataFrame:
    """w1, w2, w3 (0 for pairs), a >= least, from rows of stream and ids (place in the
    chunk's words, word id)."""
    space = counting_filter.Keys(id_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            keys, counts = counting_filter.merge(held)
            cut = counting_filter.slices(space, keys, counts, slice_bits)
            return as_batch({"slice": [n for n, _ in cut], "filter": [f for _, f in cut]}, _SLICE)

        for batch in batches:
            streams, ids = column(batch, "stream"), column(batch, "ids")
            for row in range(batch.num_rows):
                keys = _keys_of(space, np.frombuffer(streams[row].as_py(), "<u4"), ids[row].values)
                held.append(counting_filter.merge([(keys, np.ones(len(keys), dtype=np.int64))]))
                size += len(held[-1][0])
                if size > task_keys:
                    held = [counting_filter.merge(held)]
                    size = len(held[0][0])
                    if 2 * size > task_keys:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    def collect(table: pa.Table) -> pa.Table:
        parts = [counting_filter.loaded(f)[1:] for f in table.column("filter").to_pylist()]
        keys, counts = counting_filter.merge(parts)
        often = counts >= least
        a, b, c = (x.astype(np.int64) for x in space.unpack(keys[often]))
        return pa.Table.from_batches([as_batch({"w1": a, "w2": b, "w3": c, "a": counts[often]}, _GRAMS)])

    cut = numbered.select("stream", "ids").mapInArrow(count, "slice long, filter binary")
    return cut.groupBy("slice").applyInArrow(collect, _GRAMS_SCHEMA)


def _keys_of(space: counting_filter.Keys, stream: np.ndarray, pairs: pa.StructArray) -> np.ndarray:
    ids = np.zeros(int(stream.max(initial=0)) + 1, dtype=np.uint64)
    ids[pairs.field("place").to_numpy() + 1] = pairs.field("id").to_numpy()
    line = ids[stream]
    known = line > 0
    two = np.flatnonzero(known[:-1] & known[1:])
    three = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
    return np.concatenate([
        space.pack(line[two], line[two + 1], 0), space.pack(line[three], line[three + 1], line[three + 2])])


def _score(a: str, left: str, right: str) -> Column:
    exact = [f"cast({x} as decimal(16,0))" for x in (a, a, left, right)]
    return F.expr(f"({exact[0]} * {exact[1]} * cast({SCALE} as decimal(7,0))) div ({exact[2]} * {exact[3]})")


def candidates(grams: DataFrame, words: DataFrame) -> DataFrame:
    """w1, w2, w3, lang, phrase, a, l, r, score of all frequent phrases; of a phrase's
    cuts the lowest-scoring one, the first of equals."""
    def word(n: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{n}"), F.col("word").alias(f"t{n}"), F.col("f").alias(f"f{n}"))

    pairs = grams.where("w3 = 0").join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1"),
                                                    F.col("f").alias("f1")), "w1").join(word(2), "w2")
    two = pairs.select(
        "w1", "w2", "w3", "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"),
        F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))
    known = pairs.select("w1", "w2", "lang", "t1", "t2", "f1", F.col("a").alias("a12"))
    ends = grams.where("w3 = 0").select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    cut = (
        grams.where("w3 > 0").join(known, ["w1", "w2"]).join(ends, ["w2", "w3"]).join(word(3), "w3")
        .withColumns({"s1": _score("a", "f1", "a23"), "s2": _score("a", "a12", "f3")})
    )
    first = F.col("s1") <= F.col("s2")
    three = cut.select(
        "w1", "w2", "w3", "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a",
        F.when(first, F.col("f1")).otherwise(F.col("a12")).alias("l"),
        F.when(first, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def uncovered(found: DataFrame, share: int) -> DataFrame:
    """Candidates without a longer one around them that has ``share`` percent of their
    count. Longer ones count whether they are covered or not."""
    long = found.where("w3 > 0")
    longest = (
        long.select("w1", "w2", "a").unionAll(long.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2").agg(F.max("a").alias("around")).withColumn("w3", F.lit(0).cast("long"))
    )
    covered = F.coalesce(100 * F.col("around") >= share * F.col("a"), F.lit(False))
    return found.join(longest, ["w1", "w2", "w3"], "left").where(~covered).drop("around")


def mine(
    docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, chunk_words: int = CHUNK_WORDS,
    task_keys: int = TASK_KEYS, slice_keys: int = SLICE_KEYS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases of two or three words."""
    spark = docs.sparkSession
    chunks = materialize(chunked(docs, chunk_words), "phrase-chunks")
    counted = (
        chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
        .groupBy("lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f"))
    )
    counted = materialize(counted, "phrase-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = global_rank(counted.where(F.col("f") >= least), [F.desc("f"), "lang", "word"], "id")
    words = materialize(words, "phrase-word-ids")
    size = words.agg(F.max("id").alias("ids"), F.sum("f").alias("f")).first()
    id_bits = max(1, int(size["ids"] or 0).bit_length())
    keys = 2 * int(size["f"] or 0)
    slice_bits = min(counting_filter.Keys(id_bits).width, max(0, (keys // slice_keys).bit_length()))

    places = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    ids = (
        places.join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    )
    numbered = chunks.select("chunk", "stream").join(ids, "chunk")
    grams = materialize(count_ngrams(numbered, id_bits, slice_bits, least, task_keys), "phrase-ngrams")
    found = uncovered(materialize(candidates(grams, words), "phrase-candidates"), share)

    # the first rows of each share of a lang, each in a task of its own, then those of the lang
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(max(1000, top)))
    best = found.withColumn("share", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(LANG_SHARES)))
    for keys in (["lang", "share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
