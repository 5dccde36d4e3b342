"""Benchmark decontamination: BM25 over the test items, block-max WAND, verification.

An inverted index over the items (not the corpus) holds per term, a pair of neighbouring
words, its postings in item order, cut into blocks with their largest impact. Impacts are BM25 contributions as a
share of the item's own full score, so one threshold fits items of all lengths. Every
training text is cut into overlapping passages; each passage queries the index, and
every item whose share reaches ``THRESHOLD`` is found by block-max WAND. A found item
is verified in the passage: ``OVERLAP`` of its 5-word shingles must be there, and
``PART_OVERLAP`` of its question's and of its answer's.

Passages whose terms' largest impacts do not add up to the threshold have no pivot in
WAND; this is seen for all passages of a text at once, and the others are walked.

The index goes to the workers in shards of about ``SHARD_CHARS`` characters, one pass per
shard; the hits of a pass are written, and its broadcast is destroyed before the next. A
shard knows the document frequencies, the mean length and the longest item of the whole
benchmark, and hits of one document and item_id are joined after all passes, so rows do
not depend on the number of shards.

Question and answer: the answer is what follows the last sentence end (``.?!`` or a line
end) inside the item, and at least its last third of words. Shingles that reach into
the answer belong to it.

Defined cases: items with null or blank text match nothing; an item of fewer than five
words is one shingle of all of them; null and blank documents match nothing; repeated
documents give a row each; rows of one (document row, item_id) are joined to the best,
whether the items are equal or only their ids; empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column, text_list, texts_of, words_of
from tidewatch.session import materialize

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.75
PART_OVERLAP = 0.5
WIDTH = 5
POSTING_BLOCK = 16
LEAST_PASSAGE = 96  # words; at least twice the longest item of the benchmark
SHARD_CHARS = 8_000_000
_SENTENCE = re.compile(r"[.?!]\s+(?=\S)|\n+(?=\S)")


def parts_of(text: str) -> tuple[list[bytes], int]:
    """Words of an item and the number of the answer's first word."""
    words = words_of(text)
    stripped = text.strip()
    ends = [m.end() for m in _SENTENCE.finditer(stripped)]
    at = len(words_of(stripped[: ends[-1]])) if ends else len(words)
    return words, max(0, min(at, len(words) - max(1, len(words) // 3)))


def terms_of(words: list[bytes]) -> list:
    """Pairs of neighbours; of a single word the word."""
    return [a + b" " + b for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else words


def shingles(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    width = min(width, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if words else []


@dataclass
class Index:
    """Postings of one shard of items. ``df`` counts over all items."""

    items: list[tuple[int | None, str]]
    df: dict[bytes, int]
    n_items: int
    mean_length: float
    threshold: float = THRESHOLD
    postings: dict[bytes, list[tuple[int, float]]] = field(default_factory=dict)
    top: dict[bytes, float] = field(default_factory=dict)
    blocks: dict[bytes, list[tuple[int, float]]] = field(default_factory=dict)
    question: list[set] = field(default_factory=list)
    answer: list[set] = field(default_factory=list)
    longest: int = 0
    single: bool = False  # is there an item of one word?

    def __post_init__(self) -> None:
        shares: list[dict[bytes, float]] = []
        for number, (_, text) in enumerate(self.items):
            words, cut = parts_of(text)
            self.longest = max(self.longest, len(words))
            self.single |= len(words) == 1
            share = self._shares(words)
            shares.append(share)
            for term, impact in share.items():
                self.postings.setdefault(term, []).append((number, impact))
            grams = shingles(words)
            self.question.append(set(grams[: max(0, cut - WIDTH + 1)]))
            self.answer.append(set(grams[max(0, cut - WIDTH + 1) :]))
        for term, listed in self.postings.items():
            self.top[term] = max(i for _, i in listed)
            self.blocks[term] = [
                (listed[min(len(listed), a + POSTING_BLOCK) - 1][0], max(i for _, i in listed[a : a + POSTING_BLOCK]))
                for a in range(0, len(listed), POSTING_BLOCK)
            ]

    def _shares(self, words: list[bytes]) -> dict[bytes, float]:
        norm = K1 * (1 - B + B * len(words) / self.mean_length)
        raw = {
            t: math.log(1 + (self.n_items - self.df[t] + 0.5) / (self.df[t] + 0.5)) * n * (K1 + 1) / (n + norm)
            for t, n in Counter(terms_of(words)).items()
        }
        total = sum(raw.values())
        return {t: v / total for t, v in raw.items()}

    def search(self, terms: set[bytes]) -> list[tuple[int, float]]:
        """Items whose share of matched impact reaches the threshold, by block-max WAND."""
        edge = self.threshold - 1e-9
        cursors = [[0, t] for t in sorted(terms) if t in self.postings]
        found: list[tuple[int, float]] = []

        def item(c: list) -> int:
            return self.postings[c[1]][c[0]][0]

        def skip(c: list, to: int) -> bool:
            """Move to the first posting of an item >= to."""
            listed, blocks = self.postings[c[1]], self.blocks[c[1]]
            block = c[0] // POSTING_BLOCK
            while block < len(blocks) and blocks[block][0] < to:
                block += 1
            c[0] = max(c[0], block * POSTING_BLOCK)
            while c[0] < len(listed) and listed[c[0]][0] < to:
                c[0] += 1
            return c[0] < len(listed)

        def bound(c: list, at: int) -> tuple[float, int]:
            """Largest impact in the block that could hold ``at``, and the block's end."""
            for last, most in self.blocks[c[1]][c[0] // POSTING_BLOCK :]:
                if last >= at:
                    return most, last
            return 0.0, self.blocks[c[1]][-1][0]

        while cursors:
            cursors.sort(key=item)
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += self.top[c[1]]
                if total >= edge:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = item(cursors[pivot])
            while pivot + 1 < len(cursors) and item(cursors[pivot + 1]) == at:
                pivot += 1
            bounds = [bound(c, at) for c in cursors[: pivot + 1]]
            if sum(b for b, _ in bounds) < edge:
                to = min([last + 1 for _, last in bounds] + ([item(cursors[pivot + 1])] if pivot + 1 < len(cursors) else []))
                to = max(to, at + 1)
            elif item(cursors[0]) == at:
                score = sum(self.postings[c[1]][c[0]][1] for c in cursors[: pivot + 1])
                if score >= edge:
                    found.append((at, score))
                to = at + 1
            else:
                to = at
            cursors = [c for i, c in enumerate(cursors) if i > pivot or skip(c, to)]
        return found

    def passages(self, words: list[bytes]) -> Iterator[tuple[list[bytes], set[bytes]]]:
        """Overlapping passages, any of them at least twice as long as any item, whose
        distinct terms' maxima reach the threshold; with these terms."""
        half = max(LEAST_PASSAGE // 2, self.longest + 1)
        by_half: dict[int, set[bytes]] = defaultdict(set)
        for i, term in enumerate(terms_of(words)):
            if term in self.top:
                by_half[i // half].add(term)
        if self.single and len(words) > 1:
            for i, word in enumerate(words):
                if word in self.top:
                    by_half[i // half].add(word)
        for h in sorted({*by_half} | {h - 1 for h in by_half if h > 0}):
            terms = by_half.get(h, set()) | by_half.get(h + 1, set())
            if sum(self.top[t] for t in terms) >= self.threshold - 1e-9:
                yield words[h * half : (h + 2) * half + 1], terms

    def verified(self, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
        """Item number: share, question overlap, answer overlap; the best per item."""
        best: dict[int, tuple[float, float, float]] = {}
        for passage, terms in self.passages(words):
            grams: dict[int, set] = {}
            for number, share in self.search(terms):
                q, r = self.question[number], self.answer[number]
                width = len(next(iter(r)))
                if width not in grams:
                    grams[width] = set(shingles(passage, width))
                in_q, in_r = len(q & grams[width]), len(r & grams[width])
                answer = in_r / len(r)
                question = in_q / len(q) if q else answer
                if in_q + in_r >= OVERLAP * (len(q) + len(r)) and min(question, answer) >= PART_OVERLAP:
                    now = (share, question, answer)
                    best[number] = max(best.get(number, now), now, key=_better)
        return best


def _better(found: tuple[float, float, float]) -> tuple[float, ...]:
    return min(found[1:]), *found


def _joined(hits: DataFrame) -> DataFrame:
    """One row per document row and item_id, with the best of all its hits. Equal
    documents have equal hits, so a pass says how many of them there are."""
    keys = ["doc_id", "text_key", "item_id"]
    values = ["bm25_share", "question_overlap", "answer_overlap"]
    best = F.max(F.struct(F.least(*values[1:]).alias("least"), *values)).alias("best")
    passes = hits.groupBy(*keys, "shard").agg(best, F.count(F.lit(1)).alias("rows"))
    joined = passes.groupBy(*keys).agg(F.max("best").alias("best"), F.max("rows").alias("rows"))
    return joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        *keys, *[F.col(f"best.{v}").alias(v) for v in values]
    )


_HIT_SCHEMA = (
    "doc_id long, text_key long, item_id long, bm25_share double, question_overlap double, answer_overlap double"
)
_HITS = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("bm25_share", pa.float64()),
    ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [w for t in text_list(batch) for w in set(terms_of(words_of(t)))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["term"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def indexes(benchmark: DataFrame, shard_chars: int = SHARD_CHARS, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Shards of the index in turn; the driver holds one at a time."""
    items = _items(benchmark)
    count = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]++", " ")), " "))
    items = materialize(items.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_words", count), "items")
    sums = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.avg("n_words").alias("w"),
                     F.max("n_words").alias("longest")).first()
    if not sums["n"]:
        return
    shards = -(-sums["c"] // shard_chars)
    df = materialize(
        items.mapInArrow(_terms, "term binary").groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    for i in range(shards):
        mine = items.where(shard == i)
        words = mine.mapInArrow(_terms, "term binary").distinct()
        counts = {bytes(r["term"]): r["df"] for r in df.join(words, "term", "left_semi").collect()}
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Index(rows, counts, sums["n"], sums["w"], threshold, longest=sums["longest"])


def find(docs: DataFrame, benchmark: DataFrame, shard_chars: int = SHARD_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and item that it holds: doc_id, text_key (xxhash64 of
    the text), item_id, bm25_share, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    rows = texts_of(docs).withColumn("text_key", F.xxhash64("text"))

    def finder(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                out: dict[str, list] = {n: [] for n in _HITS.names}
                keys, texts = column(batch, "doc_id").to_pylist(), column(batch, "text_key").to_pylist()
                for key, text_key, text in zip(keys, texts, text_list(batch), strict=True):
                    best: dict[int | None, tuple[float, float, float]] = {}
                    for number, values in index.verified(words_of(text)).items():
                        name = index.items[number][0]
                        best[name] = max(best.get(name, values), values, key=_better)
                    for name, values in best.items():
                        for field_, value in zip(_HITS.names, (key, text_key, name, *values), strict=True):
                            out[field_].append(value)
                yield as_batch(out, _HITS)

        return run

    hits = spark.createDataFrame([], _HIT_SCHEMA + ", shard int")
    for number, index in enumerate(indexes(benchmark, shard_chars, threshold)):
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(finder(shared), _HIT_SCHEMA).withColumn("shard", F.lit(number))
        hits = hits.unionAll(materialize(found, "leaks"))
        shared.destroy()
    return _joined(hits)
