"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit. Pieces (documents; longer ones cut at the capacity) and
the gaps of open sequences are kept sorted by size. A size is a whole number of at
most ``capacity`` tokens, so a sorted range is a size with ranks from 0: pieces of one
size are alike, and so are gaps of sequences filled alike. A round sweeps both sorted
sides at once: every size of pieces finds its successor, the smallest gap that holds
it; where pieces and gaps compete, ranks decide: the largest pieces take the gaps
first, rank r of the pieces gets rank r of the gaps. Then the gaps shrink, are sorted
again, and the next round begins; where no gap holds any piece left, the largest
ones open new sequences.

Rows never move for this. Spark counts the pieces per size, the rounds run over runs
(a size, a stretch of sequence numbers), whose number depends on the capacity and not
on the corpus, and Spark then ranks the pieces within their sizes and looks up the
stretch that holds each rank. Ranks use salted groups, so a size that a third of all
pieces share is spread out.

Defined cases: a null text counts as empty and holds the end id alone; repeated
doc_ids are packed row by row; a null doc_id is packed like any other; an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import column, map_batches, text_list, texts_of
from tidewatch.llm.tokens import piece_encoder
from tidewatch.session import materialize

CAPACITY = 2048
# Groups into which a size is dealt for ranking.
SALTS = 64

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece; with ``ids`` also the piece's ids, packed as u32."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def make():
        encode = piece_encoder(tokenizer).encode

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids")}
            for key, text in zip(column(batch, "doc_id").to_pylist(), text_list(batch), strict=True):
                packed = encode(text) + end
                whole = zlib.crc32(packed)
                for at in range(0, len(packed), width):
                    part = packed[at : at + width]
                    out["doc_id"].append(key)
                    out["piece"].append(at // width)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["salt"].append((whole ^ (key or 0) * 0x9E3779B1 ^ at) % SALTS)
                    if ids:
                        out["ids"].append(part)
            return out

        return step

    return map_batches(texts_of(docs), PIECE_SCHEMA + (", ids binary" if ids else ""), make)


@dataclass(frozen=True)
class Placement:
    """Ranks first..first+count-1 of the pieces of one size: piece number j of them
    goes to sequence ``sequence + j // each`` at ``offset + (j % each) * length``."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements of all pieces, and the number of sequences."""
    left = {size: n for size, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size: stretches (first sequence, how many)
    placed: list[Placement] = []
    opened = 0

    def put(size: int, each: int, wide: int, sequence: int, gap: int, after: dict) -> None:
        """``each`` pieces into each of ``wide`` sequences."""
        count = each * wide
        placed.append(Placement(size, taken[size], count, each, sequence, capacity - gap))
        taken[size] += count
        left[size] -= count
        if left[size] == 0:
            del left[size]
        if gap > each * size:
            after.setdefault(gap - each * size, []).append((sequence, wide))

    while left:
        after: dict[int, list[tuple[int, int]]] = {}
        sizes = sorted(gaps)
        for size in sorted(left, reverse=True):
            at = bisect.bisect_left(sizes, size)
            while size in left and at < len(sizes):
                gap = sizes[at]
                stretches = gaps[gap]
                while size in left and stretches:
                    sequence, wide = stretches.pop()
                    each = min(gap // size, max(1, left[size] // wide))
                    use = min(wide, left[size] // each)
                    if use < wide:
                        stretches.append((sequence + use, wide - use))
                    put(size, each, use, sequence, gap, after)
                if not stretches:
                    sizes.pop(at)
        if not after and left:
            # no gap holds a piece: the largest size opens sequences
            size = max(left)
            each = capacity // size
            wide, over = divmod(left[size], each)
            if wide:
                put(size, each, wide, opened, capacity, after)
                opened += wide
            if over:
                put(size, over, 1, opened, capacity, after)
                opened += 1
        for gap, stretches in gaps.items():
            if stretches:
                after.setdefault(gap, []).extend(stretches)
        gaps = after
    return placed, opened


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (``pieces``, written once, as it
    is read three times)."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = plan(counts, capacity)
    stretches: dict[int, list[Placement]] = {}
    for p in placed:
        stretches.setdefault(p.length, []).append(p)
    per_salt = found.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = per_salt.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    # at most capacity * SALTS rows, whatever the corpus
    ranked = (
        found.withColumn("rank", F.row_number().over(
            Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(F.broadcast(before), ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .drop("before", "salt")
    )
    shared = spark.sparkContext.broadcast({
        size: (
            np.array([p.first for p in ps]), np.array([p.each for p in ps]),
            np.array([p.sequence for p in ps]), np.array([p.offset for p in ps]),
        )
        for size, ps in stretches.items()
    })
    kept = [f for f in ranked.columns if f != "rank"]
    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.select(kept).dtypes) + ", sequence_id long, offset long"

    def make():
        table = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            sizes = column(batch, "length").to_numpy()
            ranks = column(batch, "rank").to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                first, each, begin, at = table[int(size)]
                hit = np.searchsorted(first, ranks[rows], side="right") - 1
                j = ranks[rows] - first[hit]
                sequence[rows] = begin[hit] + j // each[hit]
                offset[rows] = at[hit] + (j % each[hit]) * size
            return {n: column(batch, n) for n in kept} | {"sequence_id": sequence, "offset": offset}

        return step

    return map_batches(ranked, schema, make)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    found = materialize(pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(found, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def sequences(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens, ids (packed u32): the packed sequences themselves. A
    group is one sequence, at most ``capacity`` ids."""
    found = materialize(pieces(docs, tokenizer, end_id, capacity, ids=True), "pieces")
    placed = pack(found, capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )
