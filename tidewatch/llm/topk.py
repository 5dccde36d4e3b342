"""Exact top-k inner products: columnar branch and bound.

Vectors become whole numbers, floor(256 * x). Candidates are dealt into blocks, each
stored dimension by dimension (vertical layout), with the mass (Euclidean norm) that
is left behind every dimension block. Some queries walk a block one dimension block at a
time: scores accumulate for all of them and all candidates at once, the query's and the
candidate's left-over masses bound what can still come (Cauchy-Schwarz), pairs that cannot
reach the query's k-th best lower bound are out, and candidates and queries without a pair
left are compacted away. The last survivors have exact scores.

Queries are a stated set of rows. They are sent to every candidate block as single rows,
behind the block's candidates in one sorted stream, so a task holds one block of
candidates and some queries at a time; nothing is joined, and no side is broadcast.
Per query and candidate block k rows are left for the final ranking.

Defined cases: a vector that is null or holds a null or non-finite component takes no
part; vectors of different lengths meet as if padded with zeros (an empty one scores
0); ties go to the smaller vec_id; a row with a null vec_id takes no part (it could
not be named); rows of the query's own vec_id are not its candidates, repeated rows
of another vec_id each count; a query that is repeated with the same vector asks once.
Further columns are ignored. An empty table gives no
rows. Sums that could pass 2**53 are computed on integers of any size, and a score
beyond the range of long raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column

PART = 1024  # candidates compared at once: their components stay in a core's cache
CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 256
DIMENSION_BLOCK = 16
SCALE = 256

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, scale: int = SCALE, *more: Column) -> DataFrame:
    """vec_id, v (array of long) and ``more``; only vectors that take part."""
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(values, lambda x: F.floor(x * scale).cast("long")).alias("v"), *more,
        )
    )


def _side(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and components with one row per dimension (padded with zeros)."""
    table = pa.Table.from_batches(rows)
    vectors = table["v"].combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    wide = np.arange(int(lengths.max(initial=0)))[None, :] < lengths[:, None]
    matrix = np.zeros(wide.shape, dtype=np.int64)
    matrix[wide] = vectors.flatten().to_numpy(zero_copy_only=False)
    return table["vec_id"].to_numpy(), np.ascontiguousarray(matrix.T)


def _masses(matrix: np.ndarray, step: int) -> np.ndarray:
    """Row b: norm of what lies behind b dimension blocks, rounded up."""
    squares = matrix.astype(np.float64) ** 2
    edges = list(range(0, matrix.shape[0], step)) + [matrix.shape[0]]
    rows = [squares[e:].sum(axis=0) for e in edges]
    return np.sqrt(np.array(rows)) * (1 + 1e-9)


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int,
    step: int = DIMENSION_BLOCK, least: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: vec_ids and scores of its k best in the block (ties by id). What
    cannot reach a query's ``least`` score may be left out."""
    width = max(queries.shape[0], block.shape[0])
    queries = np.pad(queries, ((0, width - queries.shape[0]), (0, 0)))
    block = np.pad(block, ((0, width - block.shape[0]), (0, 0)))
    left_q, left_c = _masses(queries, step), _masses(block, step)
    if not float(left_q[0].max(initial=0)) * float(left_c[0].max(initial=0)) < 2.0**52:
        yield from _best_of_large(query_ids, queries, ids, block, k)
        return
    queries, block = queries.astype(np.float64), block.astype(np.float64)
    edges = list(range(0, width, step)) + [width]
    asking, alive = np.arange(len(query_ids)), np.arange(len(ids))  # lines and columns of the table
    score = np.zeros((len(asking), len(alive)))
    out = query_ids[:, None] == ids[None, :]
    floor = np.full(len(asking), -np.inf) if least is None else least.astype(np.float64)
    for b in range(len(edges) - 1):
        part = slice(edges[b], edges[b + 1])
        score += queries[part, asking].T @ block[part, alive]
        rest = np.outer(left_q[b + 1, asking], left_c[b + 1, alive])
        if len(alive) > k and not np.isfinite(floor[asking]).all():
            low = np.where(out, -np.inf, score - rest)
            nth = len(alive) - k
            floor[asking] = np.maximum(floor[asking], np.partition(low, nth, axis=1)[:, nth])
        out |= score + rest < floor[asking, None]
        lines, columns = ~out.all(axis=1), ~out.all(axis=0)
        if lines.mean() < 0.75 or columns.mean() < 0.75:
            asking, alive = asking[lines], alive[columns]
            score, out = score[np.ix_(lines, columns)], out[np.ix_(lines, columns)]
        if not len(asking):
            break
    place = dict(zip(asking.tolist(), range(len(asking)), strict=True))
    for q, query_id in enumerate(query_ids):
        left = np.flatnonzero(~out[place[q]]) if q in place else np.zeros(0, dtype=np.int64)
        exact = score[place[q], left].astype(np.int64) if len(left) else left
        order = np.lexsort((ids[alive[left]], -exact))[:k]
        yield int(query_id), ids[alive[left[order]]], exact[order]


def _best_of_large(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int):
    """The same on integers of any size."""
    queries, block = queries.astype(object), block.astype(object)
    for q, query_id in enumerate(query_ids):
        alive = np.flatnonzero(ids != query_id)
        score = queries[:, q].dot(block[:, alive]) if len(queries) else np.zeros(len(alive), dtype=object)
        exact = np.array([int(s) for s in score], dtype=object)
        order = np.array(sorted(range(len(alive)), key=lambda i: (-exact[i], ids[alive[i]]))[:k], dtype=np.int64)
        yield int(query_id), ids[alive][order], exact[order]


def best_of_parts(
    query_ids: np.ndarray, queries: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], k: int,
) -> Iterator[tuple[int, list[int], list[int]]]:
    """``best_of_block`` over blocks one after another; the k-th best score so far goes on
    to the next."""
    held: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    for ids, block in parts:
        least = np.array([float(h[-1][0]) if len(h) == k else -np.inf for h in held])
        found = best_of_block(query_ids, queries, ids, block, k, least=least)
        for q, (_, best, scores) in enumerate(found):
            if len(best):
                more = held[q] + list(zip(scores.tolist(), best.tolist(), strict=True))
                held[q] = sorted(more, key=lambda e: (-e[0], e[1]))[:k]
    for query_id, h in zip(query_ids, held, strict=True):
        yield int(query_id), [i for _, i in h], [s for s, _ in h]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Pieces of a sorted stream that lie in one block and on one side."""
    for batch in batches:
        block, asks = (column(batch, n).to_numpy(zero_copy_only=False) for n in ("block", "asks"))
        changes = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
        edges = [0, *changes, batch.num_rows] if batch.num_rows else []
        for first, end in zip(edges, edges[1:], strict=False):
            yield int(block[first]), bool(asks[first]), batch.slice(first, end - first)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, candidate_block: int | None = None,
    query_block: int = QUERY_BLOCK, scale: int = SCALE,
) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is over vec_id. Blocks of candidates are
    as large as leaves every core some, between ``PART`` and ``CANDIDATE_BLOCK``."""
    rows = quantised(vectors, scale)
    count = rows.count()
    if candidate_block is None:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        candidate_block = min(CANDIDATE_BLOCK, max(PART, -(-count // (3 * cores))))
    groups = max(1, -(-count // candidate_block))
    deal = F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.lit(groups))
    candidates = rows.select(deal.alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.where(is_query).select("vec_id", "v").distinct()
    # every query goes to every block of candidates: the stated set against all rows
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    asked = queries.select(everywhere.alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    met = candidates.unionByName(asked).repartition(groups, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, parts = None, [], []
        for number, asks, piece in _runs(batches):
            if number != at:
                at, held, parts = number, [], []
            if not asks:
                # a slice would keep the whole batch it was cut from
                held.append(pa.concat_batches([piece]) if piece.num_rows else piece)
                continue
            if not held:
                continue
            if not parts:
                ids, block = _side(held)
                cut = [slice(i, i + PART) for i in range(0, len(ids), PART)]
                parts = [(ids[c], np.ascontiguousarray(block[:, c])) for c in cut]
                held = held[:1]
            for first in range(0, piece.num_rows, query_block):
                query_ids, wanted = _side([piece.slice(first, query_block)])
                out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
                for query_id, best, scores in best_of_parts(query_ids, wanted, parts, k):
                    out["query_id"].extend([query_id] * len(best))
                    out["vec_id"].extend(best)
                    out["score"].extend(scores)
                yield as_batch(out, _OUT)

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
