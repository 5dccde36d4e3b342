"""Random forests grown level by level, all trees in the same passes over the rows.

A level takes one pass: tasks route their rows through every tree and count them per open
node, drawn feature, bin and class; one exchange brings the counts of a tree together,
where the best cut of each node is found. The driver sees one row per tree and level, so a
forest costs as many passes as it is deep, whatever the number of trees.

A tree's bootstrap is a Poisson count drawn by a hash of row, seed and tree, the features of
a node by a hash of seed, tree and node; counts are whole numbers, so for given bins forests
do not depend on the partitioning. Features are cut into at most ``BINS`` bins at sketched
quantiles of the training rows. A node ends when it is pure, when no cut lowers the weighted
Gini impurity, or at the depth limit. Classes are balanced over all training rows. A score is
the mean of the trees' weighted class shares; two leaves of one node that call the same class
are one leaf, as in MLlib. Equal cuts go to the smaller feature and bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.learning.boosting import bin_edges, mixed
from tidewatch.session import materialize, spread

BINS = 32
ROWS = 1 << 14  # routed at once: they stay in a core's cache
NO_CUT = np.iinfo(np.uint8).max
LEAST_GAIN = 1e-12  # of a node's weight; less is rounding
_COUNTS = "tree int, counts binary"
_CUTS = "tree int, features binary, bins binary, left binary, total binary"

# how often a row is drawn, by the first 16 bits of its hash
_SHARES = np.cumsum([exp(-1.0) / factorial(i) for i in range(9)])
_DRAWS = np.searchsorted(_SHARES, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def drawn(keys: np.ndarray, tree: int) -> np.ndarray:
    """Poisson counts of a tree's bootstrap; ``keys`` are hashes of row and seed."""
    with np.errstate(over="ignore"):
        h = (keys + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return _DRAWS[(h >> np.uint64(48)).astype(np.intp)]


def seeded(keys: np.ndarray, seed: int) -> np.ndarray:
    return (mixed(keys, seed) * float(1 << 53)).astype(np.uint64)


def node_features(width: int, seed: int, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features each node may use, a line per node in rising order."""
    each = min(width, ceil(sqrt(width)))
    order = mixed((nodes[:, None] * width + np.arange(width)).ravel(), seed, tree, 2).reshape(len(nodes), width)
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :each], axis=1)


@dataclass
class ForestModel:
    """Complete binary trees as arrays, a line per tree: the children of node n are 2n + 1 and
    2n + 2. ``NO_CUT`` sends every row left, so a leaf's share is that of its leftmost heir."""

    features: np.ndarray
    cuts: np.ndarray
    shares: np.ndarray
    edges: list[np.ndarray]
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        flat = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)
        flat, width = flat.astype(np.uint8).ravel(), x.shape[1]
        total = np.zeros(len(x))
        for first in range(0, len(x), ROWS):
            base = np.arange(first, min(first + ROWS, len(x))) * width
            for features, cuts, shares in zip(self.features, self.cuts, self.shares, strict=True):
                total[first : first + ROWS] += shares.take(routed(flat, base, features, cuts, self.depth))
        return total / len(self.features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, a vector like those of MLlib's classifiers."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            return pd.Series(shared.value.scores(np.stack(features.to_numpy())))

        p = F.col("_score")
        return df.withColumn("_score", score(vector_to_array("features"))).withColumn(
            "probability", array_to_vector(F.array(F.lit(1.0) - p, p))
        ).drop("_score")


def routed(flat: np.ndarray, base: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
    """The node every row reaches after so many levels. ``flat`` has the bins row by row,
    ``base`` says where a row begins."""
    node = np.zeros(len(base), dtype=np.intp)
    for _ in range(levels):
        right = flat.take(base + features.take(node)) > cuts.take(node)
        node = 2 * node + 1 + right
    return node


def _packed(train: DataFrame, edges: list[np.ndarray], seed: int) -> DataFrame:
    """The training rows as blocks of bins, classes and hashes, dealt over all cores."""
    shared = train.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y, x = batch.columns
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(shared.value))
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(shared.value)], axis=1)
            block = [bins.astype(np.uint8), y.to_numpy().astype(np.uint8), seeded(key.to_numpy(), seed)]
            columns = [pa.array([part.tobytes()], pa.binary()) for part in block]
            yield pa.RecordBatch.from_arrays(columns, names=["bins", "y", "key"])

    rows = train.select(F.xxhash64("id").alias("key"), F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x"))
    packed = spread(rows, "key").mapInArrow(run, "bins binary, y binary, key binary")
    return materialize(packed, "forest")


def _counts(features, cuts, open_nodes, seed, width, bins, level):
    """A task's counts: one row per tree with (node, drawn feature, bin, class)."""
    first = (1 << level) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, y, keys = _joined(batches)
        for tree, nodes in enumerate(open_nodes):
            if not len(nodes):
                continue
            picks = node_features(width, seed, tree, nodes).T.copy()
            slots = np.full(1 << level, -1, dtype=np.intp)
            slots[nodes - first] = np.arange(len(nodes))
            size = len(picks) * bins * 2
            counts = np.zeros(len(nodes) * size)
            step = max(ROWS, len(counts))  # many cells are worth adding up for many rows only
            for begin in range(0, len(y), step):
                draws = drawn(keys[begin : begin + step], tree)
                rows = np.flatnonzero(draws)
                base = (rows + begin) * width
                slot = slots.take(routed(flat, base, features[tree], cuts[tree], level) - first)
                inside = np.flatnonzero(slot >= 0)
                if len(inside) < len(slot):
                    slot, base, rows = slot[inside], base[inside], rows[inside]
                weight = draws[rows].astype(np.float64)
                cell = slot * size + y[begin : begin + step].take(rows)
                for j, pick in enumerate(picks):
                    b = flat.take(base + pick.take(slot)).astype(np.intp)
                    counts += np.bincount(cell + 2 * (j * bins + b), weight, len(counts))
            yield pa.RecordBatch.from_arrays([
                pa.array([tree], pa.int32()), pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
            ], names=["tree", "counts"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of a task behind one another."""
    parts: list[list[bytes]] = [[], [], []]
    for batch in batches:
        for part, column in zip(parts, batch.columns, strict=True):
            part.extend(column.to_pylist())
    kinds = (np.uint8, np.uint8, np.uint64)
    return tuple(np.frombuffer(b"".join(p), dtype=k) for p, k in zip(parts, kinds, strict=True))


def best_cuts(counts: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """(drawn feature, bin, left counts, total counts) per node from (node, drawn feature, bin,
    class); the feature is -1 where a node ends."""
    left = counts.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = left[:, :, -1:, :] - left

    def purity(side: np.ndarray) -> np.ndarray:
        w = side * np.array(weights)
        whole = w.sum(axis=-1)
        return np.divide((w * w).sum(axis=-1), whole, out=np.zeros(whole.shape), where=whole > 0)

    gain = purity(left) + purity(right) - purity(total)
    able = (left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0)
    able &= gain > LEAST_GAIN * (total * np.array(weights)).sum(axis=-1)
    gain = np.where(able, gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)  # the first of equals
    line = np.arange(len(counts))
    feature, at = np.divmod(best, counts.shape[2])
    pure = (total[:, 0, 0] == 0).any(axis=-1)
    return np.where((gain[line, best] > 0) & ~pure, feature, -1), at, left[line, feature, at], total[:, 0, 0]


def _best(cells: DataFrame, trees: int, each: int, bins: int, weights: tuple[float, float]) -> DataFrame:
    """One row per tree with the best cut of every open node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = np.frombuffer(raw, dtype=np.int64)
                sums[tree] = sums[tree] + table if tree in sums else table
        for tree, table in sums.items():
            found = best_cuts(table.reshape(-1, each, bins, 2), weights)
            columns = [pa.array([part.astype(np.int64).tobytes()], pa.binary()) for part in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree], pa.int32()), *columns], names=["tree", "features", "bins", "left", "total"])

    tasks = min(trees, 4 * cells.sparkSession.sparkContext.defaultParallelism)
    return cells.repartition(tasks, "tree").mapInArrow(run, _CUTS)


def grow_forest(train: DataFrame, width: int, trees: int, depth: int, seed: int) -> ForestModel:
    """A forest from (id, y, features)."""
    edges = bin_edges(train, width, BINS)
    bins = max(len(e) for e in edges) + 1
    counted = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    n = [counted.get(c, 0) for c in (0, 1)]
    weights = tuple(sum(n) / (2.0 * c) if c else 0.0 for c in n)
    blocks = _packed(train, edges, seed)
    size = (1 << (depth + 1)) - 1
    features, cuts = np.zeros((trees, size), dtype=np.intp), np.full((trees, size), NO_CUT, dtype=np.uint8)
    shares = np.zeros((trees, size))
    open_nodes = [np.zeros(1, dtype=np.intp) for _ in range(trees)]
    each = min(width, ceil(sqrt(width)))

    def share(count: np.ndarray) -> np.ndarray:
        w = count * np.array(weights)
        whole = w.sum(axis=1)
        return np.divide(w[:, 1], whole, out=np.zeros(len(w)), where=whole > 0)

    for level in range(depth):
        above = slice(0, (1 << level) - 1)
        work = _counts(features[:, above].copy(), cuts[:, above].copy(), open_nodes, seed, width, bins, level)
        found = _best(blocks.mapInArrow(work, _COUNTS), trees, each, bins, weights).collect()  # a row per tree
        opened = [np.zeros(0, dtype=np.intp) for _ in range(trees)]
        for r in found:
            tree, nodes = r["tree"], open_nodes[r["tree"]]
            pick, at = (np.frombuffer(r[c], dtype=np.int64) for c in ("features", "bins"))
            left, total = (np.frombuffer(r[c], dtype=np.int64).reshape(-1, 2) for c in ("left", "total"))
            shares[tree, nodes] = share(total)
            cut = np.flatnonzero(pick >= 0)
            listed = node_features(width, seed, tree, nodes)
            features[tree, nodes[cut]] = listed[cut, pick[cut]]
            cuts[tree, nodes[cut]] = at[cut]
            right = total[cut] - left[cut]
            shares[tree, 2 * nodes[cut] + 1], shares[tree, 2 * nodes[cut] + 2] = share(left[cut]), share(right)
            opened[tree] = np.sort(np.concatenate([
                2 * nodes[cut[(side > 0).all(axis=1)]] + 1 + i for i, side in enumerate((left[cut], right))
            ]))
        open_nodes = opened
        if not any(len(nodes) for nodes in open_nodes):
            break
    for level in reversed(range(depth)):  # two leaves that call the same class become one, as in MLlib
        nodes = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
        left, right = 2 * nodes + 1, 2 * nodes + 2
        leaves = np.ones((trees, len(nodes)), dtype=bool) if level + 1 == depth else (
            (cuts[:, left] == NO_CUT) & (cuts[:, right] == NO_CUT))
        one = leaves & ((shares[:, left] > 0.5) == (shares[:, right] > 0.5))
        cuts[:, nodes], features[:, nodes] = np.where(one, NO_CUT, cuts[:, nodes]), np.where(one, 0, features[:, nodes])
    for level in range(depth):  # a leaf's share goes down to where its rows end
        nodes = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
        ends = cuts[:, nodes] == NO_CUT
        shares[:, 2 * nodes + 1] = np.where(ends, shares[:, nodes], shares[:, 2 * nodes + 1])
    return ForestModel(features, cuts, shares, edges, depth)
