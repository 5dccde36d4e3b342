"""Level-wise forests against a plain grower that works node by node."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.learning import boosting, forest, matrix, training

NAMES = ["a", "b", "c", "d", "e"]


def data(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    x[:, 2] = np.round(x[:, 2])  # repeated values
    return x, ((np.abs(x[:, 0]) > 1) ^ (x[:, 1] > 0.8) ^ (rng.random(n) < 0.1)).astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = data()
    listed = [(i, i % 49 + 1, int(y[i]), *map(float, x[i])) for i in range(len(y))]
    frame = spark.createDataFrame(listed, "id long, step int, y int, " + ", ".join(f"{c} double" for c in NAMES))
    return matrix.assemble(frame.repartition(3), NAMES, training.KEEP).persist()


def plain_tree(bins, y, draws, weights, seed, tree, depth, sizes):
    """Weighted class share of every row's leaf."""
    out = np.zeros(len(y))

    def purity(mine):
        w = [weights[c] * draws[mine][y[mine] == c].sum() for c in (0, 1)]
        return sum(v * v for v in w) / sum(w) if sum(w) else 0.0

    def grow(mine, node, level):
        """(is a leaf, calls 1) after the rows' shares are set."""
        counts = [draws[mine][y[mine] == c].sum() for c in (0, 1)]
        best = None
        if level < depth and min(counts) > 0:
            for f in forest.node_features(bins.shape[1], seed, tree, np.array([node]))[0]:
                for b in range(sizes):
                    left = mine[bins[mine, f] <= b]
                    right = mine[bins[mine, f] > b]
                    if not draws[left].sum() or not draws[right].sum():
                        continue
                    gain = purity(left) + purity(right) - purity(mine)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
        share = weights[1] * counts[1] / (weights[0] * counts[0] + weights[1] * counts[1])
        if best is not None:
            sides = [grow(part, 2 * node + i, level + 1) for i, part in ((1, best[1]), (2, best[2]))]
            if not (all(leaf for leaf, _ in sides) and sides[0][1] == sides[1][1]):
                return False, None
        out[mine] = share
        return True, share > 0.5

    grow(np.arange(len(y)), 0, 0)
    return out


def test_forest_is_that_of_a_plain_grower(spark, rows):
    x, y = data()
    model = forest.grow_forest(rows, len(NAMES), 6, 4, 42)
    edges = boosting.bin_edges(rows, len(NAMES), forest.BINS)
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    keys = np.array([r[0] for r in spark.range(len(y)).orderBy("id").select(F.xxhash64("id")).collect()])
    weights = [len(y) / (2.0 * (y == c).sum()) for c in (0, 1)]
    trees = [
        plain_tree(bins, y, forest.drawn(forest.seeded(keys, 42), t).astype(int), weights, 42, t, 4, forest.BINS)
        for t in range(6)
    ]
    assert len({tuple(t) for t in trees}) == 6
    assert model.scores(x) == pytest.approx(np.mean(trees, axis=0), abs=1e-12)
    own = [r["probability"][1] for r in model.transform(rows).orderBy("id").collect()]
    assert own == pytest.approx(list(model.scores(x)))


def test_partitioning_and_blocks_change_nothing(rows, monkeypatch):
    one = forest.grow_forest(rows.coalesce(1), len(NAMES), 4, 5, 7)
    monkeypatch.setattr(forest, "ROWS", 7)
    many = forest.grow_forest(rows.repartition(7), len(NAMES), 4, 5, 7)
    x, _ = data()
    assert np.array_equal(one.cuts, many.cuts) and np.array_equal(one.scores(x), many.scores(x))


def test_bootstraps_are_poisson():
    keys = forest.seeded(np.arange(40_000), 42)
    first, second = forest.drawn(keys, 0), forest.drawn(keys, 1)
    assert first.mean() == pytest.approx(1.0, abs=0.02) and first.var() == pytest.approx(1.0, abs=0.05)
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.02


def test_a_forest_takes_a_pass_for_each_level(rows, monkeypatch):
    """However many trees it has."""
    passes, best = [], forest._best
    monkeypatch.setattr(forest, "_best", lambda *args: passes.append(1) or best(*args))
    forest.grow_forest(rows, len(NAMES), 30, 3, 1)
    assert len(passes) == 3


def test_one_class_has_trees_of_one_leaf(rows):
    model = forest.grow_forest(rows.filter("y = 1"), len(NAMES), 2, 3, 1)
    assert (model.cuts == forest.NO_CUT).all() and (model.scores(data()[0]) == 1.0).all()
