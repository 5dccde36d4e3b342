"""Mean absolute feature attribution of boosted trees.

The value of a leaf is shared among the features on its path by the exact
path-dependent Shapley rule. A path is described by one interval and one cover
share per feature, so a batch of rows is handled by a few array operations per
leaf; Spark distributes the rows and averages the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.learning.boosting import BoostedModel, Tree


@dataclass(frozen=True)
class LeafPath:
    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]  # x > low
    high: tuple[float, ...]  # x <= high
    share: tuple[float, ...]  # product of cover shares of the feature's splits


def _walk(tree: Tree, at: str, path: dict[int, tuple[float, float, float]]) -> Iterator[LeafPath]:
    node = tree[at]
    if node.feature < 0:
        items = sorted(path.items())
        yield LeafPath(
            node.value,
            tuple(f for f, _ in items),
            tuple(v[0] for _, v in items),
            tuple(v[1] for _, v in items),
            tuple(v[2] for _, v in items),
        )
        return
    covers = tree[at + "0"].cover, tree[at + "1"].cover
    low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
    total = covers[0] + covers[1]
    cut = node.threshold
    yield from _walk(tree, at + "0", {**path, node.feature: (low, min(high, cut), share * covers[0] / total)})
    yield from _walk(tree, at + "1", {**path, node.feature: (max(low, cut), high, share * covers[1] / total)})


def leaf_paths(model: BoostedModel) -> list[LeafPath]:
    """All leaves of a fitted ensemble, whose size does not grow with the data."""
    return [leaf for tree in model.trees for leaf in _walk(tree, "", {})]


def base_value(paths: Sequence[LeafPath]) -> float:
    return float(sum(p.value * np.prod(p.share) for p in paths))


def _by_pattern(p: LeafPath, inside: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """Per feature of the path its share, from what lies inside the feature's interval."""
    k = len(p.features)
    weights = [factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)]
    for i in range(k):
        # sizes[s]: sum over subsets of s other features being known
        sizes = [np.ones(len(inside[0]))] + [np.zeros(len(inside[0])) for _ in range(k - 1)]
        for j in range(k):
            if j == i:
                continue
            for s in range(k - 1, 0, -1):
                sizes[s] = sizes[s] * p.share[j] + sizes[s - 1] * inside[j]
            sizes[0] = sizes[0] * p.share[j]
        mix = sum(w * s for w, s in zip(weights, sizes, strict=True))
        yield p.value * (inside[i] - p.share[i]) * mix


def attributions(paths: Sequence[LeafPath], x: np.ndarray) -> np.ndarray:
    """Attribution per row and feature on the margin scale. Rows that lie inside the same
    intervals of a path have the same shares, which are found once."""
    columns, out = np.ascontiguousarray(x.T), np.zeros(x.T.shape)
    for p in paths:
        k = len(p.features)
        if k == 0:
            continue
        inside = [(columns[f] > p.low[i]) & (columns[f] <= p.high[i]) for i, f in enumerate(p.features)]
        if 1 << k >= len(x):
            for f, part in zip(p.features, _by_pattern(p, inside), strict=True):
                out[f] += part
            continue
        pattern = np.zeros(len(x), dtype=np.intp)
        for i, mine in enumerate(inside):
            pattern |= mine.astype(np.intp) << i
        every = [(np.arange(1 << k) >> i & 1).astype(bool) for i in range(k)]
        for f, part in zip(p.features, _by_pattern(p, every), strict=True):
            out[f] += part.take(pattern)
    return out.T


def mean_attribution(model: BoostedModel, rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, position) over rows with a ``features`` vector."""
    paths = rows.sparkSession.sparkContext.broadcast(leaf_paths(model))
    width = len(names)

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) == 0:
                continue
            x = np.stack(frame["x"].to_numpy())
            total = np.abs(attributions(paths.value, x)).sum(axis=0)
            yield pd.DataFrame(
                {"at": np.arange(width), "total": total, "n": np.full(width, len(frame))}
            )

    partial = rows.select(vector_to_array("features").alias("x")).mapInPandas(
        batch, "at bigint, total double, n bigint"
    )
    labels = F.array(*[F.lit(n) for n in names])
    means = partial.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean_abs"))
    ranked = means.select(F.element_at(labels, (F.col("at") + 1).cast("int")).alias("feature"), "mean_abs")
    # one row per feature: sort and number them as one short list
    listed = ranked.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("mean_abs")).alias("m"), "feature"))).alias("l")
    )
    return listed.select(F.posexplode("l").alias("pos", "e")).select(
        F.col("e.feature").alias("feature"), (-F.col("e.m")).alias("mean_abs"),
        (F.col("pos") + 1).alias("position"),
    )
