"""Hard negatives by exact maximum inner product search over anchor clusters.

Vectors become whole numbers, floor(256 * x). Anchors are clustered by direction. For a
cluster with centre c and widest angle w, a row of norm r at angle t to c scores at most
|anchor| * r * cos(max(0, t - w)): rows sorted by that bound once are the list of all
the cluster's members. A member walks the list and keeps its best rows until the bound
certifies that no later row can enter.

On a cluster of machines the list lies in shards: rows that are nearest to one centre,
in parts of bounded size. A member walks its own cluster's shards first; what it found
there is its floor for the others, and shards whose best bound is below the floors of a
block of members are never sent to it. Anchors are moved, rows stay.

The same search runs twice: for the best rows of the same label (positives), then, per
positive score, for the best rows of other labels inside the window of scores.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite
component take no part; vectors of different lengths meet as if padded with zeros; rows
that agree in vec_id, label and vector count once; rows that share a vec_id but differ
are rows of their own, as anchors too, and "other rows" are all but the anchor's own
row; ties go to the smaller vec_id; further columns are ignored; an empty table, or one
without anchors, gives no rows; a negative positive score has an empty window. Of rows
with equal label and vector only the first ``positives`` + 1 ids can be in an answer;
the others leave before the search, which is exact. Sums that could pass 2**53 are
computed on integers of any size; a score beyond the range of long raises.

The number of centres is bounded (``CENTRES``), so what workers get of them is too; they
steer the work, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column
from tidewatch.llm.topk import SCALE, quantised
from tidewatch.session import materialize

CENTRES = 1024
MEMBERS = 256  # aimed at in a cluster, as long as there are centres
MEMBER_BLOCK = 512
SHARD_ROWS = 1 << 15
STEP = 1024  # list entries between two looks at the bound
_SLACK = 1e-7  # relative, far above rounding
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_FOUND_SCHEMA = "member long, lo long, hi long, vec_id long, score long, own boolean"
_FOUND = pa.schema([
    ("member", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("vec_id", pa.int64()),
    ("score", pa.int64()), ("own", pa.bool_()),
])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


class Centres:
    """Unit centres of the clusters; the last one has no direction and serves anchors
    without any."""

    def __init__(self, directions: np.ndarray, width: int) -> None:
        norms = np.linalg.norm(directions, axis=1, keepdims=True) if len(directions) else np.zeros((0, 1))
        units = np.divide(directions, norms, out=np.zeros_like(directions), where=norms > 0)
        self.units = np.vstack([units.reshape(-1, width), np.zeros((1, width))])
        self.angles = np.full(len(self.units), np.pi)

    def cosines(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Norms, and cosines to every centre (0 for rows without direction)."""
        wide = rows.astype(np.float64)
        norms = np.linalg.norm(wide, axis=1)
        safe = np.where(norms > 0, norms, 1.0)
        return norms, np.clip(wide @ self.units.T / safe[:, None], -1.0, 1.0)

    def nearest(self, norms: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        last = len(self.units) - 1
        if last == 0:
            return np.zeros(len(norms), dtype=np.int64)
        return np.where(norms > 0, np.argmax(cosines[:, :last], axis=1), last)

    def bounds(self, norms: np.ndarray, cosines: np.ndarray, cluster: int | slice) -> np.ndarray:
        """What a row can score at most with a member of norm 1, rounded up."""
        over = np.arccos(cosines[:, cluster]) - self.angles[cluster]
        scale = norms if cosines[:, cluster].ndim == 1 else norms[:, None]
        return scale * (np.cos(np.maximum(over, 0.0)) + _SLACK)


def _placed(rows: DataFrame, centres: Centres) -> DataFrame:
    """``rows`` (with v) with norm, cluster and cosine to the cluster's centre."""
    arrow_extra = [("norm", pa.float64()), ("cluster", pa.int64()), ("cosine", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            norms, cosines = centres.cosines(_matrix(column(batch, "v")))
            cluster = centres.nearest(norms, cosines)
            more = [norms, cluster, cosines[np.arange(len(norms)), cluster]]
            schema = pa.schema([*batch.schema, *(pa.field(n, t) for n, t in arrow_extra)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], schema=schema)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, norm double, cluster long, cosine double")


def _reach(rows: DataFrame, centres: Centres) -> DataFrame:
    """home, cluster, reach: the best bound of a home's rows for each cluster."""
    schema = pa.schema([("home", pa.int64()), ("cluster", pa.int64()), ("reach", pa.float64())])
    n = len(centres.units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((n, n), -1.0)
        for batch in batches:
            if batch.num_rows:
                norms, cosines = centres.cosines(_matrix(column(batch, "v")))
                bounds = centres.bounds(norms, cosines, slice(None))
                np.maximum.at(best, column(batch, "home").to_numpy(), np.maximum(bounds, 0.0))
        home, cluster = np.nonzero(best >= 0)
        yield as_batch({"home": home, "cluster": cluster, "reach": best[home, cluster]}, schema)

    found = rows.select("home", "v").mapInArrow(run, "home long, cluster long, reach double")
    return found.groupBy("home", "cluster").agg(F.max("reach").alias("reach"))


class Members:
    """A block of members of one cluster and what each wants: rows with scores from lo
    to hi, above a floor once ``k`` are known."""

    def __init__(self, block: pa.StructArray, k: int) -> None:
        self.ids = block.field("member").to_numpy()
        self.labels = block.field("label").to_numpy()
        self.vectors = _matrix(block.field("v"))
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1)
        wants = block.field("wants")
        flat = wants.flatten()
        self.of = np.repeat(np.arange(len(block)), np.diff(wants.offsets.to_numpy()))
        self.lo, self.hi, self.floor = (
            flat.field(name).to_numpy(zero_copy_only=False).copy() for name in ("lo", "hi", "floor"))
        self.k = k
        self.best: list[list[tuple[int, int, bool]]] = [[] for _ in self.of]  # (-score, vec_id, own row)

    def lowest(self) -> np.ndarray:
        """Per member the lowest score that can still enter."""
        low = np.full(len(self.ids), np.inf)
        np.minimum.at(low, self.of, np.maximum(self.lo, self.floor).astype(np.float64))
        return low


def walk(
    members: Members, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, order: np.ndarray,
    bounds: np.ndarray, same_label: bool, step: int = STEP,
) -> None:
    """Members walk the list ``order`` of rows, whose bounds descend, until certified."""
    peak = float(np.abs(rows).max(initial=0)) * float(np.abs(members.vectors).max(initial=0)) * rows.shape[1]
    kind = np.float64 if peak < 2.0**52 else object
    vectors, rows_of = members.vectors.astype(kind), rows.astype(kind)
    for start in range(0, len(order), step):
        top = bounds[order[start]]
        open_ = members.norms * (top + _SLACK * abs(top)) >= members.lowest()
        wants = np.flatnonzero(open_[members.of])
        if not len(wants):
            return
        part = order[start : start + step]
        active = np.flatnonzero(open_)
        scores = vectors[active].dot(rows_of[part].T)
        at = np.searchsorted(active, members.of[wants])
        seen = scores[at]
        fits = (labels[part][None, :] == members.labels[members.of[wants]][:, None]) == same_label
        fits &= (seen >= np.maximum(members.lo, members.floor)[wants, None]) & (seen <= members.hi[wants, None])
        want_at, row_at = np.nonzero(fits)
        cuts = np.flatnonzero(np.diff(want_at)) + 1
        for group in np.split(np.arange(len(want_at)), cuts) if len(want_at) else []:
            here = want_at[group[0]]
            w = wants[here]
            best = members.best[w]
            score, found = seen[here, row_at[group]], part[row_at[group]]
            first = np.lexsort((ids[found], -score))[: members.k] if kind is np.float64 else sorted(
                range(len(found)), key=lambda i: (-score[i], ids[found[i]]))[: members.k]
            own = members.vectors[members.of[w]]
            best.extend((-int(score[i]), int(ids[found[i]]), bool((rows[found[i]] == own).all())) for i in first)
            best.sort()
            del best[members.k :]
            if len(best) == members.k:
                members.floor[w] = max(members.floor[w], -best[-1][0])


def _walked(pairs: DataFrame, centres: Centres, same_label: bool, k: int) -> DataFrame:
    """What the members of each pair of block and shard find."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = Members(column(batch, "members")[i].values, k)
                shard = column(batch, "rows")[i].values
                rows = _matrix(shard.field("v"))
                cluster = column(batch, "cluster")[i].as_py()
                bounds = centres.bounds(*centres.cosines(rows), cluster)
                walk(members, shard.field("vec_id").to_numpy(), shard.field("label").to_numpy(), rows,
                     np.argsort(-bounds, kind="stable"), bounds, same_label)
                flat = [(w, *found) for w, best in enumerate(members.best) for found in best]
                want = np.array([f[0] for f in flat], dtype=np.int64)
                yield as_batch({
                    "member": members.ids[members.of[want]], "lo": members.lo[want], "hi": members.hi[want],
                    "vec_id": [f[2] for f in flat], "score": [-f[1] for f in flat], "own": [f[3] for f in flat],
                }, _FOUND)

    return pairs.select("cluster", "members", "rows").mapInArrow(run, _FOUND_SCHEMA)


class Search:
    """Placed anchors, sharded rows and the reach of every home."""

    def __init__(self, members: DataFrame, shards: DataFrame, reach: DataFrame, centres: Centres,
                 member_block: int) -> None:
        self.members, self.shards, self.reach, self.centres = members, shards, reach, centres
        sizes = members.groupBy("cluster").count()  # as many rows as centres
        self.deals = sizes.select("cluster", F.ceil(F.col("count") / member_block).alias("deals"))

    def _blocks(self, wants: DataFrame) -> DataFrame:
        """cluster, members, need: the lowest score a member of norm 1 must reach."""
        asked = wants.groupBy("member").agg(
            F.collect_list(F.struct("lo", "hi", "floor")).alias("wants"), F.min("floor").alias("lowest"))
        need = F.when(F.col("norm") > 0, F.col("lowest") / F.col("norm")).otherwise(F.lit(float("-inf")))
        rows = self.members.join(asked, "member").join(self.deals, "cluster")
        block = F.pmod(F.xxhash64("member"), F.col("deals"))
        return rows.groupBy("cluster", block.alias("block")).agg(
            F.collect_list(F.struct("member", "label", "v", "wants")).alias("members"), F.min(need).alias("need"))

    def best(self, wants: DataFrame, same_label: bool, k: int) -> DataFrame:
        """The first k rows (score down, vec_id up) per want: member, lo, hi."""
        wants = wants.withColumn("floor", F.col("lo"))
        near = self._blocks(wants).join(self.shards.withColumnRenamed("home", "cluster"), "cluster")
        found = materialize(_walked(near, self.centres, same_label, k), "negatives-near")
        keys = ["member", "lo", "hi"]
        floors = _first(found, k).groupBy(*keys).agg(F.min("score").alias("worst"), F.count("*").alias("held"))
        known = wants.join(floors, keys, "left").select(
            *keys, F.when(F.col("held") >= k, F.greatest("worst", "lo")).otherwise(F.col("lo")).alias("floor"))
        far = (
            self._blocks(known).join(self.reach, "cluster")
            .where((F.col("home") != F.col("cluster")) & (F.col("reach") * (1 + _SLACK) >= F.col("need")))
            .join(self.shards, "home")
        )
        return _first(found.unionAll(_walked(far, self.centres, same_label, k)), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("member", "lo", "hi").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _centres(members: DataFrame, width: int, per_cluster: int) -> Centres:
    """Centres of k-means over the anchors' directions."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    directed = members.withColumn("norm", norm).where("norm > 0")
    unit = F.transform("v", lambda x: x.cast("double") / F.col("norm"))
    unit = directed.select(array_to_vector(unit).alias("unit"))
    count = unit.count()
    if not count:
        return Centres(np.zeros((0, width)), width)
    k = max(2, min(CENTRES, -(-count // per_cluster)))  # the library takes no fewer
    fit = KMeans(k=k, featuresCol="unit", seed=1, maxIter=5, initMode="random").fit(unit)
    return Centres(np.array(fit.clusterCenters()), width)


def participants(vectors: DataFrame, scale: int = SCALE, noisy: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, v: rows that take part. Every ``noisy``-th id has the next label."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % noisy == 0, (label + 1) % classes).otherwise(label)
    return quantised(vectors.where(F.col("label").isNotNull()), scale, label.alias("label")).distinct()


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    per_cluster: int = MEMBERS, member_block: int = MEMBER_BLOCK, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as ``participants`` gives them; a negative scores ``low`` to ``high``
    percent of the positive."""
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    rows = materialize(rows.withColumn("v", F.concat("v", padding)).distinct(), "negatives-rows")
    anchors = rows.where(is_anchor)
    groups = anchors.select("label", "v").distinct()
    members = materialize(groups.withColumn("member", F.monotonically_increasing_id()), "negatives-anchors")

    centres = _centres(members, width, per_cluster)
    members = materialize(_placed(members, centres), "negatives-members")
    for row in members.where("norm > 0").groupBy("cluster").agg(F.min("cosine").alias("c")).collect():
        centres.angles[row["cluster"]] = np.arccos(row["c"])

    twins = Window.partitionBy("label", "v").orderBy("vec_id")
    chosen = rows.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= positives + 1).drop("twin")
    placed = _placed(chosen.select("vec_id", "label", "v"), centres).withColumnRenamed("cluster", "home")
    placed = materialize(placed.select("home", "vec_id", "label", "v"), "negatives-placed")
    sizes = placed.groupBy("home").count()
    parts = sizes.select("home", F.ceil(F.col("count") / shard_rows).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("parts"))
    shards = placed.join(parts, "home").groupBy("home", part.alias("part")).agg(
        F.collect_list(F.struct("vec_id", "label", "v")).alias("rows"))
    shards = materialize(shards, "negatives-shards").select("home", "rows")
    search = Search(members, shards, materialize(_reach(placed, centres), "negatives-reach"), centres, member_block)

    anything = members.select("member", F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))
    alike = materialize(search.best(anything, True, positives + 1), "negatives-positives")
    exact = F.col("score").cast("decimal(20,0)")
    windows = alike.select(
        "member", F.col("score").alias("positive_score"), F.ceil(exact * F.lit(Decimal(low) / 100)).cast("long").alias("lo"),
        F.floor(exact * F.lit(Decimal(high) / 100)).cast("long").alias("hi"),
    ).where("lo <= hi").distinct()
    unlike = search.best(windows.select("member", "lo", "hi").distinct(), False, negatives)
    unlike = windows.join(unlike, ["member", "lo", "hi"]).select(
        "member", "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))

    named = anchors.join(members.select("member", "label", "v"), ["label", "v"]).select(
        F.col("vec_id").alias("anchor_id"), "member")
    pairs = named.join(alike.select("member", "vec_id", "score", "own", "place"), "member").where(
        ~((F.col("vec_id") == F.col("anchor_id")) & F.col("own")))
    nearest = Window.partitionBy("anchor_id", "member").orderBy("place")
    pairs = pairs.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= positives)
    pairs = pairs.select("anchor_id", "member", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(unlike, ["member", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
