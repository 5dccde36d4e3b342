"""Modularity communities of the training-period graph.

Nodes move to the neighbouring community with the best modularity gain until none wants
to; then communities become the nodes of a coarser graph, until that gains nothing more.

A level starts with bold rounds: a hashed half of the nodes moves at once, as long as
the modularity rises. Careful rounds end it. In these, communities are sources or
targets by a hashed bit, so no node moves towards a neighbour that is leaving, and a
node moves only if its gain exceeds what all moves into its target and out of its source
can cost it; or, where that lets more nodes move, those that come first by a hash in
both of their communities. The gains of the moves then add up, and modularity rises with
every round, so the search ends where no node wants to move.

Every round is a few aggregations; its state is one row per node, written to the shared
folder so that the lineage stays short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import ConvergenceError
from tidewatch.session import materialize

_EPSILON = 1e-9  # gains below it are rounding


@dataclass(frozen=True)
class MovingConfig:
    seed: int = 42
    bold: float = 0.02  # careful rounds begin when at most this share of the nodes wants to move
    min_gain: float = 1e-7  # of modularity, for one more level
    limit: int = 2000  # rounds of one level; more raise


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a <= b; parallel and mutual edges are one edge of weight 1."""
    return (
        edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
        .withColumn("w", F.lit(1.0))
    )


def _both_ways(graph: DataFrame) -> DataFrame:
    """(id, nbr, w) from both ends; a loop appears once with double weight."""
    ends = F.when(
        F.col("a") == F.col("b"),
        F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), (2 * F.col("w")).alias("w"))),
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("id"), F.col("b").alias("nbr"), F.col("w").alias("w")),
            F.struct(F.col("b").alias("id"), F.col("a").alias("nbr"), F.col("w").alias("w")),
        )
    )
    return graph.select(F.inline(ends))


def modularity(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity of (id, community) on the weighted graph (a, b, w)."""
    ends = _both_ways(graph)
    own = membership.select("id", F.col("community").alias("c"))
    other = membership.select(F.col("id").alias("nbr"), F.col("community").alias("d"))
    parts = (
        ends.join(own, "id").join(other, "nbr")
        .groupBy("c")
        .agg(
            F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inside"),
            F.sum("w").alias("total"),
        )
    )
    sums = parts.agg(
        F.sum("inside").alias("inside"), F.sum("total").alias("two_m"),
        F.sum(F.col("total") * F.col("total")).alias("squares"),
    )
    two_m = F.col("two_m")
    return sums.select(
        (F.col("inside") / two_m - F.col("squares") / (two_m * two_m)).alias("modularity")
    )


def _choices(ends: DataFrame, state: DataFrame, two_m: float) -> DataFrame:
    """(id, k, community, target, margin, inside): where a node wants to move, null if
    nowhere, what it gains, and its links inside its community. ``ends`` excludes loops;
    k is the node's weighted degree. Every node carries its community's totals, so a
    neighbour brings them along and no further join is needed."""
    totals = state.groupBy("community").agg(
        F.sum("k").alias("own_total"), F.count(F.lit(1)).alias("own_members")
    )
    placed = state.join(totals, "community").select("id", "k", "community", "own_total", "own_members")
    linked = (
        ends.join(
            placed.select(
                F.col("id").alias("nbr"), F.col("community").alias("target"),
                F.col("own_total").alias("total"), F.col("own_members").alias("members"),
            ),
            "nbr",
        )
        .groupBy("id", "target")
        .agg(
            F.sum("w").alias("links"), F.max("total").alias("total"),
            F.max("members").alias("members"),
        )
    )
    options = placed.join(linked, "id", "left")
    stays = F.col("target") == F.col("community")
    # gain against standing alone, scaled by the common factor 1/m
    gain = F.col("links") - F.col("k") * (
        F.col("total") - F.when(stays, F.col("k")).otherwise(0.0)
    ) / F.lit(two_m)
    # two single nodes may only merge towards the smaller id
    allowed = stays | ~(
        (F.col("own_members") == 1) & (F.col("members") == 1) & (F.col("target") > F.col("community"))
    )
    # best gain first, then the smallest community
    choice = F.when(allowed, F.struct((-gain).alias("loss"), "target"))
    best = options.groupBy("id", "k", "community", "own_total").agg(
        F.min(choice).alias("best"), F.max(F.when(stays, gain)).alias("stay_gain"),
        F.coalesce(F.max(F.when(stays, F.col("links"))), F.lit(0.0)).alias("inside"),
    )
    alone = -F.col("k") * (F.col("own_total") - F.col("k")) / F.lit(two_m)
    margin = -F.col("best.loss") - F.coalesce(F.col("stay_gain"), alone)
    wants = F.col("best").isNotNull() & (margin > _EPSILON)
    return best.select(
        "id", "k", "community", F.when(wants, F.col("best.target")).alias("target"),
        F.when(wants, margin).alias("margin"), "inside",
    )


def _bit(community: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(community, F.lit(seed)), F.lit(2))


def _moved(choices: DataFrame, move: Column) -> DataFrame:
    return choices.select(
        "id", "k", F.when(move, F.col("target")).otherwise(F.col("community")).alias("community")
    )


def _careful(choices: DataFrame, two_m: float, seed: int) -> DataFrame:
    """(id, goes, safe, first) of the nodes that want to move. All safe moves together
    raise the modularity, and so do all first ones.

    Moves of weights k into (or out of) one community cost k_u * k_v / two_m per pair
    beyond their single gains; half of that is laid on each node. A first move shares
    neither of its communities with another first move."""
    wishes = choices.filter("target IS NOT NULL").select(
        "id", "k", "margin", "community", "target", F.xxhash64("id", F.lit(seed)).alias("turn"),
        ((_bit("community", seed) == 0) & (_bit("target", seed) == 1)).alias("fits"),
    )
    load = F.when(F.col("fits"), F.col("k")).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("community").alias("at"), load.alias("load"), F.struct("turn", "id").alias("turn")),
        F.struct(F.col("target").alias("at"), load.alias("load"), F.struct("turn", "id").alias("turn")),
    )
    crowds = wishes.select(F.inline(sides)).groupBy("at").agg(F.sum("load").alias("load"), F.min("turn").alias("turn"))

    def crowd(of: str, name: str) -> DataFrame:
        return crowds.select(F.col("at").alias(of), F.col("load").alias(f"{name}_load"), F.col("turn.id").alias(f"{name}_first"))

    both = wishes.join(crowd("community", "out"), "community").join(crowd("target", "in"), "target")
    cost = F.col("k") * (F.col("in_load") + F.col("out_load") - 2 * F.col("k")) / F.lit(2 * two_m)
    return both.select(
        "id", F.col("target").alias("goes"),
        (F.col("fits") & (F.col("margin") - cost > _EPSILON / 2)).alias("safe"),
        ((F.col("out_first") == F.col("id")) & (F.col("in_first") == F.col("id"))).alias("first"),
    )


def local_moving(graph: DataFrame, cfg: MovingConfig) -> tuple[DataFrame, float]:
    """(id, community) that no node wants to leave, and the modularity."""
    both = _both_ways(graph)
    ends = materialize(both.filter("id <> nbr"), "community-ends")
    state = materialize(
        both.groupBy("id").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("id") == F.col("nbr"), F.col("w"))).alias("loop")),
        "community-nodes",
    )
    size = state.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("two_m"), F.sum("loop").alias("loops")).first()
    two_m, loops = size["two_m"], size["loops"] or 0.0
    state = state.select("id", "k", F.col("id").alias("community"))
    careful, best, before = False, float("-inf"), state
    for round_no in range(cfg.limit):
        choices = materialize(_choices(ends, state, two_m), "community-choices")
        parts = choices.groupBy("community").agg(
            F.sum("inside").alias("inside"), F.sum("k").alias("k"), F.count("target").alias("movers")
        )
        now = parts.agg(
            F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"),
            F.sum("movers").alias("movers"),
        ).first()
        quality = (now["inside"] + loops) / two_m - now["squares"] / (two_m * two_m)
        if not careful and quality <= best:  # a bold round did harm
            state, careful = before, True
            continue
        best = quality
        if not now["movers"]:
            return choices.select("id", "community"), quality
        careful = careful or now["movers"] <= cfg.bold * size["n"]
        before = choices.select("id", "k", "community")
        seed = cfg.seed + round_no
        if careful:
            asked = materialize(_careful(choices, two_m, seed), "community-moves")
            found = asked.agg(F.count_if("safe").alias("safe"), F.count_if("first").alias("first")).first()
            going = asked.filter("safe" if found["safe"] > found["first"] else "first").select("id", "goes")
            state = choices.join(going, "id", "left").select(
                "id", "k", F.coalesce("goes", "community").alias("community"))
        else:
            turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0
            state = _moved(choices, turn & F.col("target").isNotNull())
    raise ConvergenceError(f"nodes still move after {cfg.limit} rounds")


def communities(edges: DataFrame, cfg: MovingConfig = MovingConfig()) -> DataFrame:
    """(id, community) for every node with an edge; the community is named by its
    smallest node id. Give it training-period edges only."""
    graph = materialize(undirected(edges), "community-graph")
    if graph.isEmpty():
        return graph.select(F.col("a").alias("id"), F.col("a").alias("community"))
    members, reached = None, float("-inf")
    while True:
        level, quality = local_moving(graph, cfg)
        level = materialize(level, "community-level")
        if members is None:
            members = level
        else:
            up = level.select(F.col("id").alias("community"), F.col("community").alias("upper"))
            members = materialize(
                members.join(up, "community").select("id", F.col("upper").alias("community")), "community-members"
            )
        if quality <= reached + cfg.min_gain or level.filter("id <> community").isEmpty():
            break
        reached = quality
        left = level.select(F.col("id").alias("a"), F.col("community").alias("ca"))
        right = level.select(F.col("id").alias("b"), F.col("community").alias("cb"))
        graph = materialize(
            graph.join(left, "a").join(right, "b")
            .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
            .agg(F.sum("w").alias("w")),
            "community-graph",
        )
    smallest = members.groupBy("community").agg(F.min("id").alias("name"))
    return members.join(smallest, "community").select("id", F.col("name").alias("community"))
