"""Point-in-time features over a temporal transaction graph.

An edge is visible from the later step of its two ends. For a node at step t
that is the same as "the neighbour's step is at most t", so no step loop is
needed. Nodes: (id, step, label); edges: (src, dst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import DataQualityError
from tidewatch.session import materialize

FEATURES = [
    "in_degree", "out_degree", "reciprocity", "ego_illicit_1hop", "ego_illicit_2hop",
    "louvain_community", "time_since_activity",
]


def edge_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both steps and the step they become visible."""
    src = nodes.select(F.col("id").alias("src"), F.col("step").alias("src_step"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("step").alias("dst_step"))
    return edges.join(src, "src").join(dst, "dst").select(
        "src", "dst", "src_step", "dst_step",
        F.greatest("src_step", "dst_step").alias("visible_step"),
    )


def dangling_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends without a node, one row per end."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti")


def contacts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node and distinct neighbour it can see at its own step:
    (id, step, nbr, nbr_step, nbr_illicit, has_in, has_out).

    Grouping by the unordered pair folds parallel edges and shows both
    directions at once, so reciprocity needs no self-join. A loop makes the
    node its own neighbour, once.
    """
    pairs = edges.groupBy(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).agg(
        F.max(F.col("src") <= F.col("dst")).alias("a_to_b"),
        F.max(F.col("src") >= F.col("dst")).alias("b_to_a"),
    )
    illicit = F.coalesce((F.col("label") == 1).cast("int"), F.lit(0))
    left = nodes.select(
        F.col("id").alias("a"), F.col("step").alias("a_step"), illicit.alias("a_illicit")
    )
    right = nodes.select(
        F.col("id").alias("b"), F.col("step").alias("b_step"), illicit.alias("b_illicit")
    )
    # Inner joins on a unique node key; AQE splits the partition of a hub.
    both = pairs.join(left, "a").join(right, "b")

    def view(me: str, other: str, incoming: str, outgoing: str) -> Column:
        return F.struct(
            F.col(me).alias("id"), F.col(f"{me}_step").alias("step"),
            F.col(f"{me}_illicit").alias("illicit"),
            F.col(other).alias("nbr"), F.col(f"{other}_step").alias("nbr_step"),
            F.col(f"{other}_illicit").alias("nbr_illicit"),
            F.col(incoming).alias("has_in"), F.col(outgoing).alias("has_out"),
        )

    from_a = view("a", "b", "b_to_a", "a_to_b")
    from_b = view("b", "a", "a_to_b", "b_to_a")
    views = F.when(F.col("a") == F.col("b"), F.array(from_a)).otherwise(F.array(from_a, from_b))
    return both.select(F.inline(views)).filter("nbr_step <= step")


def local_features(seen: DataFrame) -> DataFrame:
    """Degrees, reciprocity, one-hop illicit share and time since activity from
    ``contacts``, in one aggregation."""
    n_in, n_out = F.count_if("has_in"), F.count_if("has_out")
    mutual = F.count_if(F.col("has_in") & F.col("has_out"))
    earlier = F.max(F.when(F.col("nbr_step") < F.col("step"), F.col("nbr_step")))
    return seen.groupBy("id", "step").agg(
        n_in.cast("int").alias("in_degree"),
        n_out.cast("int").alias("out_degree"),
        (2 * mutual / (n_in + n_out)).alias("reciprocity"),
        (F.sum("nbr_illicit") / F.count(F.lit(1))).alias("ego_illicit_1hop"),
        F.coalesce(F.col("step") - earlier, F.lit(0)).cast("smallint").alias("time_since_activity"),
    )


def two_hop_share(seen: DataFrame, hub_degree: int = 512) -> DataFrame:
    """(id, ego_illicit_2hop): illicit share among one- and two-hop neighbours,
    the centre left out unless it is its own neighbour.

    Walking through a hub would emit every pair of its neighbours. All nodes
    that see the same hubs at the same step share the set behind those hubs, so
    that set is built once per (hubs, step) and joined by key; walks run through
    neighbours below ``hub_degree`` only. A hub itself walks its own contacts:
    one row per edge end. The count is exact for any graph.
    """
    seen = materialize(seen, "contacts")
    # contacts hold what a node sees at its own step; adjacency is needed as
    # seen at the centre's step, so restore both directions of every pair
    ends = seen.select("id", "step", "illicit", "nbr", "nbr_step", "nbr_illicit")
    adjacency = ends.select("id", F.col("nbr").alias("far"), F.col("nbr_step").alias("far_step"),
                            F.col("nbr_illicit").alias("far_illicit")).unionByName(
        ends.filter("step > nbr_step").select(
            F.col("nbr").alias("id"), F.col("id").alias("far"), F.col("step").alias("far_step"),
            F.col("illicit").alias("far_illicit"))
    )
    hubs = (
        adjacency.groupBy("id").count().filter(F.col("count") > hub_degree).select("id")
    )
    hub_ids = hubs.select(F.col("id").alias("nbr"), F.lit(True).alias("is_hub"))
    centre_hubs = hubs.withColumn("centre_is_hub", F.lit(True))
    marked = seen.join(hub_ids, "nbr", "left").join(centre_hubs, "id", "left").select(
        "id", "step", "illicit", "nbr", "nbr_step", "nbr_illicit",
        F.coalesce("is_hub", F.lit(False)).alias("is_hub"),
        F.coalesce("centre_is_hub", F.lit(False)).alias("centre_is_hub"),
    )
    # the hubs a plain node sees: at most hub_degree of them
    shared = marked.filter("is_hub AND NOT centre_is_hub")
    signatures = shared.groupBy("id", "step").agg(
        F.sort_array(F.collect_list("nbr")).alias("hubs")
    )
    behind = (
        signatures.select("hubs", "step").distinct()
        .select("hubs", "step", F.explode("hubs").alias("id"))
        .join(adjacency, "id")
        .filter("far_step <= step")
        .groupBy("hubs", "step", "far")
        .agg(F.max("far_illicit").alias("far_illicit"))
    )
    behind_totals = behind.groupBy("hubs", "step").agg(
        F.count(F.lit(1)).alias("hub_count"), F.sum("far_illicit").alias("hub_illicit")
    )
    own = marked.join(signatures, ["id", "step"], "left")
    walks = (
        own.filter("NOT is_hub OR centre_is_hub")
        .select(F.col("id").alias("centre"), "step", "hubs", F.col("nbr").alias("id"))
        .join(adjacency, "id")
        .filter("far_step <= step")
        .select("centre", "step", "hubs", "far", "far_illicit")
    )
    direct = own.select(
        F.col("id").alias("centre"), "step", "hubs", F.col("nbr").alias("far"),
        F.col("nbr_illicit").alias("far_illicit"),
    )
    reached = (
        walks.unionByName(direct)
        .groupBy("centre", "step", "hubs", "far")
        .agg(F.max("far_illicit").alias("far_illicit"))
    )
    known = behind.select("hubs", "step", "far")
    beside = (
        reached.join(known, ["hubs", "step", "far"], "left_anti")
        .groupBy("centre")
        .agg(
            F.count(F.lit(1)).alias("plain_count"),
            F.sum("far_illicit").alias("plain_illicit"),
        )
    )
    # every centre is reached back from its own neighbours; take it out again
    centres = own.groupBy(F.col("id").alias("centre"), "step", "hubs").agg(
        F.max("illicit").alias("illicit"),
        F.max(F.col("nbr") == F.col("id")).alias("loops"),
    )
    counted = (
        centres.join(behind_totals, ["hubs", "step"], "left")
        .join(beside, "centre", "left")
        .select(
            "centre",
            F.when(F.col("loops"), 0).otherwise(1).alias("drop"),
            F.when(F.col("loops"), 0).otherwise(F.col("illicit")).alias("drop_illicit"),
            (F.coalesce("hub_count", F.lit(0)) + F.coalesce("plain_count", F.lit(0))).alias("n"),
            (F.coalesce("hub_illicit", F.lit(0)) + F.coalesce("plain_illicit", F.lit(0))).alias("bad"),
        )
    )
    size = F.col("n") - F.col("drop")
    return counted.select(
        F.col("centre").alias("id"),
        F.coalesce(F.try_divide(F.col("bad") - F.col("drop_illicit"), size), F.lit(0.0)).alias(
            "ego_illicit_2hop"
        ),
    )


def graph_features(
    nodes: DataFrame, edges: DataFrame, communities: DataFrame, hub_degree: int = 512
) -> DataFrame:
    """One complete row per node. ``communities`` is (id, community)."""
    seen = materialize(contacts(nodes, edges), "contacts")
    joined = (
        nodes.select("id", "step")
        .join(local_features(seen).drop("step"), "id", "left")
        .join(two_hop_share(seen, hub_degree), "id", "left")
        .join(communities.select("id", F.col("community").alias("louvain_community")), "id", "left")
    )
    defaults = {
        "in_degree": 0, "out_degree": 0, "reciprocity": 0.0, "ego_illicit_1hop": 0.0,
        "ego_illicit_2hop": 0.0, "louvain_community": -1, "time_since_activity": 0,
    }
    return joined.select("id", *[
        F.coalesce(F.col(name), F.lit(value).cast(joined.schema[name].dataType)).alias(name)
        for name, value in defaults.items()
    ])


def inductive_edges(stepped: DataFrame, train_max: int) -> DataFrame:
    """Edges whose later end lies in the training period."""
    return stepped.filter(F.col("visible_step") <= train_max)


def check_no_lookahead_edges(edges: DataFrame, train_max: int) -> DataFrame:
    """The kept edges are checked, not trusted."""
    latest = edges.agg(F.max(F.greatest("src_step", "dst_step")).alias("latest")).first()["latest"]
    if latest is not None and latest > train_max:
        raise DataQualityError(f"look-ahead: an edge reaches step {latest}, limit {train_max}")
    return edges


def neighbour_means(edges: DataFrame, feats: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """Mean of the source nodes' columns per destination: one message-passing
    round. Nodes without incoming edges get zeros, like an empty mean."""
    sent = edges.select("src", "dst").join(
        feats.select(F.col("id").alias("src"), *columns), "src"
    )
    means = sent.groupBy("dst").agg(*[F.avg(c).alias(c + suffix) for c in columns])
    return feats.select("id").join(means.withColumnRenamed("dst", "id"), "id", "left").fillna(0.0)
