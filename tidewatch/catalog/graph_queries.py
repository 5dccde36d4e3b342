"""Temporal graph features over orders linked by part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.inputs import SPLIT
from tidewatch.catalog.registry import cte, query
from tidewatch.learning.matrix import labelled, node_label, standardize, standardize_stats
from tidewatch.operators import communities, graph
from tidewatch.operators.metrics import base_rate_all, base_rate_labelled
from tidewatch.sources.adapters import NODE_FEATURES, graph_vectors

cte("node_vector", """
    SELECT o_orderkey AS id, o_totalprice AS f001, COALESCE(l.f002, 0.0) AS f002, COALESCE(l.f003, 0.0) AS f003,
           COALESCE(l.f004, 0.0) AS f004, COALESCE(l.f005, 0.0) AS f005, COALESCE(l.f006, 0.0) AS f006,
           COALESCE(l.f007, 0.0) AS f007, COALESCE(l.f008, 0.0) AS f008
    FROM orders LEFT JOIN (
      SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS f002,
             CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS f003,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS f004,
             CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS f005,
             CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS f006,
             CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS f007,
             CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS f008
      FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
cte("local_feature", """
    SELECT id, CAST(sum(has_in) AS INT) AS in_degree, CAST(sum(has_out) AS INT) AS out_degree,
           CAST(2 * count(*) FILTER (WHERE has_in = 1 AND has_out = 1) AS DOUBLE) / sum(has_in + has_out) AS reciprocity,
           CAST(sum(nbr_illicit) AS DOUBLE) / count(*) AS ego_illicit_1hop,
           COALESCE(any_value(step) - max(nbr_step) FILTER (WHERE nbr_step < step), 0) AS time_since_activity
    FROM nbr_seen GROUP BY id""")
cte("graph_feature", """
    SELECT n.id, COALESCE(in_degree, 0) AS in_degree, COALESCE(out_degree, 0) AS out_degree,
           COALESCE(reciprocity, 0.0) AS reciprocity, COALESCE(ego_illicit_1hop, 0.0) AS ego_illicit_1hop,
           COALESCE(share, 0.0) AS ego_illicit_2hop, COALESCE(time_since_activity, 0) AS time_since_activity
    FROM graph_node n LEFT JOIN local_feature f ON n.id = f.id LEFT JOIN two_hop t ON n.id = t.id""")


@query("p6_filter_labelled", "SELECT id, step, label FROM graph_node WHERE label IS NOT NULL")
def filter_labelled(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(inputs.nodes(spark, folder))


@query(
    "p8_project_label",
    "SELECT id, CASE WHEN label = 1 THEN 1 WHEN label = 2 THEN 0 ELSE -1 END AS y FROM graph_node",
)
def project_label(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.nodes(spark, folder).select("id", node_label("label").alias("y"))


@query("j12_join_edge_steps", "SELECT * FROM stepped_edge")
def join_edge_steps(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_steps(inputs.nodes(spark, folder), inputs.edges(spark, folder))


@query(
    "j13_join_anti",
    "SELECT n.id, n.step FROM graph_node n LEFT JOIN nbr_dir d ON n.id = d.id WHERE d.id IS NULL",
)
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes without any edge."""
    ends = inputs.edges(spark, folder).select(F.explode(F.array("src", "dst")).alias("id"))
    return inputs.nodes(spark, folder).join(ends, "id", "left_anti").select("id", "step")


@query("w5_window_prior_activity", "SELECT id, time_since_activity FROM local_feature")
def window_prior_activity(spark: SparkSession, folder: str) -> DataFrame:
    seen = inputs.contact_table(spark, folder)
    return graph.local_features(seen).select("id", "time_since_activity")


@query("n1_edge_visibility", "SELECT src, dst, visible_step FROM stepped_edge")
def edge_visibility(spark: SparkSession, folder: str) -> DataFrame:
    return join_edge_steps(spark, folder).select("src", "dst", "visible_step")


def _contacts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.contacts(inputs.nodes(spark, folder), inputs.edges(spark, folder))


@query("n2_graph_degrees", "SELECT id, in_degree, out_degree FROM graph_feature")
def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    seen = graph.local_features(_contacts(spark, folder)).select("id", "in_degree", "out_degree")
    return inputs.nodes(spark, folder).select("id").join(seen, "id", "left").fillna(0)


@query("n3_graph_reciprocity", "SELECT id, reciprocity FROM local_feature")
def graph_reciprocity(spark: SparkSession, folder: str) -> DataFrame:
    return graph.local_features(_contacts(spark, folder)).select("id", "reciprocity")


@query("n4_ego_illicit_1hop", "SELECT id, ego_illicit_1hop FROM local_feature")
def ego_illicit_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.local_features(_contacts(spark, folder)).select("id", "ego_illicit_1hop")


@query("n5_ego_illicit_2hop", "SELECT id, share AS ego_illicit_2hop FROM two_hop")
def ego_illicit_2hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.two_hop_share(_contacts(spark, folder))


@query("n5_ego_illicit_2hop_hubs", "SELECT id, share AS ego_illicit_2hop FROM two_hop")
def ego_illicit_2hop_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a hub limit that most nodes pass."""
    return graph.two_hop_share(_contacts(spark, folder), hub_degree=3)


@query("n6_time_since_activity", "SELECT id, time_since_activity FROM graph_feature")
def time_since_activity(spark: SparkSession, folder: str) -> DataFrame:
    seen = graph.local_features(_contacts(spark, folder)).select("id", "time_since_activity")
    return inputs.nodes(spark, folder).select("id").join(seen, "id", "left").fillna(0)


@query("n7_community_train")
def community_train(spark: SparkSession, folder: str) -> DataFrame:
    found = communities.communities(inputs.train_edges(spark, folder))
    return inputs.nodes(spark, folder).select("id").join(found, "id", "left").select(
        "id", F.coalesce("community", F.lit(-1)).alias("louvain_community")
    )


@query("n8_graph_features", "SELECT * FROM graph_feature")
def graph_features(spark: SparkSession, folder: str) -> DataFrame:
    """Community ids are arbitrary and left out of the comparison."""
    return inputs.graph_feature_table(spark, folder).drop("louvain_community")


@query(
    "n9_inductive_edge_mask",
    f"SELECT src, dst, visible_step FROM stepped_edge WHERE visible_step <= {SPLIT.train_max}",
)
def inductive_edge_mask(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.train_edges(spark, folder).select("src", "dst", "visible_step")


# averages of small rates need more digits than sums of money
_DIGITS = {c: 9 if c in ("f005", "f006") else 6 for c in NODE_FEATURES}
_MEANS = ", ".join(f"round(COALESCE(m{c}, 0.0), {d}) AS {c}_n1" for c, d in _DIGITS.items())
_AVGS = ", ".join(f"avg({c}) AS m{c}" for c in NODE_FEATURES)


@query(
    "n10_neighbour_mean_features",
    f"""SELECT n.id, {_MEANS} FROM node_vector n LEFT JOIN
        (SELECT e.dst AS id, {_AVGS} FROM stepped_edge e JOIN node_vector v ON e.src = v.id
         WHERE e.visible_step <= {SPLIT.train_max} GROUP BY 1) m ON n.id = m.id""",
)
def neighbour_mean_features(spark: SparkSession, folder: str) -> DataFrame:
    means = graph.neighbour_means(
        inputs.train_edges(spark, folder), graph_vectors(spark, folder), NODE_FEATURES, "_n1"
    )
    return means.select("id", *[F.round(f"{c}_n1", d).alias(f"{c}_n1") for c, d in _DIGITS.items()])


_STATS = ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in NODE_FEATURES)
_SCALED = ", ".join(f"round((v.{c} - m{c}) / s{c}, 6) AS {c}" for c in NODE_FEATURES)


@query(
    "n11_standardize_train_only",
    f"""SELECT v.id, {_SCALED} FROM node_vector v CROSS JOIN
        (SELECT {_STATS} FROM node_vector JOIN graph_node USING (id)
         WHERE label IS NOT NULL AND step <= {SPLIT.train_max})""",
)
def standardize_train_only(spark: SparkSession, folder: str) -> DataFrame:
    vectors = graph_vectors(spark, folder)
    train = labelled(inputs.nodes(spark, folder)).filter(F.col("step") <= SPLIT.train_max).select("id")
    stats = standardize_stats(vectors.join(train, "id", "left_semi"), NODE_FEATURES)
    scaled = standardize(vectors, stats)
    return scaled.select("id", *[F.round(c, 6).alias(c) for c in NODE_FEATURES])


@query("a9_agg_base_rate_labelled", """
    SELECT step, count(*) AS n, count(*) FILTER (WHERE label = 1) AS illicit,
           CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / count(*) AS illicit_rate
    FROM graph_node WHERE label IS NOT NULL GROUP BY step""")
def agg_base_rate_labelled(spark: SparkSession, folder: str) -> DataFrame:
    return base_rate_labelled(inputs.nodes(spark, folder))


@query("a10_agg_base_rate_all", """
    SELECT step, count(*) AS n, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / count(*) AS illicit_share
    FROM graph_node GROUP BY step""")
def agg_base_rate_all(spark: SparkSession, folder: str) -> DataFrame:
    return base_rate_all(inputs.nodes(spark, folder))
