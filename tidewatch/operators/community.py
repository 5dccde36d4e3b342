"""Account pairs that share many counterparties in one period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize

SALTS = 32
PAIR_BITS = 40  # of the hash that counts pairs


def undirected_edges(stamped: DataFrame) -> DataFrame:
    """Distinct (period, acct, cpty), both directions of every payment."""
    both = F.array(
        F.struct(F.col("from_account").alias("acct"), F.col("to_account").alias("cpty")),
        F.struct(F.col("to_account").alias("acct"), F.col("from_account").alias("cpty")),
    )
    return stamped.select("period", F.inline(both)).distinct()


def without_hubs(edges: DataFrame, max_degree: int) -> DataFrame:
    """Drop counterparties with more than ``max_degree`` accounts in a period.

    The list of hubs is short (edges / max_degree at most), but the rows to drop
    may be a large share of the table under one key. Both sides carry a salt, so
    the rows of one hub spread over many tasks.
    """
    hubs = (
        edges.groupBy("period", "cpty")
        .count()
        .filter(F.col("count") > max_degree)
        .select("period", "cpty", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("acct"), F.lit(SALTS)).cast("int"))
    return salted.join(hubs, ["period", "cpty", "salt"], "left_anti").drop("salt")


def light_groups(edges: DataFrame, max_degree: int) -> DataFrame:
    """(period, cpty, accts) of every counterparty with 2 to ``max_degree`` accounts.
    ``edges`` are distinct. Of a larger group no task hands on more than
    ``max_degree`` + 1 accounts, neither before nor after the exchange."""
    place = F.row_number().over(Window.partitionBy("period", "cpty").orderBy("acct"))
    return (
        edges.withColumn("place", place)
        .filter(F.col("place") <= max_degree + 1)
        .groupBy("period", "cpty")
        .agg(F.collect_list("acct").alias("accts"))
        .filter(F.size("accts").between(2, max_degree))
    )


def pairs_in_groups(groups: DataFrame, min_shared: int) -> DataFrame:
    """(period, acct, other, shared) with acct < other and shared >= min_shared, from
    groups (period, cpty, accts) of bounded size.

    An account below ``min_shared`` groups cannot be part of a result and is dropped
    before pairing. Pairs are counted by a hash of 40 bits first, which keeps their shuffle
    narrow; a short list of groups stands for very many pairs, so they meet in the
    exchange and not in a map of the task that reads the groups. The few that may qualify
    are written down; what is counted by name has passed them. Hashes that collide only
    add candidates, so the result is exact.
    """
    busy = F.count(F.lit(1)).over(Window.partitionBy("period", "acct"))
    kept = materialize(
        groups.select("period", "cpty", F.explode("accts").alias("acct"))
        .withColumn("groups", busy)
        .filter(F.col("groups") >= min_shared)
        .groupBy("period", "cpty")
        .agg(F.sort_array(F.collect_list("acct")).alias("accts"))
        .filter(F.size("accts") > 1)
        .select("period", "accts"),
        "community-groups",
    )
    firsts = kept.select("period", "accts", F.posexplode("accts").alias("at", "acct"))
    pairs = firsts.select(
        "period", "acct",
        F.explode(F.slice("accts", F.col("at") + 2, F.size("accts"))).alias("other"),
    ).withColumn("pair", F.xxhash64("period", "acct", "other").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)))
    enough = F.col("shared") >= min_shared
    candidates = materialize(
        pairs.select("pair").repartition("pair").groupBy("pair").agg(F.count(F.lit(1)).alias("shared")).filter(enough).select("pair"),
        "community-candidates",
    )
    return (
        pairs.join(candidates, "pair", "left_semi")
        .groupBy("period", "acct", "other")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(enough)
    )


def dense_pairs(edges: DataFrame, min_shared: int, max_degree: int) -> DataFrame:
    """Pairs of accounts with at least ``min_shared`` common counterparties, none of which
    has more than ``max_degree`` accounts in the period."""
    return pairs_in_groups(light_groups(edges, max_degree), min_shared)
