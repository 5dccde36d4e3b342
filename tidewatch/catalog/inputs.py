"""Inputs and stage tables of the registered queries.

A stage table is what one job hands to the next: it is written once per
application and folder and read by every later query.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig, SplitConfig, TriageConfig
from tidewatch.operators import accounts, alerts, communities, graph, rules, triage
from tidewatch.session import materialize
from tidewatch.sources import adapters

# The given tables are sparse: at most 5 payments per account and day, so the
# rules run on months with thresholds that fit.
RULES = RuleConfig(
    window="month",
    structuring_floor=Decimal("40000"),
    reporting_threshold=Decimal("60000"),
    velocity_min_txs=12,
    fan_min_amount=Decimal("300000"),
    community_min_shared=6,
    community_max_hub_degree=16,
)
TRIAGE = TriageConfig()
SPLIT = SplitConfig()

_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def stage(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGES:
        _STAGES[key] = materialize(build(), name)
    return _STAGES[key]


def tx(spark: SparkSession, folder: str) -> DataFrame:
    """The payments, joined once per application and folder."""
    return stage(spark, folder, "bank-tx", lambda: adapters.bank_tx(spark, folder))


def alert_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "alerts", lambda: rules.all_scenarios(tx(spark, folder), RULES)
    )


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts on any flagged payment."""
    return stage(
        spark, folder, "flagged", lambda: alerts.flagged_accounts(tx(spark, folder))
    )


def scenario_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "stats",
        lambda: alerts.scenario_stats(alert_table(spark, folder), flagged(spark, folder)),
    )


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "profile", lambda: accounts.daily_profile(tx(spark, folder), TRIAGE)
    )


def cuts(spark: SparkSession, folder: str) -> triage.CutPoints:
    return triage.cut_points(tx(spark, folder), TRIAGE)


def meta(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "meta", lambda: triage.triage_meta(tx(spark, folder), TRIAGE))


def evaluation_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "evaluation-accounts",
        lambda: triage.evaluation_accounts(tx(spark, folder), cuts(spark, folder)),
    )


def alert_features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        asks = triage.with_alert_day(alert_table(spark, folder)).select(
            F.col("entity").alias("acct"), F.col("alert_day").alias("day")
        )
        # from the payments, not from the stored profile: what is made at its account stays there
        return accounts.history_features(accounts.daily_profile(tx(spark, folder), TRIAGE), asks)

    return stage(spark, folder, "alert-features", build)


def plain_score() -> Column:
    """Outgoing share of an account's payments: a score both engines compute
    alike, in place of a fitted model."""
    outgoing = F.col("tx_out_count").cast("double")
    return F.try_divide(outgoing, outgoing + F.col("tx_in_count").cast("double"))


def fused(spark: SparkSession, folder: str, condensed: bool = False) -> DataFrame:
    """All alerts with their scores, or only those that can enter the queue."""
    staged = triage.with_alert_day(alert_table(spark, folder))
    scores = alert_features(spark, folder).select(
        "acct", "day", plain_score().alias("ml_component")
    )
    return triage.fused_alerts(
        triage.condense(staged) if condensed else staged, scenario_stats(spark, folder), scores, TRIAGE
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "queue", lambda: triage.ranked_queue(fused(spark, folder, True)))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.graph_nodes(spark, folder)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "edges", lambda: adapters.graph_edges(spark, folder))


def contact_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "contacts",
        lambda: graph.contacts(nodes(spark, folder), edges(spark, folder)),
    )


def train_edges(spark: SparkSession, folder: str) -> DataFrame:
    stepped = graph.edge_steps(nodes(spark, folder), edges(spark, folder))
    return graph.inductive_edges(stepped, SPLIT.train_max)


def community_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "communities",
        lambda: communities.communities(train_edges(spark, folder)),
    )


def graph_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return stage(
        spark, folder, "graph-features",
        lambda: graph.graph_features(
            nodes(spark, folder), edges(spark, folder), community_table(spark, folder)
        ),
    )
