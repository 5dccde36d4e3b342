"""Scenario rules over bank transactions.

Every scenario works on tumbling calendar periods and returns the alert frame
(scenario, entity, reason, details). Amounts are summed as decimals, so the
result does not depend on the partitioning. Single scenarios aggregate on the map
side first; all together they move the payments to account and period once. No group
is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.errors import DataQualityError
from tidewatch.functions.columns import (
    ExactSum, day_text, details_text, exact_amount, money_text, period_start,
)
from tidewatch.operators.community import dense_pairs, pairs_in_groups, undirected_edges
from tidewatch.operators.cycles import find_cycles, transfer_pairs
from tidewatch.session import materialize
from tidewatch.sources.files import union_all

ALERT_COLUMNS = ["scenario", "entity", "reason", "details"]

# The reason text of every scenario.
REASONS = {
    "structuring": "multiple sub-threshold payments in one day",
    "velocity": "high outgoing transaction count in one day",
    "rapid-churn": "inflow paid out the same day with minimal retention",
    "fan-in": "many distinct counterparties paying into one account in one day",
    "fan-out": "one account paying out to many distinct counterparties in one day",
    "circular-flow": "round-trip flow: funds cycle back within one day",
    "dense-community": "two accounts share an abnormal number of counterparties in one day",
}


def as_alerts(df: DataFrame, scenario: str, parts: list[tuple[str, Column]]) -> DataFrame:
    """Alert rows from a frame with ``entity`` and ``period``."""
    return df.select(
        F.lit(scenario).alias("scenario"),
        F.col("entity"),
        F.lit(REASONS[scenario]).alias("reason"),
        details_text([*parts, ("window", day_text("period"))]).alias("details"),
    )


def in_currency(cfg: RuleConfig) -> Column:
    return F.col("payment_currency") == cfg.currency


def in_band(amount: Column, cfg: RuleConfig) -> Column:
    return (amount >= F.lit(cfg.structuring_floor)) & (amount < F.lit(cfg.reporting_threshold))


def with_period(tx: DataFrame, cfg: RuleConfig) -> DataFrame:
    """Transactions with their period and exact amounts."""
    return tx.withColumns(
        {
            "period": period_start("tx_time", cfg.window),
            "amount_paid": exact_amount(tx, "amount_paid"),
            "amount_received": exact_amount(tx, "amount_received"),
        }
    )


# --- structuring ------------------------------------------------------------


def _structuring_alerts(grouped: DataFrame, cfg: RuleConfig) -> DataFrame:
    fired = grouped.filter(
        (F.col("txs") >= cfg.structuring_min_txs) & (F.col("total") >= F.lit(cfg.structuring_total))
    )
    band = f"[{cfg.structuring_floor:.0f},{cfg.reporting_threshold:.0f})"
    return as_alerts(
        fired,
        "structuring",
        [
            ("txs", F.col("txs")),
            ("counterparties", F.col("counterparties")),
            ("total_usd", money_text(F.col("total"))),
            ("band_usd", F.lit(band)),
        ],
    )


def structuring(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Several payments just below the reporting threshold in one period."""
    # compared as stored, so that the bounds reach the scan
    band = with_period(tx.filter(in_currency(cfg) & in_band(F.col("amount_paid"), cfg)), cfg)
    grouped = band.groupBy(F.col("from_account").alias("entity"), "period").agg(
        F.count(F.lit(1)).alias("txs"),
        F.count_distinct("to_account").alias("counterparties"),
        F.sum("amount_paid").alias("total"),
    )
    return _structuring_alerts(grouped, cfg)


# --- velocity ---------------------------------------------------------------


def _velocity_alerts(grouped: DataFrame, cfg: RuleConfig) -> DataFrame:
    fired = grouped.filter(F.col("txs") >= cfg.velocity_min_txs)
    return as_alerts(fired, "velocity", [("txs", F.col("txs"))])


def velocity(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """High number of outgoing payments, all currencies."""
    grouped = (
        tx.withColumn("period", period_start("tx_time", cfg.window))
        .groupBy(F.col("from_account").alias("entity"), "period")
        .agg(F.count(F.lit(1)).alias("txs"))
    )
    return _velocity_alerts(grouped, cfg)


# --- rapid churn ------------------------------------------------------------


def pass_through(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Money in, first arrival and money out after it, per account and period.

    Both legs of every payment are first summed per account and timestamp.
    Timestamps are whole minutes, so after that an account has at most 1,440
    rows per day and the ordering window stays small even where one account
    holds a large share of all payments. No join is needed, and each amount is
    counted once.
    """
    usd = with_period(tx, cfg).filter(in_currency(cfg))
    legs = usd.select(
        "period",
        "tx_time",
        F.inline(
            F.array(
                F.struct(
                    F.col("to_account").alias("entity"),
                    F.col("amount_received").alias("received"),
                    F.lit(None).cast(usd.schema["amount_paid"].dataType).alias("paid"),
                ),
                F.struct(
                    F.col("from_account").alias("entity"),
                    F.lit(None).cast(usd.schema["amount_received"].dataType).alias("received"),
                    F.col("amount_paid").alias("paid"),
                ),
            )
        ),
    )
    instants = legs.groupBy("entity", "period", "tx_time").agg(
        F.sum("received").alias("received"), F.sum("paid").alias("paid")
    )
    arrival = F.min(F.when(F.col("received").isNotNull(), F.col("tx_time"))).over(
        Window.partitionBy("entity", "period")
    )
    return (
        instants.withColumn("first_in", arrival)
        .groupBy("entity", "period")
        .agg(
            F.sum("received").alias("received"),
            F.min("first_in").alias("first_in"),
            F.sum(F.when(F.col("tx_time") >= F.col("first_in"), F.col("paid"))).alias("paid_out"),
        )
    )


def rapid_churn(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Most of a period's inflow leaves again in the same period. If the inflow is zero
    the share kept has no value; the alert says so."""
    return _churn_alerts(pass_through(tx, cfg), cfg)


def _churn_alerts(flow: DataFrame, cfg: RuleConfig) -> DataFrame:
    keep = F.lit(1 - cfg.churn_max_retained)
    fired = flow.filter(F.col("paid_out") >= keep * F.col("received"))
    ratio = F.try_divide(F.col("paid_out").cast("double"), F.col("received").cast("double"))
    retained = F.round(100 * (1 - ratio), 1).cast("decimal(38,1)").cast("string")
    return as_alerts(
        fired,
        "rapid-churn",
        [
            ("received_usd", money_text(F.col("received"))),
            ("paid_out_usd", money_text(F.col("paid_out"))),
            ("retained_pct", F.coalesce(retained, F.lit("undefined"))),
        ],
    )


# --- fan-in / fan-out -------------------------------------------------------


def _fan_alerts(grouped: DataFrame, scenario: str, cfg: RuleConfig) -> DataFrame:
    fired = grouped.filter(
        (F.col("counterparties") >= cfg.fan_min_counterparties)
        & (F.col("total") >= F.lit(cfg.fan_min_amount))
    )
    return as_alerts(
        fired,
        scenario,
        [
            ("counterparties", F.col("counterparties")),
            ("total_usd", money_text(F.col("total"))),
        ],
    )


def _fan(tx: DataFrame, scenario: str, entity: str, partner: str, cfg: RuleConfig) -> DataFrame:
    grouped = (
        with_period(tx, cfg)
        .filter(in_currency(cfg))
        .groupBy(F.col(entity).alias("entity"), "period")
        .agg(
            F.count_distinct(partner).alias("counterparties"),
            F.sum("amount_paid").alias("total"),
        )
    )
    return _fan_alerts(grouped, scenario, cfg)


def fan_in(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return _fan(tx, "fan-in", "to_account", "from_account", cfg)


def fan_out(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return _fan(tx, "fan-out", "from_account", "to_account", cfg)


# --- circular flow / dense community ----------------------------------------


def _circular_alerts(pairs: DataFrame, cfg: RuleConfig) -> DataFrame:
    return as_alerts(
        find_cycles(pairs, cfg),
        "circular-flow",
        [
            ("path", F.col("path")),
            ("amt_out_usd", money_text(F.col("amt_out"))),
            ("amt_back_usd", money_text(F.col("amt_back"))),
            ("cycle_len", F.col("cycle_len")),
        ],
    )


def circular_flow(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Money that returns to its origin over two or three transfers."""
    large = tx.filter(in_currency(cfg) & (F.col("amount_paid") >= F.lit(cfg.cycle_min_leg)))
    legs = with_period(large, cfg)
    pairs = transfer_pairs(legs.withColumn("amt", F.col("amount_paid")))
    return _circular_alerts(pairs, cfg)


def _community_alerts(pairs: DataFrame) -> DataFrame:
    return as_alerts(
        pairs.withColumn("entity", F.col("acct")),
        "dense-community",
        [
            ("pair", F.concat_ws("|", "acct", "other")),
            ("shared_counterparties", F.col("shared")),
        ],
    )


def dense_community(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Two accounts with many common counterparties in one period."""
    stamped = tx.withColumn("period", period_start("tx_time", cfg.window))
    edges = undirected_edges(stamped)
    return _community_alerts(dense_pairs(edges, cfg.community_min_shared, cfg.community_max_hub_degree))


SCENARIOS = {
    "structuring": structuring,
    "velocity": velocity,
    "rapid-churn": rapid_churn,
    "fan-in": fan_in,
    "fan-out": fan_out,
    "circular-flow": circular_flow,
    "dense-community": dense_community,
}


# --- all scenarios ----------------------------------------------------------


def entity_periods(tx: DataFrame, cfg: RuleConfig) -> DataFrame:
    """One row per account and period with what six of the seven scenarios ask of it. Both
    legs of every payment move once, to their account and period, and are sorted once there,
    by partner and direction: windows in that order find the first arrival, number the
    partners and mark the first leg of each, so one aggregation does the rest. ``partners``
    is null where an account has one partner or more than the hub rule allows, and never
    held beyond that."""
    usd, paid, got = in_currency(cfg), F.col("amount_paid"), F.col("amount_received")
    stamped = with_period(tx, cfg)
    sums = {
        name: ExactSum(stamped.schema[column].dataType)
        for name, column in (("paid", "amount_paid"), ("received", "amount_received"))
    }
    stamped = stamped.select(
        "period", "from_account", "to_account", usd.alias("usd"), (usd & in_band(paid, cfg)).alias("band"),
        F.when(usd, F.col("tx_time")).alias("at"),
        F.when(usd, sums["paid"].units(paid)).alias("paid"),
        F.when(usd, sums["received"].units(got)).alias("received"),
    )
    nothing = F.lit(None).cast(stamped.schema["received"].dataType).alias("received")
    ends = F.array(
        F.struct(
            F.col("from_account").alias("entity"), F.col("to_account").alias("partner"),
            F.lit(True).alias("sent"), nothing,
        ),
        F.struct(
            F.col("to_account").alias("entity"), F.col("from_account").alias("partner"),
            F.lit(False).alias("sent"), F.col("received"),
        ),
    )
    kinds = [F.col(name).desc() for name in ("usd", "band")]
    legs = (
        stamped.select("period", F.inline(ends), "usd", "band", "at", "paid")
        .repartition("period", "entity")
        .sortWithinPartitions("period", "entity", "partner", "sent", *kinds)
    )
    most = cfg.community_max_hub_degree
    own = Window.partitionBy("period", "entity").orderBy("partner")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    way = Window.partitionBy("period", "entity", "partner", "sent").orderBy(*kinds)
    marked = legs.withColumns(
        {
            "first_in": F.min(F.when(F.col("received").isNotNull(), F.col("at"))).over(whole),
            "place": F.dense_rank().over(own),
            "new": F.row_number().over(way) == 1,
        }
    )
    sent, new = F.col("sent"), F.col("new")
    known = new & F.col("partner").isNotNull()
    amounts = {
        "band_total": ("paid", sent & F.col("band")),
        "out_total": ("paid", sent),
        "in_total": ("paid", ~sent),
        "received": ("received", ~sent),
        "paid_out": ("paid", sent & (F.col("at") >= F.col("first_in"))),
    }
    counts = {"band": sent & F.col("band"), "out": sent & F.col("usd"), "in": ~sent & F.col("usd")}
    summed = marked.groupBy("period", "entity").agg(
        F.count_if(sent).alias("txs"),
        *[F.count_if(test).alias(f"{name}_txs") for name, test in counts.items()],
        # US dollars and the band come first, so the first leg of a direction tells of all
        *[F.count_if(known & test).alias(f"{name}_partners") for name, test in counts.items()],
        *[
            part
            for name, (column, test) in amounts.items()
            for part in sums[column].parts(name, F.when(test, F.col(column)))
        ],
        # a partner met in both directions is told twice
        F.array_distinct(
            F.collect_list(F.when(new & (F.col("place") <= most + 1), F.struct("partner")))
        ).alias("partners"),
    )
    return summed.select(
        "period", "entity", "txs", *[f"{name}_{what}" for what in ("txs", "partners") for name in counts],
        *[sums[column].total(name).alias(name) for name, (column, _) in amounts.items()],
        F.when(
            F.size("partners").between(2, most), F.transform("partners", lambda p: p["partner"])
        ).alias("partners"),
    )


def all_scenarios(tx: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Union of the seven scenarios with two passes over the transactions: one row per
    account and period feeds six of them, cycles need the pairs of accounts."""
    seen = materialize(entity_periods(tx, cfg), "entity-periods")

    def side(count: str, total: str, partners: str) -> DataFrame:
        return seen.filter(F.col(count) > 0).select(
            "entity", "period", F.col(count).alias("txs"), F.col(total).alias("total"),
            F.col(partners).alias("counterparties"),
        )

    groups = seen.filter("partners IS NOT NULL").select(
        "period", F.col("entity").alias("cpty"), F.col("partners").alias("accts")
    )
    alerts = union_all(
        [
            _structuring_alerts(side("band_txs", "band_total", "band_partners"), cfg),
            _velocity_alerts(seen.filter("txs > 0"), cfg),
            _churn_alerts(seen, cfg),
            _fan_alerts(side("in_txs", "in_total", "in_partners"), "fan-in", cfg),
            _fan_alerts(side("out_txs", "out_total", "out_partners"), "fan-out", cfg),
            circular_flow(tx, cfg),
            _community_alerts(pairs_in_groups(groups, cfg.community_min_shared)),
        ]
    )
    if sorted(alerts.columns) != sorted(ALERT_COLUMNS):
        raise DataQualityError(f"alert columns are {sorted(alerts.columns)}")
    return alerts
