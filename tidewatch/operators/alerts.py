"""Per-scenario alert statistics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _midnight_after(day: date) -> Column:
    return F.lit(str(day + timedelta(days=1))).cast("timestamp_ntz")


def flagged_accounts(
    tx: DataFrame, after: date | None = None, until: date | None = None
) -> DataFrame:
    """Distinct accounts on either side of a flagged payment, optionally with
    its calendar day in the half-open window (after, until]. The bounds are
    compared with the raw timestamp, so the scan can use them."""
    flagged = tx.filter(F.col("is_laundering") == 1)
    if after is not None:
        flagged = flagged.filter(F.col("tx_time") >= _midnight_after(after))
    if until is not None:
        flagged = flagged.filter(F.col("tx_time") < _midnight_after(until))
    return flagged.select(F.explode(F.array("to_account", "from_account")).alias("acct")).distinct()


def scenario_stats(alerts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Alerts, distinct entities and the share of entities on a flagged payment
    per scenario. Grouping by (scenario, entity) first gives all three without
    a distinct aggregate or a second pass for the totals."""
    per_entity = alerts.groupBy("scenario", "entity").agg(F.count(F.lit(1)).alias("alerts"))
    hit = flagged.select(F.col("acct").alias("entity"), F.lit(1).alias("hit"))
    return (
        per_entity.join(hit, "entity", "left")
        .groupBy("scenario")
        .agg(
            F.sum("alerts").alias("alert_count"),
            F.count(F.lit(1)).alias("distinct_entities"),
            F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("laundering_entity_precision"),
        )
    )
