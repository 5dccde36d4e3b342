"""Population stability index of numeric columns and of category shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DriftConfig
from tidewatch.errors import DataQualityError
from tidewatch.functions.quantiles import exact_quantiles, unpivot


def probabilities(bins: int) -> list[float]:
    """Interior probabilities, spaced as equal floating-point steps."""
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def quantile_edges(reference: DataFrame, columns: Sequence[str], cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """(column, edges, lowest, highest) from the reference period."""
    return exact_quantiles(reference, columns, probabilities(cfg.bins))


def bin_of(value: Column, edges: Sequence[float], lowest: float, highest: float) -> Column:
    """Index of the bin [edge_i, edge_i+1) with open outer ends. A constant
    reference gets three bins: below, equal and above."""
    if lowest == highest:
        return F.when(value < lowest, 0).when(value == lowest, 1).otherwise(2)
    return sum(((value >= edge).cast("int") for edge in edges), F.lit(0))


def histogram(df: DataFrame, columns: Sequence[str], edges: DataFrame) -> DataFrame:
    """(column, bin, reference, actual) counts; ``df`` has the boolean
    ``is_reference``. The edges are one short row per column, so they become
    literals; the counts fold on the map side to a few rows per column."""
    known = {r["column"]: r for r in edges.collect()}
    places = {
        c: bin_of(F.col(c).cast("double"), known[c]["edges"], known[c]["lowest"], known[c]["highest"])
        for c in columns
    }
    return unpivot(df, places, ["is_reference"]).groupBy("column", F.col("value").alias("bin")).agg(
        F.count_if("is_reference").alias("reference"),
        F.count_if(~F.col("is_reference")).alias("actual"),
    )


def _index(bins: DataFrame, key: str, cfg: DriftConfig) -> DataFrame:
    """PSI from per-bin counts. A bin empty on both sides adds nothing, so only
    bins with rows are needed. Shares come from per-key totals."""
    totals = bins.groupBy(key).agg(
        F.sum("reference").alias("all_reference"), F.sum("actual").alias("all_actual")
    )
    floor = F.lit(cfg.floor)
    e = F.greatest(F.col("reference") / F.col("all_reference"), floor)
    a = F.greatest(F.col("actual") / F.col("all_actual"), floor)
    return (
        bins.join(F.broadcast(totals), key)
        .withColumn("part", (a - e) * F.ln(a / e))
        .groupBy(key)
        .agg(F.sum("part").alias("psi"))
    )


def with_status(scores: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    status = (
        F.when(F.col("psi") > cfg.breach, "breach")
        .when(F.col("psi") > cfg.watch, "watch")
        .otherwise("ok")
    )
    return scores.withColumn("status", status)


def psi_drift(
    df: DataFrame,
    columns: Sequence[str],
    cfg: DriftConfig = DriftConfig(),
    edges: DataFrame | None = None,
) -> DataFrame:
    """(column, psi, status) of the actual rows against the reference rows."""
    if edges is None:
        edges = quantile_edges(df.filter("is_reference"), columns, cfg)
    return with_status(_index(histogram(df, columns, edges), "column", cfg), cfg)


def category_stability(
    df: DataFrame, column: str, cfg: DriftConfig = DriftConfig()
) -> DataFrame:
    """The same index over the shares of a categorical column."""
    bins = (
        df.groupBy(F.col(column).alias("bin"))
        .agg(
            F.count_if("is_reference").alias("reference"),
            F.count_if(~F.col("is_reference")).alias("actual"),
        )
        .withColumn("column", F.lit(column))
    )
    return with_status(_index(bins, "column", cfg), cfg)


def check_breach(drift: DataFrame) -> DataFrame:
    """Raise if any column is in breach; call it after the table is written."""
    bad = drift.filter("status = 'breach'").orderBy(F.desc("psi")).limit(20).collect()
    if bad:
        listed = ", ".join(f"{r['column']} {r['psi']:.4f}" for r in bad)
        raise DataQualityError(f"drift breach (largest first): {listed}")
    return drift
