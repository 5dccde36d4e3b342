"""Evaluation figures of scored rows, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cumulative import running_sums


def rank_metrics(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Average precision (step sum over distinct scores) and ROC-AUC (ties count
    half) per group. Rows with equal scores are folded first; the running counts
    then use range partitions, never a single task."""
    folded = scored.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    running = running_sums(
        folded, [F.desc("score")], {"tp": F.col("pos"), "seen": F.col("n")}, by=by
    )
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    before = F.col("tp") - pos
    sums = running.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.sum("pos").alias("positives"),
        F.sum(pos * F.col("tp") / F.col("seen")).alias("ap"),
        F.sum((neg * (2 * before + pos)).cast("decimal(38,0)")).alias("pairs_twice"),
    )
    positives = F.col("positives")
    negatives = F.col("rows") - positives
    return sums.select(
        *by,
        "rows",
        "positives",
        F.try_divide(F.col("ap"), positives.cast("double")).alias("pr_auc"),
        F.try_divide(
            F.col("pairs_twice").cast("double"),
            2 * positives.cast("double") * negatives.cast("double"),
        ).alias("roc_auc"),
    )


def threshold_metrics(
    scored: DataFrame,
    by: Sequence[str] = (),
    threshold: float = 0.5,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """Precision, recall and F1 at a fixed threshold; empty denominators give 0."""
    hit, actual = F.col(score) >= threshold, F.col(label) == 1
    tp = F.count_if(hit & actual).cast("double")
    called, real = F.count_if(hit).cast("double"), F.count_if(actual).cast("double")

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eval"),
        (real / F.count(F.lit(1))).alias("illicit_rate"),
        share(tp, called).alias("precision"),
        share(tp, real).alias("recall"),
        share(2 * tp, called + real).alias("f1"),
    )


def base_rate_labelled(rows: DataFrame, step: str = "step", label: str = "label") -> DataFrame:
    """Per step over labelled rows only: count, illicit and illicit share."""
    illicit = F.count_if(F.col(label) == 1)
    return rows.filter(F.col(label).isNotNull()).groupBy(step).agg(
        F.count(F.lit(1)).alias("n"),
        illicit.alias("illicit"),
        (illicit / F.count(F.lit(1))).alias("illicit_rate"),
    )


def base_rate_all(rows: DataFrame, step: str = "step", label: str = "label") -> DataFrame:
    """Per step over all rows; an unknown label counts as not illicit."""
    return rows.groupBy(step).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(label) == 1) / F.count(F.lit(1))).alias("illicit_share"),
    )


def seed_statistics(runs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of both figures over seeds."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("pr_auc").alias("mean_pr_auc"),
        F.stddev_pop("pr_auc").alias("std_pr_auc"),
        F.avg("roc_auc").alias("mean_roc_auc"),
        F.stddev_pop("roc_auc").alias("std_roc_auc"),
    )
