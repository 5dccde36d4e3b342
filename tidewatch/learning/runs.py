"""Runs table: one row per training run, tied to its settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import DataQualityError


def run_records(metrics: DataFrame, stage: str, settings: str) -> DataFrame:
    """Rows for the runs table from (model, seed, pr_auc, roc_auc)."""
    return metrics.select(
        F.lit(stage).alias("stage"), "model", F.col("seed").cast("bigint").alias("seed"),
        F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"),
        F.lit(settings).alias("fingerprint"), F.current_timestamp().alias("recorded_at"),
    )


def append_runs(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs in recording order; an empty table is an error."""
    runs = spark.read.parquet(path)
    if runs.isEmpty():
        raise DataQualityError("the runs table is empty; run a training stage first")
    return runs.orderBy("recorded_at", "stage", "model", "seed")
