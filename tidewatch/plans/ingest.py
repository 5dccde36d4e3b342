"""Ingest jobs: verify raw files, check all gates, then write typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import IngestConfig, SplitConfig
from tidewatch.operators import gates
from tidewatch.sources import files, manifest, schemas

# The raw file names of both datasets.
GRAPH_FILES = {
    "features": "elliptic_txs_features.csv",
    "classes": "elliptic_txs_classes.csv",
    "edges": "elliptic_txs_edgelist.csv",
}
BANK_FILES = {"transactions": "HI-Small_Trans.csv", "accounts": "HI-Small_accounts.csv"}


def _verify(spark: SparkSession, raw: str, pins: dict, dataset: str) -> None:
    frame = manifest.pins_from_manifest(spark, pins, dataset)
    manifest.verify_files(frame, manifest.hash_files(spark, f"{raw}/*"))


def ingest_bank(
    spark: SparkSession, raw: str, store: str, pins: dict, cfg: IngestConfig = IngestConfig()
) -> DataFrame:
    """Write ``bank_transaction`` and ``bank_account``; returns the gate report."""
    _verify(spark, raw, pins, "hi-small")
    tx_raw = files.scan_csv(
        spark, f"{raw}/{BANK_FILES['transactions']}", schemas.BANK_TX_RAW, header=True
    )
    accounts = files.scan_csv(
        spark, f"{raw}/{BANK_FILES['accounts']}", schemas.BANK_ACCOUNTS_RAW, header=True
    )
    report = files.union_all(
        [
            gates.min_count(tx_raw, cfg.bank_min_tx, "transactions"),
            gates.distinct_accounts(tx_raw, cfg.bank_min_accounts),
            gates.min_count(accounts, cfg.bank_min_accounts, "account_rows"),
            gates.rate_band(
                tx_raw, "is_laundering", cfg.flagged_rate, cfg.flagged_tolerance, cfg.flagged_count
            ),
        ]
    )
    gates.enforce(report)
    files.export_sorted(files.bank_transactions(tx_raw), f"{store}/bank_transaction")
    files.export_sorted(accounts, f"{store}/bank_account")
    return report


def ingest_graph(
    spark: SparkSession, raw: str, store: str, pins: dict,
    cfg: IngestConfig = IngestConfig(), split: SplitConfig = SplitConfig(),
) -> DataFrame:
    """Write ``graph_tx``, ``graph_tx_features`` and ``graph_edge``."""
    _verify(spark, raw, pins, "elliptic")

    def scan(name: str, schema, header: bool) -> DataFrame:
        return files.scan_csv(spark, f"{raw}/{GRAPH_FILES[name]}", schema, header=header)

    features = scan("features", schemas.graph_features_raw(cfg.feature_count), False)
    classes = scan("classes", schemas.GRAPH_CLASSES_RAW, True)
    edges = scan("edges", schemas.GRAPH_EDGES_RAW, True)
    tx = files.graph_transactions(classes)
    ends = edges.select(F.col("txId1").alias("src"), F.col("txId2").alias("dst"))
    ids = features.select(F.col("txId").alias("id"))
    report = files.union_all(
        [
            gates.exact_count(features, cfg.graph_tx, "transactions"),
            gates.exact_count(edges, cfg.graph_edges, "edges"),
            gates.class_distribution(tx, "class_label", cfg.graph_classes),
            gates.step_set(features, "time_step", split.first_step, split.last_step),
            gates.referential(ids, ends),
            gates.same_ids(classes, features, "txId"),
        ]
    )
    gates.enforce(report)
    files.export_sorted(tx, f"{store}/graph_tx", ["tx_id"])
    files.export_sorted(files.graph_features(features), f"{store}/graph_tx_features", ["tx_id"])
    files.export_sorted(files.graph_edges(edges), f"{store}/graph_edge")
    return report
