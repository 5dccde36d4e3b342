"""Rules, statistics and triage as jobs over a table folder."""

from __future__ import annotations

import pytest

from tidewatch.config import ModelConfig, TriageConfig
from tidewatch.errors import DataQualityError
from tidewatch.plans import alerting


def market():
    """Twenty days of small trades, flags in both label windows, two patterns at the end."""
    rows = [(f"{d} {8 + i}:00", f"buyer{(d + i) % 7}", f"seller{(d * i) % 5}", 30 + d) for d in range(11, 31) for i in (1, 2, 3)]
    rows += [("25 20:00", "buyer3", "seller1", 15, {"flag": 1}), ("29 20:00", "buyer2", "seller4", 15, {"flag": 1})]
    rows += [(f"28 {10 + i}:30", "buyer2", f"shop{i}", 12000) for i in range(5)]
    rows += [(f"29 {10 + i}:30", "buyer5", "seller2", 9300) for i in range(3)]
    return rows


def test_jobs_in_order(spark, payments, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(DataQualityError, match="ingest"):
        alerting.run_rules(spark, folder)
    payments(market()).write.parquet(f"{folder}/bank_transaction")
    with pytest.raises(DataQualityError, match="run the rules first"):
        alerting.run_alert_stats(spark, folder)
    alerts = alerting.run_rules(spark, folder)
    assert {(r["scenario"], r["entity"]) for r in alerts.collect()} == {("fan-out", "buyer2"), ("structuring", "buyer5")}
    with pytest.raises(DataQualityError, match="run alert statistics first"):
        alerting.run_triage(spark, folder)
    alerting.run_alert_stats(spark, folder)
    models = ModelConfig(boosted_trees=3, min_rows_per_leaf=1, leaves=4)
    out = alerting.run_triage(spark, folder, TriageConfig(operating_k=10, precision_ks=(1, 2)), models)
    queue = out["alert_queue"].orderBy("rank").collect()
    fused = [r["fused_score"] for r in queue]
    assert fused == sorted(fused, reverse=True) and len(queue) == 2
    assert {r["scope"] for r in out["triage_kpi"].collect()} == {"overall", "fan-out", "structuring"}
    assert out["model_figures"].first()["positives"] > 0


def test_empty_alerts_stop_triage(spark, payments, tmp_path):
    folder = str(tmp_path / "store")
    tx = payments([("01 10:00", "A", "B", 5), ("09 10:00", "A", "B", 5)])
    tx.write.parquet(f"{folder}/bank_transaction")
    alerting.run_rules(spark, folder)
    with pytest.raises(DataQualityError, match="alerts"):
        alerting.run_alert_stats(spark, folder)
    tx.limit(0).write.mode("overwrite").parquet(f"{folder}/bank_transaction")
    with pytest.raises(DataQualityError, match="transactions"):
        alerting.run_rules(spark, folder)
