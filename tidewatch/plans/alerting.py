"""Bank track: rules, alert statistics and triage as jobs over a table folder."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import ModelConfig, RuleConfig, TriageConfig
from tidewatch.learning.matrix import assemble
from tidewatch.learning.training import fit_booster, scored
from tidewatch.operators import accounts, alerts, gates, rules, triage
from tidewatch.operators.metrics import rank_metrics
from tidewatch.session import materialize, replace_table
from tidewatch.sources.files import open_tables

TX = "bank_transaction"
TX_HINT = {TX: "ingest the bank files first"}


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    return replace_table(df, f"{folder}/{name}")


def run_rules(spark: SparkSession, folder: str, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Write ``rule_alert``; empty input stops the job before any output."""
    tx = open_tables(spark, folder, TX_HINT)[TX]
    gates.enforce(gates.not_empty(tx, "transactions"))
    return _write(rules.all_scenarios(tx, cfg), folder, "rule_alert")


def run_alert_stats(spark: SparkSession, folder: str) -> DataFrame:
    tables = open_tables(spark, folder, {"rule_alert": "run the rules first", **TX_HINT})
    gates.enforce(gates.not_empty(tables["rule_alert"], "alerts"))
    stats = alerts.scenario_stats(tables["rule_alert"], alerts.flagged_accounts(tables[TX]))
    return _write(stats, folder, "alert_scenario_stats")


def _account_rows(frame: DataFrame, extra: list[str]) -> DataFrame:
    """Vectors of the 11 features; an undefined share counts as zero."""
    rows = frame.fillna(0.0, subset=accounts.FEATURES).withColumns(
        {"id": F.col("acct"), "step": F.lit(0)}
    )
    return assemble(rows, accounts.FEATURES, ["id", "step", *extra])


def account_model(
    tx: DataFrame, profile: DataFrame, cuts: triage.CutPoints, cfg: ModelConfig = ModelConfig()
) -> tuple[Any, DataFrame]:
    """Fit on behaviour before day1 and flags in (day1, day2]; judge on behaviour
    before day2 and flags after it. Returns the model and its test figures."""
    windows = [(cuts.day1, cuts.day2), (cuts.day2, cuts.last)]
    sides = []
    for name, (start, end) in zip(("train", "test"), windows, strict=True):
        flagged = alerts.flagged_accounts(tx, start, end)
        gates.enforce(gates.not_empty(flagged, f"{name}_label_window"))
        snap = triage.label_accounts(accounts.snapshot(profile, F.lit(start)), flagged)
        rows = materialize(_account_rows(snap.withColumnRenamed("label", "y"), ["y"]), "accounts")
        gates.enforce(gates.two_classes(rows, "y", f"{name}_classes"))
        sides.append(rows)
    # accounts are few: every tree sees all of them
    model = fit_booster(sides[0], len(accounts.FEATURES), cfg.seeds[0], replace(cfg, subsample=1.0))
    return model, rank_metrics(scored(model, sides[1]))


def alert_scores(model: Any, profile: DataFrame, staged: DataFrame) -> DataFrame:
    """(acct, day, ml_component) for every alert whose account has a history."""
    asks = staged.select(F.col("entity").alias("acct"), F.col("alert_day").alias("day"))
    features = accounts.history_features(profile, asks)
    vectors = _account_rows(features, ["acct", "day"])
    return model.transform(vectors).select(
        "acct", "day", vector_to_array("probability")[1].alias("ml_component")
    )


def run_triage(
    spark: SparkSession,
    folder: str,
    cfg: TriageConfig = TriageConfig(),
    models: ModelConfig = ModelConfig(),
) -> dict[str, DataFrame]:
    """Write ``alert_queue``, ``triage_kpi`` and ``triage_meta``. All inputs are
    checked and the model is fitted before the first table is written."""
    tables = open_tables(
        spark, folder,
        {"rule_alert": "run the rules first", "alert_scenario_stats": "run alert statistics first",
         **TX_HINT},
    )
    tx = tables[TX]
    staged = triage.check_alerts(tables["rule_alert"])
    cuts = triage.cut_points(tx, cfg)
    profile = materialize(accounts.daily_profile(tx, cfg), "profile")
    model, figures = account_model(tx, profile, cuts, models)
    fused = triage.fused_alerts(
        triage.condense(staged), tables["alert_scenario_stats"],
        alert_scores(model, profile, staged), cfg
    )
    queue = triage.ranked_queue(fused)
    meta = _write(triage.triage_meta(tx, cfg), folder, "triage_meta")
    ranked = _write(queue, folder, "alert_queue")
    evaluation = triage.evaluation_accounts(tx, cuts)
    kpi = _write(triage.triage_kpi(ranked, evaluation, meta, cfg), folder, "triage_kpi")
    curve = _write(triage.precision_curve(ranked, evaluation, cfg), folder, "precision_curve")
    return {"alert_queue": ranked, "triage_kpi": kpi, "triage_meta": meta,
            "precision_curve": curve, "model_figures": figures}

