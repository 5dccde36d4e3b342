"""Queue order, figures by hand and the strictly-before rule."""

from __future__ import annotations

from datetime import date

import pytest

from tidewatch.config import TriageConfig
from tidewatch.errors import DataQualityError
from tidewatch.operators import alerts, triage

CFG = TriageConfig(operating_k=3, precision_ks=(2,), curve_depths=(1, 2, 5, 50))

# (scenario, entity, day, model score); rule weights by scenario
ALERTS = [
    ("velocity", "harbour", "22", 0.9), ("velocity", "mill", "23", 0.2), ("fan-in", "mill", "23", None),
    ("fan-in", "quarry", "19", None), ("fan-in", "harbour", "30", 0.1), ("rapid-churn", "depot", "28", 0.5),
    ("rapid-churn", "kiln", "21", 0.5),
]
WEIGHTS = {"velocity": 0.25, "fan-in": 0.75}


def days_of_trade():
    """Twenty days from the 11th: cuts at the 23rd and the 27th."""
    rows = [(f"{d} 08:00", f"buyer{d % 7}", f"seller{d % 5}", 40 + d) for d in range(11, 31)]
    rows += [("30 09:00", "harbour", "seller1", 10, {"flag": 1}), ("29 07:00", "buyer3", "kiln", 10, {"flag": 1})]
    rows += [("12 07:00", "mill", "quarry", 10, {"flag": 1})]  # too early to count
    return rows


def queue_of(spark):
    rows = [(s, e, "why", f"n=1;window=2022-09-{d}") for s, e, d, _ in ALERTS]
    staged = triage.check_alerts(spark.createDataFrame(
        rows, "scenario string, entity string, reason string, details string"))
    stats = spark.createDataFrame(
        [(s, 1, 1, w) for s, w in WEIGHTS.items()],
        "scenario string, alert_count long, distinct_entities long, laundering_entity_precision double")
    scores = spark.createDataFrame(
        [(e, date(2022, 9, int(d)), m) for _, e, d, m in ALERTS if m is not None], "acct string, day date, ml_component double")
    return triage.ranked_queue(triage.fused_alerts(staged, stats, scores, CFG))


def expected_queue():
    """Entities in order, from the definition of the fused score."""
    model = {(e, d): m for _, e, d, m in ALERTS if m is not None}
    best = {}
    for s, e, d, _ in ALERTS:
        ml, rule = model.get((e, d)), WEIGHTS.get(s, 0.0)
        fused = rule if ml is None else CFG.ml_weight * ml + CFG.rule_weight * rule
        key = (-fused, ml is None, -(ml or 0), e, d, s)
        best[e, d] = min(best.get((e, d), key), key)
    return [(k[5], k[3], -k[0]) for k in sorted(best.values())]


def test_cut_points_and_meta(payments):
    tx = payments(days_of_trade())
    cuts = triage.cut_points(tx, CFG)
    first, last = date(2022, 9, 11), date(2022, 9, 30)
    span = (last - first).days
    assert (cuts.day1 - first).days == round(0.6 * span) and (cuts.day2 - first).days == round(0.8 * span)
    assert cuts.days_eval == (last - cuts.day2).days
    names = {x for r in days_of_trade() for x in r[1:3]}
    assert triage.triage_meta(tx, CFG).first()["universe"] == len(names)


def test_queue_follows_the_fused_score(spark):
    rows = queue_of(spark).orderBy("rank").collect()
    want = expected_queue()
    assert [(r["scenario"], r["entity"]) for r in rows] == [(s, e) for s, e, _ in want]
    assert [r["fused_score"] for r in rows] == pytest.approx([f for _, _, f in want])
    assert [r["rank"] for r in rows] == list(range(1, len(want) + 1))


def test_figures_from_their_definitions(spark, payments):
    tx, queue = payments(days_of_trade()), queue_of(spark)
    flagged = triage.evaluation_accounts(tx, triage.cut_points(tx, CFG))
    hits = {r["acct"] for r in flagged.collect()}
    assert hits == {"harbour", "seller1", "buyer3", "kiln"}
    meta = triage.triage_meta(tx, CFG)
    universe, days = meta.first()["universe"], triage.cut_points(tx, CFG).days_eval
    for depth, cost in ((CFG.operating_k, CFG.cost_per_case), (1, 8.0)):
        kpi = {r["scope"]: r for r in triage.triage_kpi(queue, flagged, meta, CFG, k=depth, cost=cost).collect()}
        assert set(kpi) == {"overall", "velocity", "fan-in", "rapid-churn"}
        for scope, row in kpi.items():
            listed = [e for s, e, _ in expected_queue() if scope in ("overall", s)][:depth]
            true = len(set(listed) & hits)
            assert (row["alerts_investigated"], row["true_positives"]) == (len(listed), true)
            assert row["detection_rate"] == round(true / len(hits), 4)
            assert row["false_positive_rate"] == round((len(set(listed)) - true) / (universe - len(hits)), 6)
            assert row["alerts_per_day"] == round(len(listed) / days, 4)
            assert row["investigation_yield"] == round(true / len(listed), 4)
            assert row["cost_per_true_positive"] == (round(len(listed) * cost / true, 2) if true else None)
    curve = {r["k"]: r for r in triage.precision_curve(queue, flagged, CFG).collect()}
    order = [e for _, e, _ in expected_queue()]
    for k, row in curve.items():
        assert row["true_positives"] == sum(e in hits for e in order[:k])
    assert sorted(curve) == [1, 2, 5, len(order)]


def test_what_if_is_one_row_of_the_figures(spark, payments):
    tx, queue = payments(days_of_trade()), queue_of(spark)
    flagged, meta = triage.evaluation_accounts(tx, triage.cut_points(tx, CFG)), triage.triage_meta(tx, CFG)
    one = triage.what_if(queue, flagged, meta, "velocity", 2, 12.5, CFG).collect()
    again = triage.triage_kpi(queue, flagged, meta, CFG, k=2, cost=12.5).where("scope = 'velocity'").collect()
    assert len(one) == 1 and one[0]["cost_per_true_positive"] == again[0]["cost_per_true_positive"]


def test_best_alert_per_entity_and_day(spark):
    rows = [
        ("a", "E", date(2022, 9, 1), 0.1, None, 0.1, "r", "d"),
        ("b", "E", date(2022, 9, 1), 0.4, 0.2, 0.4, "r", "d"),
        ("c", "E", date(2022, 9, 1), 0.4, None, 0.4, "r", "d"),
        ("a", "E", date(2022, 9, 2), 0.0, 0.0, 0.0, "r", "d"),
    ]
    frame = spark.createDataFrame(
        rows,
        "scenario string, entity string, alert_day date, rule_component double, ml_component double, "
        "fused_score double, reason string, details string",
    )
    kept = {(r["alert_day"].day, r["scenario"]) for r in triage.one_per_entity_day(frame).collect()}
    assert kept == {(1, "b"), (2, "a")}


def test_alerts_without_a_day_stop_the_job(spark):
    bad = spark.createDataFrame(
        [("s", "e", "r", "window=2022-13-01")], "scenario string, entity string, reason string, details string"
    )
    with pytest.raises(DataQualityError, match="parsable"):
        triage.check_alerts(bad)
    with pytest.raises(DataQualityError, match="empty"):
        triage.check_alerts(bad.limit(0))


def test_short_timeline_stops_the_job(payments):
    with pytest.raises(DataQualityError, match="too short"):
        triage.cut_points(payments([("01 10:00", "A", "B", 1)]), CFG)


def test_scenario_stats(spark, payments):
    tx = payments([("14 03:00", "inn", "brewery", 12), ("15 08:00", "toll", "inn", 7, {"flag": 1})])
    names = [("fan-in", e) for e in ("inn", "inn", "toll", "brewery", "dock")] + [("velocity", "brewery")]
    frame = spark.createDataFrame(
        [(s, e, "r", str(i)) for i, (s, e) in enumerate(names)],
        "scenario string, entity string, reason string, details string",
    )
    rows = {tuple(r) for r in alerts.scenario_stats(frame, alerts.flagged_accounts(tx)).collect()}
    assert rows == {("fan-in", 5, 4, 0.5), ("velocity", 1, 1, 0.0)}
