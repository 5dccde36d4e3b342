"""Scenarios against their definitions in plain Python, and both sides of every threshold."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from tests.conftest import pairs

from tidewatch.config import RuleConfig
from tidewatch.operators import rules

SMALL = RuleConfig(
    structuring_floor=Decimal("300"), reporting_threshold=Decimal("400"), structuring_min_txs=2,
    structuring_min_total=Decimal("650"), velocity_min_txs=6, fan_min_counterparties=3,
    fan_min_amount=Decimal("900"), cycle_min_leg=Decimal("150"), community_min_shared=2,
    community_max_hub_degree=6,
)


def ledger(seed: int, n: int = 160):
    rng = random.Random(seed)
    people = [f"P{i:02d}" for i in range(14)]
    rows = []
    for _ in range(n):
        giver, taker = rng.sample(people, 2)
        when = f"{rng.choice(['03', '04', '05'])} {rng.randrange(24):02d}:{rng.randrange(60):02d}"
        more = {"currency": "Euro"} if rng.random() < 0.2 else {}
        rows.append((when, giver, taker, rng.choice([90, 150, 300, 330, 399, 400, 700]), more))
    return rows


def by_definition(rows, cfg):
    """(scenario, entity) pairs, one day at a time."""
    found = set()
    for today in {r[0][:2] for r in rows}:
        mine = [r for r in rows if r[0][:2] == today]
        usd = [r for r in mine if not r[4]]
        sent, taken, all_sent, met = (defaultdict(list) for _ in range(4))
        legs = defaultdict(Decimal)
        for r in mine:
            all_sent[r[1]].append(r)
            met[r[1]].append(r[2])
            met[r[2]].append(r[1])
        for r in usd:
            sent[r[1]].append(r)
            taken[r[2]].append(r)
            if r[3] >= cfg.cycle_min_leg:
                legs[r[1], r[2]] += r[3]
        for who, out in sent.items():
            band = [r[3] for r in out if cfg.structuring_floor <= r[3] < cfg.reporting_threshold]
            if len(band) >= cfg.structuring_min_txs and sum(band) >= cfg.structuring_total:
                found.add(("structuring", who))
        found |= {("velocity", who) for who, out in all_sent.items() if len(out) >= cfg.velocity_min_txs}
        for name, side, other in (("fan-out", sent, 2), ("fan-in", taken, 1)):
            for who, part in side.items():
                if len({r[other] for r in part}) >= cfg.fan_min_counterparties and sum(r[3] for r in part) >= cfg.fan_min_amount:
                    found.add((name, who))
        for who, part in taken.items():
            since = min(r[0] for r in part)
            paid = [r[3] for r in sent[who] if r[0] >= since]
            if paid and sum(paid) >= (1 - cfg.churn_max_retained) * sum(r[3] for r in part):
                found.add(("rapid-churn", who))
        low, high = 1 - cfg.cycle_tolerance, 1 + cfg.cycle_tolerance
        for a, b in legs:
            rounds = [[(a, b), (b, a)]] + [[(a, b), (b, c), (c, a)] for x, c in legs if x == b and c != a]
            for walk in rounds:
                if all(leg in legs for leg in walk) and low * legs[walk[0]] <= legs[walk[-1]] <= high * legs[walk[0]]:
                    found.add(("circular-flow", min(leg[0] for leg in walk)))
        light = {who: set(others) for who, others in met.items() if len(set(others)) <= cfg.community_max_hub_degree}
        for a in met:
            for b in met:
                if a < b and sum(a in around and b in around for around in light.values()) >= cfg.community_min_shared:
                    found.add(("dense-community", a))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_ledgers(payments, seed):
    rows = ledger(seed)
    want = by_definition(rows, SMALL)
    assert len({s for s, _ in want}) == 7
    assert set(pairs(rules.all_scenarios(payments(rows), SMALL))) == want


def spread(who, n, amount, to="shop"):
    return [(f"07 {6 + i // 4:02d}:{i % 4 * 15:02d}", who, f"{to}{i}", amount) for i in range(n)]


EDGES = {
    # name: (scenario, entity, rows that fire, rows that just do not)
    "band, lowest": ("structuring", "K", [("07 06:00", "K", "M", "9000.00")] * 3, [("07 06:00", "K", "M", "9000.00")] * 2 + [("07 07:00", "K", "M", "8999.99")]),
    "band, highest": ("structuring", "K", [("07 06:00", "K", "M", "9999.99")] * 3, [("07 06:00", "K", "M", "9999.99")] * 2 + [("07 07:00", "K", "M", "10000.00")]),
    "count of payments": ("velocity", "K", spread("K", 20, "1.00"), spread("K", 19, "1.00")),
    "share kept": ("rapid-churn", "K", [("07 06:00", "M", "K", "4000.00"), ("07 06:30", "K", "N", "3600.00")], [("07 06:00", "M", "K", "4000.00"), ("07 06:30", "K", "N", "3599.99")]),
    "out before in": ("rapid-churn", "K", [("07 06:00", "M", "K", "70.00"), ("07 06:00", "K", "N", "70.00")], [("07 06:01", "M", "K", "70.00"), ("07 06:00", "K", "N", "70.00")]),
    "amount fanned out": ("fan-out", "K", spread("K", 5, "10000.00"), spread("K", 4, "10000.00") + [("07 20:00", "K", "last", "9999.99")]),
    "partners of a fan": ("fan-out", "K", spread("K", 5, "30000.00"), spread("K", 4, "30000.00") + [("07 20:00", "K", "shop0", "30000.00")]),
    "lower return": ("circular-flow", "K", [("07 06:00", "K", "M", "2000.00"), ("07 05:00", "M", "K", "1800.00")], [("07 06:00", "K", "M", "2000.00"), ("07 05:00", "M", "K", "1799.99"), ("07 04:00", "N", "M", "1.00")]),
    "smallest leg": ("circular-flow", "K", [("07 06:00", "K", "M", "1000.00"), ("07 05:00", "M", "K", "1000.00")], [("07 06:00", "K", "M", "999.99"), ("07 05:00", "M", "K", "999.99")]),
    "shared partners": ("dense-community", "K", spread("K", 5, "2.00") + spread("L", 5, "2.00"), spread("K", 5, "2.00") + spread("L", 4, "2.00")),
}


@pytest.mark.parametrize("name", EDGES)
def test_both_sides_of_a_threshold(payments, name):
    scenario, entity, fires, silent = EDGES[name]
    for rows, want in ((fires, True), (silent, False)):
        got = pairs(rules.SCENARIOS[scenario](payments([(w, s, r, Decimal(a)) for w, s, r, a in rows])))
        assert ((scenario, entity) in got) == want, rows


def test_hubs_do_not_make_communities(payments):
    for around, want in ((62, True), (63, False)):  # a hub of 64 and of 65 accounts
        rows = spread("K", 5, 2) + spread("L", 5, 2)
        rows += [("07 12:00", f"other{i}", f"shop{j}", 2) for i in range(around) for j in range(1)]
        assert (("dense-community", "K") in pairs(rules.dense_community(payments(rows)))) == want


def test_details_name_what_was_seen(payments):
    rows = [("07 06:00", "K", "M", "9100.50"), ("07 07:00", "K", "N", "9200.25"), ("07 08:00", "K", "N", "9300.00")]
    rows += [("08 06:00", "R", "S", 4000), ("08 07:00", "S", "T", 5000), ("08 08:00", "T", "R", 4400)]
    tx = payments([(w, s, r, Decimal(str(a))) for w, s, r, a in rows])
    found = {(r["scenario"], r["entity"]): r["details"] for r in rules.all_scenarios(tx).collect()}
    assert found["structuring", "K"] == (
        "txs=3;counterparties=2;total_usd=27600.75;band_usd=[9000,10000);window=2022-09-07")
    assert found["circular-flow", "R"] == (
        "path=R->S->T->R;amt_out_usd=4000.0;amt_back_usd=4400.0;cycle_len=3;window=2022-09-08")
    assert found["rapid-churn", "S"] == (
        "received_usd=4000.0;paid_out_usd=5000.0;retained_pct=-25.0;window=2022-09-08")


def test_single_scenarios_equal_the_shared_plan(payments):
    tx = payments(ledger(9))
    alone = sorted(tuple(r) for f in rules.SCENARIOS.values() for r in f(tx, SMALL).collect())
    assert alone == sorted(tuple(r) for r in rules.all_scenarios(tx, SMALL).collect())


def test_month_window_joins_days(payments):
    rows = [(f"{d} 14:00", "K", "M", 9400) for d in ("03", "11", "27")]
    assert rules.structuring(payments(rows)).isEmpty()
    monthly = rules.structuring(payments(rows), RuleConfig(window="month"))
    assert monthly.first()["details"].endswith("window=2022-09-01")


def test_result_does_not_depend_on_partitioning(spark, payments):
    tx, seen = payments(ledger(4)), set()
    for parts in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.add(tuple(sorted(tuple(r) for r in rules.all_scenarios(tx.repartition(parts), SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
