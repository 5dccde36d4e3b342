"""How often the large steps move their rows, and what they hold back."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewatch.config import RuleConfig
from tidewatch.operators import accounts, community, cycles, rules
from tidewatch.operators.cycles import find_cycles

SMALL = RuleConfig(community_max_hub_degree=4)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_legs_move_once_into_the_profile(payments):
    tx = payments([("07 06:00", "K", "M", 5), ("08 06:00", "M", "K", 5)])
    assert exchanges(accounts.daily_profile(tx)) == 1


def test_histories_move_the_profile_once(spark, payments):
    profile = accounts.daily_profile(payments([("07 06:00", "K", "M", 5), ("08 06:00", "M", "K", 5)]))
    stored = spark.createDataFrame(profile.collect(), profile.schema)
    asks = stored.select("acct", "day")
    # one for the distinct asks, one for both tables
    assert exchanges(accounts.history_features(stored, asks)) == 2
    got = {(r["acct"], str(r["day"]), r["tx_in_count"]) for r in accounts.history_features(stored, asks).collect()}
    assert got == {("K", "2022-09-08", 0), ("M", "2022-09-08", 1)}


def test_one_exchange_feeds_six_scenarios_and_hubs_hold_no_list(payments):
    rows = [("07 06:00", f"P{i}", "HUB", 5) for i in range(5)] + [("07 07:00", f"P{i}", "shop", 5) for i in range(4)]
    seen = rules.entity_periods(payments(rows), SMALL)
    assert exchanges(seen) == 1
    lists = {r["entity"]: r["partners"] and sorted(r["partners"]) for r in seen.collect()}
    assert lists["HUB"] is None
    assert lists["shop"] == ["P0", "P1", "P2", "P3"]


def test_pairs_do_not_meet_in_the_task_that_reads_the_groups(spark, monkeypatch):
    plans = []

    def keep(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return df

    monkeypatch.setattr(community, "materialize", keep)
    groups = spark.createDataFrame([(1, c, ["A", "B"]) for c in "xyz"], "period int, cpty string, accts array<string>")
    assert [tuple(r) for r in community.pairs_in_groups(groups, 3).collect()] == [(1, "A", "B", 3)]
    plan = dict(plans)["community-candidates"].splitlines()
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(pair" in line)
    assert "HashAggregate" not in plan[at + 1]


def test_triangles_with_accounts_above_the_light_degree(spark, monkeypatch):
    rng = random.Random(5)
    legs = {(a, b) for a in range(12) for b in range(12) if a != b and rng.random() < 0.5}
    legs |= {(0, b) for b in range(1, 40)} | {(b, 0) for b in range(1, 40)}

    def key(n):
        return {"account": f"A{n:02d}", "bank": "B"}

    rows = [
        (1, key(u), key(v), 5000.0 if (u, v) in legs else None, 5000.0 if (v, u) in legs else None)
        for u in range(40) for v in range(u + 1, 40) if (u, v) in legs or (v, u) in legs
    ]
    end = "struct<account:string,bank:string>"
    pairs = spark.createDataFrame(rows, f"period int, u {end}, v {end}, forward double, backward double").withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("forward", "backward")}
    )
    want = {
        (min((a, b, c), (b, c, a), (c, a, b)))
        for a, b in legs for c in range(40) if (b, c) in legs and (c, a) in legs and c not in (a, b)
    }
    for light in (0, 8, 64):
        monkeypatch.setattr(cycles, "LIGHT_DEGREE", light)
        found = find_cycles(pairs, RuleConfig(cycle_lengths=(3,), exclude_self_loops=True)).collect()
        assert {r["path"] for r in found} == {"->".join(f"A{n:02d}" for n in (*w, w[0])) for w in want}


def test_raw_files_are_packed_and_read_back(spark, tmp_path, monkeypatch):
    from tidewatch.catalog import scan_queries

    monkeypatch.setattr(scan_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "txId string, class string").repartition(2)
    path = scan_queries._raw_file(spark, str(tmp_path), "packed", rows, True)
    found = [f.name for f in (tmp_path / "raw-packed").glob("part-*")]
    assert found and all(name.endswith(".csv.gz") for name in found)
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(path).collect()) == [("1", "a"), ("2", "b")]


def test_payments_are_sorted_once_for_six_scenarios_and_their_sums_stay_exact(payments):
    most = "9999999999999999.99"
    rows = [(f"{day:02d} 06:00", "K", "M", most) for day in range(1, 13)] + [("13 06:00", "M", "K", 5)]
    seen = rules.entity_periods(payments(rows), RuleConfig(window="month", community_max_hub_degree=4))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.splitlines() if " Sort [" in line]) == 1
    got = {r["entity"]: (str(r["out_total"]), r["txs"], r["out_partners"], r["partners"]) for r in seen.collect()}
    assert got == {"K": ("119999999999999999.88", 12, 1, None), "M": ("5.00", 1, 1, None)}


def test_a_profile_in_the_making_does_not_move_again_for_histories(spark, payments):
    profile = accounts.daily_profile(payments([("07 06:00", "K", "M", 5), ("08 06:00", "M", "K", 5)]))
    asks = spark.createDataFrame([("K", d) for d in (7, 8, 9)] + [("M", 8)], "acct string, d int").select(
        "acct", F.make_date(F.lit(2022), F.lit(9), F.col("d")).alias("day")
    )
    history = accounts.history_features(profile, asks.unionAll(asks))
    # one for the legs, one for the asked days
    assert exchanges(history) == 2
    got = {(r["acct"], str(r["day"]), r["tx_in_count"], r["amount_out_total"]) for r in history.collect()}
    assert got == {("K", "2022-09-08", 0, 5.0), ("K", "2022-09-09", 1, 5.0), ("M", "2022-09-08", 1, 0.0)}


def test_lines_meet_at_their_order_before_they_are_summed(spark, tmp_path):
    from tidewatch.sources.adapters import NODE_FEATURES, graph_vectors

    lines = "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [(1, 2.0, 10.1, 0.1, 0.02, "R", "O"), (1, 3.0, 20.2, 0.2, 0.03, "N", "F"), (2, 1.0, 5.05, 0.0, 0.0, "R", "F")]
    spark.createDataFrame(rows, lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 9.5), (2, 8.5), (3, 7.5)], "o_orderkey long, o_totalprice double").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    vectors = graph_vectors(spark, str(tmp_path))
    plan = vectors._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(l_orderkey" in line)
    assert "HashAggregate" not in plan[at + 1]
    got = {r["id"]: [r[c] for c in NODE_FEATURES] for r in vectors.collect()}
    assert got == {
        1: [9.5, 2.0, 5.0, 30.3, 0.3 / 2, 0.05 / 2, 1.0, 1.0],
        2: [8.5, 1.0, 1.0, 5.05, 0.0, 0.0, 1.0, 0.0],
        3: [7.5] + [0.0] * 7,
    }


def test_transfers_meet_in_the_exchange_and_their_sums_stay_exact(payments):
    most = "9999999999999999.99"
    legs = rules.with_period(payments([(f"{day:02d} 06:00", "K", "M", most) for day in range(1, 13)]), RuleConfig(window="month"))
    pairs = cycles.transfer_pairs(legs.withColumn("amt", F.col("amount_paid")))
    plan = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(period" in line)
    assert "HashAggregate" not in plan[at + 1]
    assert [(str(r["forward"]), r["backward"]) for r in pairs.collect()] == [("119999999999999999.88", None)]
