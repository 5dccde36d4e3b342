"""Account features against a direct computation over the payments."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidewatch.operators import accounts


def some_payments(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # one account takes part in about a third of all payments
        a = "HOT" if rng.random() < 0.3 else f"A{rng.randrange(9)}"
        b = f"A{rng.randrange(9)}"
        amount = rng.choice([0, 50, 9000, 20000])
        rows.append(
            (f"{rng.randrange(1, 21):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}", a, b, amount,
             {"currency": rng.choice(["US Dollar", "Euro"]), "format": rng.choice(["ACH", "Wire", "Cash"])})
        )
    return rows


def direct(rows, acct, before):
    legs = []
    for when, a, b, amount, more in rows:
        day = int(when[:2])
        if day < before:
            legs += [(x, y, i, o, day, more) for x, y, i, o in ((b, a, amount, 0), (a, b, 0, amount)) if x == acct]
    if not legs:
        return None
    ins, outs = [g for g in legs if g[2] > 0], [g for g in legs if g[3] > 0]
    usd = [g for g in outs if g[5]["currency"] == "US Dollar"]
    small = [g for g in usd if g[3] < 10000]
    return (
        len(ins), len(outs), float(sum(g[2] for g in legs)), float(sum(g[3] for g in legs)),
        len({g[1] for g in ins}), len({g[1] for g in outs}), len({g[5]["format"] for g in legs}),
        len({g[5]["currency"] for g in legs}), float(max(g[3] for g in legs)), len({g[4] for g in legs}),
        len(small) / len(usd) if usd else None,
    )


def test_snapshot_and_history_match_direct_computation(spark, payments):
    rows = some_payments(7)
    tx = payments(rows)
    profile = accounts.daily_profile(tx)
    snap = accounts.snapshot(profile, F.lit("2022-09-12").cast("date"))
    got = {r["acct"]: tuple(r[f] for f in accounts.FEATURES) for r in snap.collect()}
    names = {"HOT", *[f"A{i}" for i in range(9)]}
    assert got == {a: direct(rows, a, 12) for a in names if direct(rows, a, 12)}

    asked = [(a, date(2022, 9, 1) + timedelta(days=d - 1)) for a in [*names, "NEW"] for d in (1, 2, 7, 12, 30)]
    history = accounts.history_features(profile, spark.createDataFrame(asked + asked, "acct string, day date"))
    found = {(r["acct"], r["day"].day): tuple(r[f] for f in accounts.FEATURES) for r in history.collect()}
    assert found == {
        (a, d.day): direct(rows, a, d.day) for a, d in asked if direct(rows, a, d.day) is not None
    }


def test_later_payments_change_nothing(spark, payments):
    rows = [r for r in some_payments(8) if int(r[0][:2]) < 10]
    later = [("25 10:00", "A1", "A2", 777)] * 3
    asks = spark.createDataFrame([("A1", date(2022, 9, 10))], "acct string, day date")
    seen = [
        accounts.history_features(accounts.daily_profile(payments(r)), asks).collect()
        for r in (rows, rows + later)
    ]
    assert seen[0] == seen[1]


def test_self_transfer_gives_both_legs(payments):
    profile = accounts.daily_profile(payments([("01 10:00", "A", "A", 5)]))
    row = accounts.snapshot(profile, F.lit("2022-09-02").cast("date")).first()
    assert (row["tx_in_count"], row["tx_out_count"], row["counterparty_in_count"]) == (1, 1, 1)


def test_double_amounts_sum_exactly(spark, payments):
    tx = payments([("01 10:00", "A", "B", Decimal("0.10"))] * 3).withColumn(
        "amount_paid", F.col("amount_paid").cast("double")
    )
    row = accounts.snapshot(accounts.daily_profile(tx), F.lit("2022-09-02").cast("date")).filter("acct = 'A'").first()
    assert row["amount_out_total"] == 0.3
