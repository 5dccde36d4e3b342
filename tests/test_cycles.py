"""The cycle search against enumeration of all leg combinations."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from tidewatch.config import RuleConfig
from tidewatch.operators.cycles import find_cycles, transfer_pairs

SCHEMA = "period int, from_bank string, from_account string, to_bank string, to_account string, amt decimal(18,2)"


def brute(legs, tolerance=Decimal("0.10"), loops=True):
    totals = {}
    for period, fb, fa, tb, ta, amt in legs:
        if loops or (fb, fa) != (tb, ta):
            key = (period, (fb, fa), (tb, ta))
            totals[key] = totals.get(key, Decimal(0)) + amt
    out = {}
    for (period, a, b), amt in totals.items():
        out.setdefault((period, a), []).append((b, amt))

    def near(last, first):
        return first * (1 - tolerance) <= last <= first * (1 + tolerance)

    found = set()
    for (period, a, b), first in totals.items():
        back = totals.get((period, b, a))
        if back is not None and near(back, first):
            x, y = a[1], b[1]
            swap = x > y
            path = f"{y}->{x}->{y}" if swap else f"{x}->{y}->{x}"
            amounts = (back, first) if swap else (first, back)
            found.add((period, min(x, y), path, *amounts, 2))
        for c, second in out.get((period, b), []):
            last = totals.get((period, c, a))
            if last is None or not near(last, first):
                continue
            names, amts = [a[1], b[1], c[1]], [first, second, last]
            at = names.index(min(names))
            names, amts = names[at:] + names[:at], amts[at:] + amts[:at]
            found.add((period, names[0], "->".join([*names, names[0]]), amts[0], amts[2], 3))
    return found


def legs_of(seed, accounts, banks, rows, hub=None):
    rng = random.Random(seed)
    legs = []
    for _ in range(rows):
        a, b = (f"N{rng.randrange(accounts)}" for _ in range(2))
        if hub and rng.random() < 0.34:
            a, b = rng.choice([(hub, b), (a, hub)])
        legs.append(
            (rng.randrange(2), f"B{rng.randrange(banks)}", a, f"B{rng.randrange(banks)}", b,
             Decimal(rng.randrange(9000, 11000)) / 10)
        )
    return legs


@pytest.mark.parametrize(
    ("seed", "accounts", "banks", "rows", "hub"),
    [(1, 8, 1, 90, None), (2, 5, 3, 160, None), (3, 25, 1, 250, "N0"), (4, 12, 2, 220, "N3")],
)
def test_same_cycles_as_enumeration(spark, seed, accounts, banks, rows, hub):
    legs = legs_of(seed, accounts, banks, rows, hub)
    frame = transfer_pairs(spark.createDataFrame(legs, SCHEMA))
    got = [tuple(r) for r in find_cycles(frame, RuleConfig()).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(legs)
    assert any(r[5] == 3 for r in got)


def test_transfers_to_oneself_can_be_left_out(spark):
    legs = legs_of(5, 6, 1, 80)
    frame = transfer_pairs(spark.createDataFrame(legs, SCHEMA))
    got = {tuple(r) for r in find_cycles(frame, RuleConfig(exclude_self_loops=True)).collect()}
    assert got == brute(legs, loops=False)


def test_one_transfer_to_oneself_is_a_two_and_a_three_cycle(spark):
    frame = transfer_pairs(spark.createDataFrame([(1, "B", "A", "B", "A", Decimal("50"))], SCHEMA))
    got = sorted(tuple(r) for r in find_cycles(frame, RuleConfig()).collect())
    assert [(r[2], r[5]) for r in got] == [("A->A->A", 2), ("A->A->A->A", 3)]


def test_cycle_length_is_limited(spark):
    frame = transfer_pairs(spark.createDataFrame([(1, "B", "A", "B", "C", Decimal("50"))], SCHEMA))
    with pytest.raises(ValueError, match="2 and 3"):
        find_cycles(frame, RuleConfig(cycle_lengths=(4,)))
