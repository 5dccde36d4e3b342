from __future__ import annotations

import itertools
import random

from tidewatch.operators.community import dense_pairs, without_hubs

SCHEMA = "period int, acct string, cpty string"


def edge_set(seed, hub=True):
    rng = random.Random(seed)
    pairs = set()
    for period in (1, 2):
        for _ in range(220):
            pairs.add((period, f"A{rng.randrange(14)}", f"C{rng.randrange(18)}"))
        if hub:  # one counterparty in a third of all rows
            pairs |= {(period, f"A{i}", "HUB") for i in range(60)}
    return sorted(pairs)


def brute(edges, min_shared, limit):
    accounts = {}
    for period, acct, cpty in edges:
        accounts.setdefault((period, cpty), set()).add(acct)
    shared = {}
    for (period, _), members in accounts.items():
        if len(members) <= limit:
            for a, b in itertools.combinations(sorted(members), 2):
                shared[period, a, b] = shared.get((period, a, b), 0) + 1
    return {(*k, n) for k, n in shared.items() if n >= min_shared}


def test_same_pairs_as_enumeration(spark):
    for seed, min_shared, limit in ((1, 5, 64), (2, 3, 10), (3, 1, 59)):
        edges = edge_set(seed)
        got = {tuple(r) for r in dense_pairs(spark.createDataFrame(edges, SCHEMA), min_shared, limit).collect()}
        assert got == brute(edges, min_shared, limit)


def test_hub_rule_is_exact_at_the_limit(spark):
    edges = [(1, f"A{i}", "C") for i in range(4)] + [(1, f"A{i}", "D") for i in range(5)]
    left = without_hubs(spark.createDataFrame(edges, SCHEMA), 4)
    assert {r["cpty"] for r in left.collect()} == {"C"}
