from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, home double"


def brute(rows):
    kept = set()
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        while v and v[-1] == 0:
            v = v[:-1]
        kept.add((i, tuple(math.floor(256 * x) for x in v), (label + 1) % 10 if i % 7 == 0 else label))
    out = Counter()
    for a in kept:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], c[1], strict=False)), c[0], c[2] == a[2]) for c in kept if c != a)
        for ps, pid, _ in [s for s in scored if s[2]][:5]:
            fits = [(n, i) for n, i, same in scored if not same and 50 * -ps <= 100 * -n <= 95 * -ps]
            for rank, (n, i) in enumerate(fits[:3], 1):
                out[(a[0], pid, rank, i, -ps, -n)] += 1
    return out


def found(llm, rows, **sizes):
    df = llm.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(3)
    mined = hard_negatives.mine(hard_negatives.participants(df), F.col("vec_id") % 50 == 0, **sizes)
    return Counter(tuple(r) for r in mined.collect())


def cloud(rnd, n, scale=1.0, spread=0.5, width=12):
    middles = [[rnd.gauss(0, scale) for _ in range(width)] for _ in range(6)]
    return [(i, [x + rnd.gauss(0, scale * spread) for x in rnd.choice(middles)], rnd.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
@pytest.mark.parametrize("sizes", [{}, {"per_cluster": 3, "member_block": 2, "shard_rows": 40}])
def test_negatives_against_plain_search(llm, scale, sizes):
    rnd = random.Random(4)
    rows = cloud(rnd, 500, scale)
    rows += [(600 + i, rows[3][1], 1) for i in range(120)]  # one common vector, anchors among it
    rows += [(50, rows[8][1], 2), (50, rows[50][1], rows[50][2]), (9, rows[9][1], rows[9][2])]  # repeated ids and rows
    rows += [(800, None, 1), (801, [1.0, None], 1), (802, [float("nan")], 1), (850, [float("inf")], 0), (None, [1.0], 1)]
    rows += [(900, [1.0] * 12, None), (950, [], 1), (1000, [0.0] * 12, 2), (1050, [0.0] * 12, 2), (1001, [2.0], 2)]
    assert found(llm, rows, **sizes) == brute(rows)


def test_negatives_of_little(llm):
    assert found(llm, []) == Counter()
    assert found(llm, [(1, [1.0], 0), (2, [1.0], 1)]) == Counter()  # no anchor
    assert found(llm, [(50, [], 0), (51, [], 1)]) == Counter()
    rows = [(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2), (53, [1.0], 2), (54, [0.4], 2)]
    assert found(llm, rows) == brute(rows) == {(50, 51, 1, 52, 65536, 256 * 230): 1}


def test_the_walk_ends_early_and_stays_exact():
    """Members of a tight cluster stop long before the end of the list."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-200, 200, size=(5000, 8))
    rows[:20] = np.array([300, 250, 10, 0, 0, 0, 0, 0]) + rng.integers(-5, 5, size=(20, 8))
    import pyarrow as pa

    block = pa.array([{
        "member": m, "label": 1, "v": rows[m].tolist(),
        "wants": [{"lo": -(1 << 63), "hi": (1 << 63) - 1, "floor": -(1 << 63)}]} for m in range(4)])
    members = hard_negatives.Members(block, 6)
    centres = hard_negatives.Centres(rows[:4].mean(axis=0, keepdims=True), 8)
    norms, cosines = centres.cosines(rows[:4])
    centres.angles[0] = np.arccos(cosines[:, 0].min())
    bounds = centres.bounds(*centres.cosines(rows), 0)
    order = np.argsort(-bounds)
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.stop)
            return super().__getitem__(key)

    hard_negatives.walk(members, np.arange(5000), np.ones(5000, int), rows, order.view(Watched), bounds, True, 100)
    assert max(seen) <= 500
    for m, best in enumerate(members.best):
        scores = rows @ rows[m]
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:6]
        assert [(s, i) for s, i, _ in best] == want
    assert (norms > 0).all()
