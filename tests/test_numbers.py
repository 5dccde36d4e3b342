"""Ranks, running sums, quantiles, drift and metrics against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import DriftConfig
from tidewatch.errors import DataQualityError
from tidewatch.functions.cumulative import global_rank, running_sums
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.sampling import seeded_sample
from tidewatch.operators import drift, metrics


def test_global_rank_is_dense_and_ordered(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(v % 10, v) for v in values], "a int, b int").repartition(7)
    rows = global_rank(frame, [F.desc("a"), F.asc("b")]).collect()
    want = sorted(((v % 10, v) for v in values), key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 1001))


def test_running_sums_with_one_group_holding_most_rows(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 5}", i, rng.randrange(9)) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, at int, v int").repartition(5)
    got = {(r["g"], r["at"]): r["upto"] for r in running_sums(frame, ["at"], {"upto": F.col("v")}, ["g"]).collect()}
    want, sums = {}, {}
    for g, at, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[g, at] = sums[g]
    assert got == want


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    data = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float),
        "skew": rng.exponential(size=3000) ** 3, "flat": np.ones(3000),
    }
    names = list(data)
    frame = spark.createDataFrame([tuple(float(data[c][i]) for c in names) for i in range(3000)], names)
    probs = drift.probabilities(10)
    got = {r["column"]: r["edges"] for r in exact_quantiles(frame.repartition(6), names, probs, accuracy).collect()}
    for name in names:
        want = np.unique(np.quantile(data[name], np.linspace(0, 1, 11)[1:-1], method="inverted_cdf"))
        assert got[name] == list(want), name


def test_quantiles_of_few_rows(spark):
    for n in (1, 2, 9, 10, 11):
        values = [float(v * v) for v in range(n)]
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        got = exact_quantiles(frame, ["x"], drift.probabilities(10)).first()["edges"]
        assert got == list(np.unique(np.quantile(values, np.linspace(0, 1, 11)[1:-1], method="inverted_cdf")))


def index_of(spark, expected, actual):
    rows = [(float(v), True) for v in expected] + [(float(v), False) for v in actual]
    return drift.psi_drift(spark.createDataFrame(rows, "x double, is_reference boolean"), ["x"]).first()["psi"]


def test_index_by_hand(spark):
    same = np.random.default_rng(0).normal(size=500)
    assert abs(index_of(spark, same, same)) < 1e-6
    assert index_of(spark, [0] * 4 + [1] * 6, [0] * 6 + [1] * 4) == pytest.approx(0.4 * math.log(1.5))
    floor = (1e-6 - 0.1) * math.log(1e-6 / 0.1) + 0.1 * math.log(1 / 0.9)
    assert index_of(spark, [0] + [1] * 9, [1] * 10) == pytest.approx(floor)


def test_constant_reference_still_shows_a_shift(spark):
    assert abs(index_of(spark, [1] * 100, [1] * 50)) < 1e-6
    assert index_of(spark, [1] * 100, [5] * 50) > 0.25
    assert index_of(spark, [1] * 100, [0] * 50) > 0.25


def test_category_shares_and_breach(spark):
    rows = [("a", True)] * 9 + [("b", True)] + [("a", False)] * 5 + [("c", False)] * 5
    table = drift.category_stability(spark.createDataFrame(rows, "k string, is_reference boolean"), "k")
    row = table.first()
    want = sum((a - e) * math.log(a / e) for e, a in ((0.9, 0.5), (0.1, 1e-6), (1e-6, 0.5)))
    assert row["psi"] == pytest.approx(want) and row["status"] == "breach"
    with pytest.raises(DataQualityError, match="breach"):
        drift.check_breach(table)
    levels = spark.createDataFrame([("x", 0.05), ("y", 0.2), ("z", 0.3)], "column string, psi double")
    assert [r["status"] for r in drift.with_status(levels, DriftConfig()).orderBy("column").collect()] == ["ok", "watch", "breach"]


def by_hand(rows):
    pos = sum(y for _, y in rows)
    ap, tp, seen, last = 0.0, 0, 0, 0.0
    for score in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(y for s, y in rows if s == score)
        seen += sum(1 for s, _ in rows if s == score)
        ap += (tp / pos - last) * tp / seen
        last = tp / pos
    pairs = [(p, n) for p, y in rows if y for n, z in rows if not z]
    return ap, sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)


def test_rank_metrics_with_ties(spark):
    rng = random.Random(4)
    groups = {g: [(rng.randrange(12) / 12, int(rng.random() < 0.4)) for _ in range(120)] for g in "ab"}
    frame = spark.createDataFrame([(g, s, y) for g, rows in groups.items() for s, y in rows], "g string, score double, label int")
    for row in metrics.rank_metrics(frame, ["g"]).collect():
        ap, auc = by_hand(groups[row["g"]])
        assert row["pr_auc"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc)


def test_threshold_metrics_with_empty_denominators(spark):
    frame = spark.createDataFrame([(1, 0.6, 1), (1, 0.7, 0), (1, 0.2, 1), (2, 0.1, 0)], "step int, score double, label int")
    one, two = metrics.threshold_metrics(frame, ["step"]).orderBy("step").collect()
    assert (one["precision"], one["recall"], one["f1"]) == (0.5, 0.5, 0.5)
    assert (two["precision"], two["recall"], two["f1"]) == (0.0, 0.0, 0.0)


def test_sample_is_seeded_and_free_of_the_layout(spark):
    frame = spark.range(20_000)
    first = {r["id"] for r in seeded_sample(frame, "id", 300, 42).collect()}
    again = {r["id"] for r in seeded_sample(frame.repartition(13), "id", 300, 42).collect()}
    other = {r["id"] for r in seeded_sample(frame, "id", 300, 7).collect()}
    assert len(first) == 300 and first == again and first != other
    assert seeded_sample(spark.range(5), "id", 300, 42).count() == 5
