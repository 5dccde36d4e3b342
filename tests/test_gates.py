"""Each gate has a passing and a failing case."""

from __future__ import annotations

import pytest

from tidewatch.errors import DataQualityError
from tidewatch.operators import gates


def outcome(report):
    return [(r["actual"], r["passed"]) for r in report.orderBy("rule").collect()]


@pytest.fixture()
def ids(spark):
    def make(*values):
        return spark.createDataFrame([(v,) for v in values], "id string")

    return make


def test_counts(spark, ids):
    assert outcome(gates.exact_count(ids("a", "b"), 2)) == [("2", True)]
    assert outcome(gates.exact_count(ids("a"), 2)) == [("1", False)]
    assert outcome(gates.min_count(ids("a"), 2)) == [("1", False)]
    assert outcome(gates.not_empty(ids("a", "b"))) == [("1", True)]
    assert outcome(gates.not_empty(ids("a").limit(0))) == [("0", False)]


def test_class_distribution(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "c int")
    assert outcome(gates.class_distribution(rows, "c", [(1, 1), (2, 2), (None, 1)])) == [("1", True), ("2", True), ("1", True)]
    assert outcome(gates.class_distribution(rows, "c", [(3, 1)])) == [("missing", False)]
    assert outcome(gates.class_distribution(rows.filter("c = 1"), "c", [(None, 1)])) == [("missing", False)]


def test_steps(spark):
    assert outcome(gates.step_set(spark.range(1, 4), "id", 1, 3)) == [("missing=0;unexpected=0", True)]
    assert outcome(gates.step_set(spark.range(0, 3), "id", 1, 3)) == [("missing=1;unexpected=1", False)]


def test_ids(spark, ids):
    edges = spark.createDataFrame([("a", "b"), ("b", "z"), ("z", "z")], "src string, dst string")
    assert outcome(gates.referential(ids("a", "b"), edges)) == [("3", False)]
    assert outcome(gates.referential(ids("a", "b", "z"), edges)) == [("0", True)]
    assert outcome(gates.same_ids(ids("a", "b"), ids("b", "a", "a"), "id")) == [("only_left=0;only_right=0", True)]
    assert outcome(gates.same_ids(ids("a", "b"), ids("c"), "id")) == [("only_left=2;only_right=1", False)]


def test_accounts_and_rate(payments):
    tx = payments([("01 10:00", "A", "A", 5), ("01 10:00", "A", "B", 5, {"flag": 1}), ("01 10:00", "A", "A", 5, {"to_bank": "011"})])
    assert outcome(gates.distinct_accounts(tx, 3)) == [("3", True)]
    assert outcome(gates.distinct_accounts(tx, 4)) == [("3", False)]
    assert outcome(gates.rate_band(tx, "is_laundering", 1 / 3, 0.05, 1)) == [("1", True), ("0.333333", True)]
    assert outcome(gates.rate_band(tx, "is_laundering", 0.5, 0.05, 2)) == [("1", False), ("0.333333", False)]
    assert outcome(gates.rate_band(tx.limit(0), "is_laundering", 0.5, 0.05, 0)) == [("0", True), ("0.000000", False)]


def test_nulls_and_nan(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    assert outcome(gates.no_nan(rows, ["a", "b"])) == [("2", False)]
    assert outcome(gates.no_nan(rows, ["b"])) == [("0", True)]
    assert outcome(gates.no_nulls(rows, ["a"])) == [("1", False)]


def test_scalar(spark):
    assert gates.scalar(spark.range(3).selectExpr("count(*)")) == 3
    for frame in (spark.range(0), spark.range(0).selectExpr("max(id)")):
        with pytest.raises(DataQualityError):
            gates.scalar(frame)
    assert outcome(gates.scalar_present(spark.range(0).selectExpr("max(id)"))) == [("0", False)]


def test_coverage(spark, ids):
    features = spark.createDataFrame([("a", 1), ("b", None)], "id string, f int")
    assert outcome(gates.feature_coverage(features, ids("a", "b"), ["f"])) == [("0", True), ("1", False), ("2", True)]
    assert [p for _, p in outcome(gates.feature_coverage(features, ids("a", "c"), ["f"]))] == [False, False, True]
    short = features.filter("id = 'a'")
    assert [p for _, p in outcome(gates.feature_coverage(short, ids("a", "b"), ["f"]))] == [False, True, False]


def test_leak_gates(spark):
    steps = spark.createDataFrame([(33,), (34,)], "step int")
    assert outcome(gates.steps_before(steps, "step", 35)) == [("34", True)]
    assert outcome(gates.steps_before(steps, "step", 34)) == [("34", False)]
    assert outcome(gates.steps_before(steps.limit(0), "step", 34))[0][1] is False
    edges = spark.createDataFrame([(34, 35)], "src_step int, dst_step int")
    assert outcome(gates.edges_within(edges, 34)) == [("35", False)]
    assert outcome(gates.edges_within(edges.limit(0), 34)) == [("0", True)]
    assert outcome(gates.split_not_empty(steps, "step", 33, 34)) == [("train=1;test=1", True)]
    assert outcome(gates.split_not_empty(steps, "step", 34, 35)) == [("train=2;test=0", False)]


def test_labels_cuts_metrics_schema(spark):
    labels = spark.createDataFrame([(1,), (0,)], "y int")
    assert outcome(gates.two_classes(labels, "y")) == [("2", True)]
    assert outcome(gates.two_classes(labels.filter("y = 1"), "y")) == [("1", False)]
    assert outcome(gates.two_classes(labels.limit(0), "y")) == [("0", False)]
    cuts = spark.sql("SELECT DATE '2022-09-10' AS day2, DATE '2022-09-10' AS last")
    assert outcome(gates.cut_before_last(cuts))[0][1] is False
    models = spark.createDataFrame([("a", 0.81), ("b", 0.79), ("c", None)], "model string, roc_auc double")
    assert [p for _, p in outcome(gates.metric_floor(models, "roc_auc", 0.8))] == [True, False, False]
    assert outcome(gates.column_set(labels, ["y"])) == [("y", True)]
    assert outcome(gates.column_set(labels, ["x"])) == [("y", False)]


def test_enforce_lists_all_failures(ids):
    with pytest.raises(DataQualityError, match="first.*second"):
        gates.enforce(gates.exact_count(ids("a"), 2, "first"), gates.min_count(ids("a"), 3, "second"))
    gates.enforce(gates.exact_count(ids("a"), 1))
