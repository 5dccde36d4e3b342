"""Plan shapes that matter at scale."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, rules
from tidewatch.sources import schemas


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A canonical table with double amounts, as an ingest job writes it."""
    path = str(tmp_path_factory.mktemp("plan") / "bank_transaction")
    raw = spark.createDataFrame([], schemas.BANK_TX_RAW)
    table = raw.select(F.lit(None).cast("timestamp_ntz").alias("tx_time"), *raw.columns[1:])
    table.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True, scope="module")
def full_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_columns_reach_the_scan(stored):
    text = plan(rules.structuring(stored))
    assert "EqualTo(payment_currency,US Dollar)" in text
    assert "GreaterThanOrEqual(amount_paid,9000.0)" in text and "LessThan(amount_paid,10000.0)" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "payment_format" not in schema and "is_laundering" not in schema
    window = plan(alerts.flagged_accounts(stored, date(2022, 9, 1), date(2022, 9, 5)))
    assert "EqualTo(is_laundering,1)" in window and "GreaterThanOrEqual(tx_time,2022-09-02" in window


@pytest.mark.parametrize("name", list(rules.SCENARIOS))
def test_no_scenario_uses_a_nested_loop_or_python(stored, name):
    text = plan(rules.SCENARIOS[name](stored))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert bad not in text


def test_velocity_takes_one_exchange(stored):
    executed = rules.velocity(stored)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1
    assert executed.count("HashAggregate") == 2
