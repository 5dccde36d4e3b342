"""Registered queries against their SQL on the smallest tables. The full run is
``tools/check.py``."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
SAMPLE = [
    "r8_rule_all", "k1_alert_scenario_stats", "k6_alert_history_features", "k8_alert_queue",
    "k9_triage_kpi", "k11_precision_curve", "j2_join_two_cycle", "j3_join_three_cycle",
    "n5_ego_illicit_2hop", "m9_rank_metrics", "g8_gate_rate_band", "s7_parse_tx_time", "t6_sample_seeded",
]
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 150


def test_entry_runs(spark):
    assert entry_module.entry(spark).columns == ["scenario", "entity", "reason", "details"]
