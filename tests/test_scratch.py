"""What the history queries leave in the scratch folder."""

from __future__ import annotations

from pathlib import Path

import pytest

from tidewatch.catalog import inputs, triage_queries
from tidewatch.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_intermediate_tables_are_packed(spark):
    table = materialize(spark.range(10), "packed")
    assert table.count() == 10
    assert all(".zstd." in Path(f).name for f in table.inputFiles())


def test_asof_history_stores_no_profile(spark, monkeypatch):
    def stored(spark, folder):
        pytest.fail("the profile was written and moved again")

    wanted = {tuple(r) for r in inputs.alert_features(spark, FOLDER).selectExpr(
        "acct", "cast(day AS string) AS day", "tx_in_count", "tx_out_count", "active_day_count").collect()}
    monkeypatch.setattr(inputs, "profile", stored)
    assert {tuple(r) for r in triage_queries.join_asof_history(spark, FOLDER).collect()} == wanted
