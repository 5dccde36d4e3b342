from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.session import build_session  # noqa: E402

TX_SCHEMA = (
    "tx_time timestamp_ntz, from_bank string, from_account string, to_bank string, "
    "to_account string, amount_received decimal(18,2), receiving_currency string, "
    "amount_paid decimal(18,2), payment_currency string, payment_format string, is_laundering int"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", 4, {"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/tidewatch-wh"}
    )
    yield session
    session.stop()


@pytest.fixture()
def payments(spark):
    """Frame from short rows (when, sender, receiver, amount, ...)."""
    from datetime import datetime

    def make(rows):
        full = []
        for row in rows:
            when, sender, receiver, amount = row[:4]
            more = row[4] if len(row) > 4 else {}
            currency = more.get("currency", "US Dollar")
            full.append(
                (
                    datetime.strptime(f"2022-09-{when}", "%Y-%m-%d %H:%M"),
                    more.get("from_bank", "010"), sender, more.get("to_bank", "010"), receiver,
                    Decimal(str(more.get("received", amount))), currency, Decimal(str(amount)), currency,
                    more.get("format", "ACH"), more.get("flag", 0),
                )
            )
        return spark.createDataFrame(full, TX_SCHEMA)

    return make


def pairs(df):
    return sorted((r["scenario"], r["entity"]) for r in df.collect())
