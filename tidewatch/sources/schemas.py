"""Fixed, positional schemas of the raw files. Identifiers are always text."""

from __future__ import annotations

from pyspark.sql import types as T

TIME_FORMAT = "yyyy/MM/dd HH:mm"  # fixed value of the raw bank files


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def feature_names(count: int) -> list[str]:
    return [f"f{i:03d}" for i in range(1, count + 1)]


def graph_features_raw(count: int) -> T.StructType:
    return _struct(
        ("txId", T.StringType()),
        ("time_step", T.ShortType()),
        *[(name, T.FloatType()) for name in feature_names(count)],
    )


GRAPH_CLASSES_RAW = _struct(("txId", T.StringType()), ("class", T.StringType()))
GRAPH_EDGES_RAW = _struct(("txId1", T.StringType()), ("txId2", T.StringType()))

BANK_TX_RAW = _struct(
    ("ts", T.StringType()),
    ("from_bank", T.StringType()),
    ("from_account", T.StringType()),
    ("to_bank", T.StringType()),
    ("to_account", T.StringType()),
    ("amount_received", T.DoubleType()),
    ("receiving_currency", T.StringType()),
    ("amount_paid", T.DoubleType()),
    ("payment_currency", T.StringType()),
    ("payment_format", T.StringType()),
    ("is_laundering", T.ShortType()),
)
BANK_ACCOUNTS_RAW = _struct(
    ("bank_name", T.StringType()),
    ("bank_id", T.StringType()),
    ("account_number", T.StringType()),
    ("entity_id", T.StringType()),
    ("entity_name", T.StringType()),
)
