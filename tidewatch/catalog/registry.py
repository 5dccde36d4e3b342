"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import configure

# Tables of payments are dense: a task that reads or receives less of them keeps its sums and
# sorts in memory. AQE merges what turns out to be small.
TABLE_CONF = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Named piece of oracle SQL; pieces may use each other."""
    CTES[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", sql)):
        if word in CTES and word not in seen:
            _needed(CTES[word], seen)
            seen.append(word)
    return seen


def with_ctes(sql: str) -> str:
    names = _needed(sql, [])
    if not names:
        return sql
    listed = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {listed}\n{sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle where SQL can express it."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            for key, value in TABLE_CONF.items():
                spark.conf.set(key, value)
            return build(spark, folder)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def oracle_texts() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
