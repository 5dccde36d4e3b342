"""Typed CSV scans, canonical projections and parquet sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import replace_table
from tidewatch.errors import DataQualityError
from tidewatch.sources import schemas


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType, *, header: bool
) -> DataFrame:
    """CSV with a positional schema; a row that does not fit stops the job."""
    return (
        spark.read.schema(schema)
        .option("header", str(header).lower())
        .option("enforceSchema", "true")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def class_label(raw: Column | str) -> Column:
    """'1' illicit, '2' licit, anything else unknown (NULL)."""
    text = F.col(raw) if isinstance(raw, str) else raw
    return F.when(text == "1", 1).when(text == "2", 2).cast("tinyint")


def graph_transactions(classes: DataFrame) -> DataFrame:
    return classes.select(
        F.col("txId").alias("tx_id"), class_label("class").alias("class_label")
    )


def graph_features(features: DataFrame) -> DataFrame:
    rest = [c for c in features.columns if c not in ("txId", "time_step")]
    return features.select(F.col("txId").alias("tx_id"), "time_step", *rest)


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("txId1").alias("src_tx_id"), F.col("txId2").alias("dst_tx_id")
    )


def bank_transactions(raw: DataFrame) -> DataFrame:
    """Strict time parse: under ANSI mode a bad value fails the load. The result
    is zone-free, so calendar days never move with the session time zone."""
    parsed = F.to_timestamp_ntz(F.col("ts"), F.lit(schemas.TIME_FORMAT)).alias("tx_time")
    return raw.select(parsed, *[c for c in raw.columns if c != "ts"])


def export_sorted(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Replace a parquet table, rows in one total order. The global sort is a
    range exchange, so files are disjoint, ordered slices of the table."""
    replace_table(df.orderBy(*(order or df.columns)), path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row describing the table's content whatever its file layout: row
    count, sum and xor of the row hashes."""
    row_hash = F.xxhash64(*df.columns)
    return df.select(row_hash.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0))
        .cast("string")
        .alias("hash_sum"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def open_tables(
    spark: SparkSession, folder: str, required: dict[str, str]
) -> dict[str, DataFrame]:
    """Open parquet tables below ``folder``. All missing ones are reported in
    one error, each with its hint, before any query runs."""
    missing = {n: hint for n, hint in required.items() if not path_exists(spark, f"{folder}/{n}")}
    if missing:
        listed = "; ".join(f"{name} ({hint})" for name, hint in sorted(missing.items()))
        raise DataQualityError(f"{folder} lacks required table(s): {listed}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in required}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
