"""Typed scans, projections, exports and file checks. The raw files are written
by Spark from the given tables and read back the way an ingest job does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.catalog import inputs
from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import day
from tidewatch.functions.columns import day_text
from tidewatch.session import scratch_path
from tidewatch.sources import files, manifest, schemas
from tidewatch.sources.adapters import NODE_FEATURES, graph_vectors, table

_RAW: dict[tuple[str, str, str], str] = {}


def _raw_file(spark: SparkSession, folder: str, name: str, df: DataFrame, header: bool) -> str:
    """CSV folder, written once per application and source folder. Packed, as each task
    writes a file that one task can read again."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _RAW:
        path = scratch_path(spark, f"raw-{name}")
        df.write.option("header", str(header).lower()).option("compression", "gzip").csv(path)
        _RAW[key] = path
    return _RAW[key]


def _raw_bank(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.tx(spark, folder).select(
        F.date_format("tx_time", schemas.TIME_FORMAT).alias("Timestamp"),
        F.col("from_bank").alias("From Bank"), F.col("from_account").alias("Account"),
        F.col("to_bank").alias("To Bank"), F.col("to_account").alias("Account.1"),
        F.col("amount_received").alias("Amount Received"),
        F.col("payment_currency").alias("Receiving Currency"),
        F.col("amount_paid").alias("Amount Paid"), F.col("payment_currency").alias("Payment Currency"),
        F.col("payment_format").alias("Payment Format"), F.col("is_laundering").alias("Is Laundering"),
    )
    path = _raw_file(spark, folder, "bank", rows, True)
    return files.scan_csv(spark, path, schemas.BANK_TX_RAW, header=True)


def _raw_classes(spark: SparkSession, folder: str) -> DataFrame:
    label = F.coalesce(F.col("label").cast("string"), F.lit("unknown"))
    rows = inputs.nodes(spark, folder).select(F.col("id").alias("txId"), label.alias("class"))
    path = _raw_file(spark, folder, "classes", rows, True)
    return files.scan_csv(spark, path, schemas.GRAPH_CLASSES_RAW, header=True)


def _raw_features(spark: SparkSession, folder: str) -> DataFrame:
    """Headerless: id, step and the feature columns."""
    rows = inputs.nodes(spark, folder).select("id", "step").join(graph_vectors(spark, folder), "id")
    path = _raw_file(spark, folder, "features", rows, False)
    schema = schemas.graph_features_raw(len(NODE_FEATURES))
    return files.scan_csv(spark, path, schema, header=False)


def _raw_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.edges(spark, folder).select(F.col("src").alias("txId1"), F.col("dst").alias("txId2"))
    path = _raw_file(spark, folder, "edges", rows, True)
    return files.scan_csv(spark, path, schemas.GRAPH_EDGES_RAW, header=True)


@query(
    "s1_scan_csv_typed",
    """SELECT strftime(tx_time, '%Y/%m/%d %H:%M') AS ts, from_bank, from_account, to_bank, to_account,
       CAST(amount_received AS DOUBLE) AS amount_received, payment_currency AS receiving_currency,
       CAST(amount_paid AS DOUBLE) AS amount_paid, payment_currency, payment_format, is_laundering FROM bank_tx""",
)
def scan_csv_typed(spark: SparkSession, folder: str) -> DataFrame:
    return _raw_bank(spark, folder)


_FLOATS = ", ".join(f"CAST(CAST({c} AS REAL) AS DOUBLE) AS {c}" for c in NODE_FEATURES)


@query(
    "s2_scan_graph_tx",
    f"""SELECT CAST(n.id AS VARCHAR) AS tx_id, n.step AS time_step, COALESCE(CAST(n.label AS VARCHAR), 'unknown') AS class, {_FLOATS}
        FROM graph_node n JOIN node_vector v ON n.id = v.id""",
)
def scan_graph_tx(spark: SparkSession, folder: str) -> DataFrame:
    joined = _raw_features(spark, folder).join(_raw_classes(spark, folder), "txId")
    return joined.select(
        F.col("txId").alias("tx_id"), "time_step", "class",
        *[F.col(c).cast("double").alias(c) for c in NODE_FEATURES],
    )


@query(
    "s3_scan_bank_tx",
    """SELECT from_bank, count(*) AS txs, CAST(sum(amount_paid) AS DOUBLE) AS paid,
       CAST(sum(is_laundering) AS BIGINT) AS flagged FROM bank_tx GROUP BY 1""",
)
def scan_bank_tx(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.bank_transactions(_raw_bank(spark, folder))
    return rows.groupBy("from_bank").agg(
        F.count(F.lit(1)).alias("txs"),
        F.sum(F.col("amount_paid").cast("decimal(18,2)")).cast("double").alias("paid"),
        F.sum("is_laundering").alias("flagged"),
    )


@query("s4_class_map", "SELECT CAST(id AS VARCHAR) AS tx_id, label AS class_label FROM graph_node")
def class_map(spark: SparkSession, folder: str) -> DataFrame:
    return files.graph_transactions(_raw_classes(spark, folder))


@query(
    "s5_feature_projection",
    f"SELECT CAST(n.id AS VARCHAR) AS tx_id, n.step AS time_step, {_FLOATS} FROM graph_node n JOIN node_vector v ON n.id = v.id",
)
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.graph_features(_raw_features(spark, folder))
    return rows.select("tx_id", "time_step", *[F.col(c).cast("double").alias(c) for c in NODE_FEATURES])


@query(
    "s6_edge_projection",
    "SELECT CAST(src AS VARCHAR) AS src_tx_id, CAST(dst AS VARCHAR) AS dst_tx_id FROM graph_edge",
)
def edge_projection(spark: SparkSession, folder: str) -> DataFrame:
    return files.graph_edges(_raw_edges(spark, folder)).orderBy("src_tx_id", "dst_tx_id")


@query(
    "s7_parse_tx_time",
    "SELECT strftime(tx_time, '%Y-%m-%d %H:%M:%S') AS tx_time, count(*) AS txs FROM bank_tx GROUP BY bank_tx.tx_time",
)
def parse_tx_time(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.bank_transactions(_raw_bank(spark, folder))
    counted = rows.groupBy("tx_time").agg(F.count(F.lit(1)).alias("txs"))
    return counted.select(F.date_format("tx_time", "yyyy-MM-dd HH:mm:ss").alias("tx_time"), "txs")


@query(
    "s8_canonical_sort_export",
    "SELECT count(*) AS rows, true AS same_content, true AS same_after_rerun FROM bank_tx",
)
def canonical_sort_export(spark: SparkSession, folder: str) -> DataFrame:
    """Export twice and compare content hashes with the source."""
    rows = inputs.tx(spark, folder)
    path = scratch_path(spark, "export")
    files.export_sorted(rows, path)
    first = files.content_hash(spark.read.parquet(path)).first()
    files.export_sorted(rows.repartition(7), path)
    source = files.content_hash(rows).withColumnsRenamed({"rows": "n", "hash_sum": "s", "hash_xor": "x"})
    again = files.content_hash(spark.read.parquet(path))
    same = (F.lit(first["hash_sum"]) == F.col("s")) & (F.lit(first["hash_xor"]) == F.col("x"))
    rerun = again.select((F.col("hash_sum") == first["hash_sum"]) & (F.col("hash_xor") == first["hash_xor"])).scalar()
    return source.select(F.col("n").alias("rows"), same.alias("same_content"), rerun.alias("same_after_rerun"))


@query(
    "s9_idempotent_replace",
    "SELECT payment_format, count(*) AS txs FROM bank_tx GROUP BY 1",
)
def idempotent_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Writing the same table twice leaves one copy."""
    path = scratch_path(spark, "replace")
    counts = inputs.tx(spark, folder).groupBy("payment_format").agg(F.count(F.lit(1)).alias("txs"))
    for _ in range(2):
        counts.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("s10_scan_table_gated", "SELECT count(*) AS orders, (SELECT count(*) FROM lineitem) AS items FROM orders")
def scan_table_gated(spark: SparkSession, folder: str) -> DataFrame:
    tables = files.open_tables(
        spark, folder, {"orders.parquet": "generate the tables", "lineitem.parquet": "generate the tables"}
    )
    items = tables["lineitem.parquet"].agg(F.count(F.lit(1))).scalar()
    return tables["orders.parquet"].agg(F.count(F.lit(1)).alias("orders")).select("orders", items.alias("items"))


@query("s11_file_manifest_verify")
def file_manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The given files against pins taken from a first reading."""
    found = manifest.hash_files(spark, f"{folder}/*.parquet")
    pins = inputs.stage(spark, folder, "file-pins", lambda: manifest.hash_files(spark, f"{folder}/*.parquet"))
    return manifest.check_files(pins, found)


@query("s12_file_manifest_drift")
def file_manifest_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded pins with one file changed and one not recorded yet."""
    fresh = manifest.hash_files(spark, f"{folder}/*.parquet")
    pins = fresh.filter("file <> 'region.parquet'").withColumn(
        "bytes", F.when(F.col("file") == "nation.parquet", F.col("bytes") + 1).otherwise(F.col("bytes"))
    )
    return manifest.compare_manifests(pins, fresh)


@query(
    "t7_sort_total",
    f"SELECT {day('tx_time')} AS day, from_bank, from_account, to_bank, to_account, CAST(amount_paid AS DOUBLE) AS amount_paid FROM bank_tx",
)
def sort_total(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.tx(spark, folder)
    ordered = rows.orderBy(*rows.columns)
    return ordered.select(
        day_text("tx_time").alias("day"), "from_bank", "from_account", "to_bank", "to_account",
        F.col("amount_paid").cast(T.DoubleType()).alias("amount_paid"),
    )
