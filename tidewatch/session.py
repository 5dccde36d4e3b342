"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that are safe to apply to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed side even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "tidewatch",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session for tests, the bench and ad-hoc runs. On a cluster leave
    ``master`` to spark-submit; partition counts are then AQE's business."""
    builder = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.bindAddress", "127.0.0.1")
        builder = builder.config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the shared one the cluster names in
    ``spark.checkpoint.dir``. Only a local-mode session may make its own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tidewatch-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return f"{root}/tidewatch-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table once and continue from it. It cuts lineage,
    survives executor loss and lets every consumer prune columns. Such tables take much of
    a long job's disk, so they are packed harder than Spark's default."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key over as many tasks as the cluster has cores, for a small table
    that takes much arithmetic: file sizes would leave most cores idle."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` beside ``path`` and put it in its place when it is complete. The old
    table steps aside first and comes back if the new one cannot be renamed, so a failed
    job or rename leaves it whole."""
    spark = df.sparkSession
    number = uuid.uuid4().hex
    df.write.parquet(f"{path}.new-{number}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, aside = (hadoop.Path(p) for p in (f"{path}.new-{number}", path, f"{path}.old-{number}"))
    store = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    swap_folders(store, new, old, aside)
    return spark.read.schema(df.schema).parquet(path)


def swap_folders(store, new, old, aside) -> None:
    """``new`` takes the place of ``old``, over Hadoop's file system calls."""
    had = store.exists(old)
    if had and not store.rename(old, aside):
        raise OSError(f"{old} could not be moved aside")
    moved = False
    try:
        moved = store.rename(new, old)
    finally:
        if had and not moved:
            store.rename(aside, old)
    if not moved:
        raise OSError(f"{new} could not be renamed to {old}")
    if had:
        store.delete(aside, True)
