"""Raw files against frozen pins of size and SHA-256."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import DataQualityError
from tidewatch.sources import chained

PIN_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("sha256", T.StringType(), False),
    ]
)


def pins_from_manifest(spark: SparkSession, manifest: dict, dataset: str) -> DataFrame:
    """Pins of one dataset; an entry without both values is refused."""
    files = manifest.get("datasets", {}).get(dataset, {}).get("files", {})
    if not files:
        raise DataQualityError(f"manifest lists no files for dataset '{dataset}'")
    bare = sorted(n for n, e in files.items() if not e.get("sha256") or e.get("bytes") is None)
    if bare:
        raise DataQualityError(f"manifest entries of '{dataset}' lack a pin: {', '.join(bare)}")
    rows = [(name, int(e["bytes"]), str(e["sha256"])) for name, e in sorted(files.items())]
    return spark.createDataFrame(rows, PIN_SCHEMA)


# Spark's binary reader holds a file in one record; a longer file is read in parts.
RECORD_BYTES = chained.PART_BYTES
# The most one record is used for: the reader ends at 2 GB.
PACKED_BYTES = 1 << 30
BLOCK_BYTES = chained.BLOCK_BYTES


def stream_digest(stream, block_bytes: int = BLOCK_BYTES) -> str:
    """SHA-256 of a file-like object, block by block."""
    digest = hashlib.sha256()
    while block := stream.read(block_bytes):
        digest.update(block)
    return digest.hexdigest()


def _by_record(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def hash_files(
    spark: SparkSession, path: str, record_bytes: int = RECORD_BYTES, block_bytes: int = BLOCK_BYTES,
    part_bytes: int = chained.PART_BYTES,
) -> DataFrame:
    """Name, size and SHA-256 of every file at a path or glob, of any size. Files of at
    most ``record_bytes`` are hashed as records when the result is read; larger ones now, in
    parts of about ``part_bytes``, each by its own task. The reader lists no empty files:
    their pins count as missing."""
    files = spark.read.format("binaryFile").load(path)
    # only names and sizes are read here: one row per large file
    large = files.filter(F.col("length") > record_bytes).select("path", "length")
    sizes = {r["path"]: r["length"] for r in large.collect()}
    whole = {p: n for p, n in sizes.items() if not chained.can_chain() or chained.is_packed(spark, p)}
    digests = chained.chained_digests(
        spark, {p: n for p, n in sizes.items() if p not in whole}, part_bytes, block_bytes
    )
    rows = [(re.search("[^/]+$", p)[0], sizes[p], digest) for p, digest in digests.items()]
    found = _by_record(files.filter(F.col("length") <= record_bytes))
    if rows:
        found = found.unionAll(spark.createDataFrame(rows, PIN_SCHEMA))
    return found.unionAll(_hash_whole(spark, whole, block_bytes)) if whole else found


def _hash_whole(spark: SparkSession, sizes: dict[str, int], block_bytes: int) -> DataFrame:
    """Files by one task each: Hadoop's readers would unpack them by their name, or Python's
    OpenSSL keeps its state to itself. Longer ones than a record are opened by the task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for where in batch["path"]:
                # Spark writes paths unescaped
                store, at = FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", where), safe=":/@"))
                # the bytes as they are: Arrow, too, would unpack them by the name
                with store.open_input_stream(at, compression=None) as stream:
                    digests.append(stream_digest(stream, block_bytes))
            yield batch.assign(sha256=digests)[["file", "bytes", "sha256"]]

    files = spark.read.format("binaryFile").load([chained.literal_path(p) for p in sizes])
    large = files.filter(F.col("length") > PACKED_BYTES).select(
        "path", F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes")
    )
    hashed = large.repartition("path").mapInPandas(read, "file string, bytes long, sha256 string")
    return _by_record(files.filter(F.col("length") <= PACKED_BYTES)).unionAll(hashed)


def check_files(pins: DataFrame, found: DataFrame) -> DataFrame:
    """Status per pinned file: ok, missing, size or checksum."""
    actual = found.select(
        "file", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256")
    )
    status = (
        F.when(F.col("found_bytes").isNull(), "missing")
        .when(F.col("found_bytes") != F.col("bytes"), "size")
        .when(F.col("found_sha256") != F.col("sha256"), "checksum")
        .otherwise("ok")
    )
    return pins.join(actual, "file", "left").select("file", "bytes", "sha256", status.alias("status"))


def verify_files(pins: DataFrame, found: DataFrame) -> DataFrame:
    """Raise on the first bad pin; the manifest is a short list of files."""
    bad = check_files(pins, found).filter("status <> 'ok'").orderBy("file").take(1)
    if bad:
        raise DataQualityError(f"raw file {bad[0]['file']} fails its pin: {bad[0]['status']}")
    return pins


def compare_manifests(pins: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh hashes against recorded pins: new, same, drifted or absent. The
    pinned value always stays; only new files add one."""
    f = fresh.select(
        "file", F.col("bytes").alias("fresh_bytes"), F.col("sha256").alias("fresh_sha256")
    )
    status = (
        F.when(F.col("bytes").isNull(), "new")
        .when(F.col("fresh_bytes").isNull(), "absent")
        .when(
            (F.col("bytes") == F.col("fresh_bytes"))
            & (F.col("sha256") == F.col("fresh_sha256")),
            "same",
        )
        .otherwise("drifted")
    )
    return pins.join(f, "file", "full_outer").select(
        "file",
        F.coalesce("bytes", "fresh_bytes").alias("bytes"),
        F.coalesce("sha256", "fresh_sha256").alias("sha256"),
        status.alias("status"),
    )
