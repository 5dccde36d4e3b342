"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import configure

# Rows of one Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id and text alone (a null text is the empty one), so that further
    columns of the input never clash with columns an operator adds."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """``mapInArrow`` with one set-up per task: ``make()`` gives a function from a
    batch to columns (lists or arrays by name), which are cast to ``schema``."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield as_batch(step(batch), arrow)

    return df.mapInArrow(run, schema)


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in arrow:
        values = columns[field.name]
        if isinstance(values, (pa.Array, pa.ChunkedArray)):
            arrays.append(values.cast(field.type))
        else:
            arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing reads any more."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words_of(text: str) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, split at ASCII white space. Bytes
    know exactly these rules."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (a public mixing function)."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id's text modulo ``modulus`` equals ``rest`` (null id: of '')."""
    digest = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (digest % modulus) == rest
