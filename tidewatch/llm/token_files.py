"""Token-ID files: tokenised documents, in ascending doc_id order, coded by rANS.

``write_token_files`` lays documents out by ranges of doc_id and writes, per range,
a run of segments (see ``rans``), each a row of a Parquet folder, so that any store
Spark reaches will do, tasks commit as Spark's writers do, and segments decode in
parallel. ``read_token_files`` gives the documents back.

Defined cases: a null text counts as empty and holds the end id alone; a null doc_id
sorts first; rows of one doc_id are kept, in the order of their texts; an empty table
gives an empty folder; a text of any length stays in one segment. Further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import as_batch, column, text_list, texts_of
from tidewatch.llm.rans import NULL_ID, Segment, encode_segment
from tidewatch.llm.tokens import piece_encoder

# Ids gathered before a segment is closed; the text in hand is finished first.
SEGMENT_IDS = 1 << 21

FILE_SCHEMA = "part int, seq int, first_id long, n_documents long, n_ids long, payload binary"
_FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()),
    ("n_documents", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()),
])
_IDS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
])


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS
) -> None:
    """``first_id`` counts the ids of the same part before the segment."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(tokenizer).encode
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        packed: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            return as_batch({
                "part": [part], "seq": [seq], "first_id": [before], "n_documents": [len(keys)],
                "n_ids": [held], "payload": [encode_segment(keys, packed)],
            }, _FILE_ARROW)

        for batch in batches:
            for key, text in zip(column(batch, "doc_id").to_pylist(), text_list(batch), strict=True):
                ids = encode(text) + end
                keys.append(key)
                packed.append(ids)
                held += len(ids) // 4
                if held >= segment_ids:
                    yield close()
                    seq, before, held = seq + 1, before + held, 0
                    keys, packed = [], []
        if keys:
            yield close()

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit integers). Checksums are verified; damage raises.

    Only the totals of the parts, as many as the writing job had partitions, pass
    through the driver."""
    stored = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = sorted(
        (r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    )
    base, so_far = {}, 0
    for part, n in totals:
        base[part] = so_far
        so_far += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, payload = (column(batch, c)[row].as_py() for c in ("part", "first_id", "payload"))
                segment = Segment(payload)
                ids = segment.decode().astype("<u4")
                lengths = segment.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.tobytes()
                yield as_batch({
                    "doc_id": [None if k == NULL_ID else int(k) for k in segment.doc_ids],
                    "start": starts + (base[part] + first), "n_tokens": lengths,
                    "ids": [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)],
                }, _IDS_ARROW)

    return stored.select("part", "first_id", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def digest(tokens: DataFrame) -> DataFrame:
    """The contract's columns; Spark's crc32 is the unsigned one."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
