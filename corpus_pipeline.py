"""The training-data pipeline: five stages over ``documents``.

``STAGES`` names them in order. Each takes (spark, docs, sf_dir) and works on all that
the stage before kept; all but the last return the columns of its input. ``run`` writes
each stage's result as Parquet into the shared folder and reads it back for the next,
so that a lost executor costs one stage at most.

Rows are told apart by doc_id and text. Rows that share both are copies: the near-copy
stage keeps one of them, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, ngram_join, packing, pii, quality
from tidewatch.llm.common import prepare, table
from tidewatch.session import materialize

# What stands in a text for what was removed from it.
TAGS = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>", "found": "<id>"}


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a hash of the text under a name that is free."""
    name = "text_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))), name


def _match(docs: DataFrame, picked: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that have (left_semi) or lack (left_anti) a row of the same
    doc_id and text_key in ``picked``."""
    rows, name = _keyed(docs)
    picked = picked.select(F.col("doc_id").alias("picked_id"), F.col("text_key").alias("picked_key")).distinct()
    same = rows["doc_id"].eqNullSafe(picked["picked_id"]) & (rows[name] == picked["picked_key"])
    return rows.join(picked, same, how).drop(name)


def _has_words(docs: DataFrame):
    return F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good stay. Scores are computed from
    the rows themselves, so no join with them is needed."""
    prepare(spark)
    found = materialize(quality.features(docs), "quality-statistics")
    model = quality.learn(found, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays (of rows
    that also share it, the one with the smallest text hash, once). Texts without
    words are linked with nothing and stay."""
    prepare(spark)
    placed = materialize(ngram_join.join(docs), "near-copies")
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(ngram_join.NO_ID)).alias("k"), "text_key", "doc_id")
    heads = placed.where("n_shingles > 0").groupBy("label").agg(F.min(order).alias("r")).select("r.doc_id", "r.text_key")
    chosen, name = _keyed(_match(docs.where(_has_words(docs)), heads, "left_semi"))
    chosen = chosen.dropDuplicates(["doc_id", name]).drop(name)
    return chosen.unionAll(docs.where(~_has_words(docs)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    hits = materialize(decontamination.find(docs, table(spark, sf_dir, "benchmark")), "leaks")
    return _match(docs, hits, "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by tags; n_chars follows the text."""
    prepare(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in others)).alias("_others")
    found = pii.extract(docs, packed, texts=True)
    text = pii.redacted(F.col("text"), pii.tagged(TAGS))
    clean = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*(F.col(f"_others.{c}").alias(c) if c in others else F.col(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    prepare(spark)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(docs, path, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# Tokenisation and the classifier are beyond SQL; a brute-force test covers the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
