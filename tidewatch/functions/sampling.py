"""Seeded samples that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 2**32


def sample_key(key: Column | str, seed: int) -> Column:
    """Hash text of a row key and a seed; its order is the sampling order."""
    text = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(text.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows with the smallest hashes, without replacement. Rows
    whose hash cannot be among them are filtered out before the sort, so the
    sort sees about twice the sample, however large the table."""
    keyed = df.withColumn("_key", sample_key(key, seed))
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
    total = df.count()
    if total > rows:
        bound = min(_SPACE, int(_SPACE * (2.0 * rows + 1000) / total))
        near = keyed.filter(place < bound)
        if bound < _SPACE and near.limit(rows).count() == rows:
            keyed = near
    return keyed.orderBy("_key", key).limit(rows).drop("_key")
