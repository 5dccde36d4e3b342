"""Connected components of a link table by alternating stars.

Each round hangs every vertex's larger neighbours, then its smaller ones, on the
smallest vertex it knows. Only minima per vertex are grouped, which Spark combines
before the shuffle; the rows of a hub are spread by skew-aware joins. Rounds end when
the links no longer change, their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

MOST_ROUNDS = 60


def _hang(links: DataFrame, smaller: bool) -> DataFrame:
    """Links (u, v), v < u. The neighbours of u on one side go to u's minimum."""
    down = links.select("u", "v")
    if smaller:
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    both = down.unionAll(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    up = down.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v (long). Gives vertex, label (smallest vertex of its component)
    for every vertex that is not its component's smallest."""
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(pairs, "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = materialize(_hang(_hang(now, smaller=False), smaller=True), "links")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
        seen = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
