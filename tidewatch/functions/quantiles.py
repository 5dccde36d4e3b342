"""Exact lower quantiles (inverse of the empirical distribution) of many
columns at once.

A first pass takes an approximate sketch per column, whose rank error is
bounded, and brackets every wanted quantile. The second pass keeps exact values
only inside the brackets and folds everything else onto the next bracket's lower
end, so running counts inside a bracket stay exact while only a sliver of the
data is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cumulative import running_sums


def unpivot(
    df: DataFrame, values: dict[str, Column], keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., column, value) with one row per cell, without a shuffle."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()]
    )
    return df.select(*keep, F.inline(cells))


def _snap(value: Column, spans: list[tuple[float, float]]) -> Column:
    """The value itself inside a bracket, else the next bracket's lower end."""
    snapped = F.when(value < spans[0][0], spans[0][0]).when(value <= spans[0][1], value)
    for low, high in spans[1:]:
        snapped = snapped.when(value < low, low).when(value <= high, value)
    return snapped.otherwise(float("inf"))


def _brackets(row: dict, columns: Sequence[str]) -> dict[str, list[tuple[float, float]]]:
    merged: dict[str, list[tuple[float, float]]] = {}
    for at, column in enumerate(columns):
        ends = row[f"q{at}"]
        spans: list[tuple[float, float]] = []
        for lo, hi in zip(ends[0::2], ends[1::2], strict=True):
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        merged[column] = spans
    return merged


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """(column, edges, lowest, highest): ``edges`` holds the distinct quantiles
    in ascending order. For probability p of n values the quantile is the value
    at 1-based position ceil(n * p) of the sorted column. Columns must be free
    of NULL and NaN."""
    slack = 2.0 / accuracy  # twice the sketch's rank error
    asked = [min(1.0, max(0.0, p + sign * slack)) for p in probs for sign in (-1, 1)]
    numbers = {c: F.col(c).cast("double") for c in columns}
    sketch = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(v, asked, accuracy).alias(f"q{i}") for i, v in enumerate(numbers.values())],
        *[F.min(v).alias(f"min{i}") for i, v in enumerate(numbers.values())],
        *[F.max(v).alias(f"max{i}") for i, v in enumerate(numbers.values())],
    ).first()
    n = sketch["n"]
    if n == 0:
        raise ValueError("quantiles of an empty frame are undefined")
    targets = sorted({max(1, math.ceil(n * p)) for p in probs})
    # columns x brackets numbers: bounded by the width of the table, so they
    # become literals of one generated expression per column
    spans = _brackets(sketch.asDict(), columns)
    counted = (
        unpivot(df, {c: _snap(v, spans[c]) for c, v in numbers.items()})
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    running = running_sums(counted, [F.col("value")], {"upto": F.col("rows")}, by=["column"])

    def at(target: int) -> Column:
        return F.min(F.when(F.col("upto") >= target, F.col("value")))

    limits = df.sparkSession.createDataFrame(
        [(c, sketch[f"min{i}"], sketch[f"max{i}"]) for i, c in enumerate(columns)],
        "column string, lowest double, highest double",
    )
    edges = running.groupBy("column").agg(
        F.sort_array(F.array_distinct(F.array(*[at(t) for t in targets]))).alias("edges")
    )
    return edges.join(F.broadcast(limits), "column")
