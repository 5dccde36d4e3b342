"""Running totals and ranks over a global order without funnelling the table
through one task.

Rows are range-partitioned on the order, numbered inside each partition and
written once. Totals per partition (a frame of at most partitions + groups
rows) give the offset of every partition, so only partition-sized windows run.
The order must be unique inside a group: equal keys share a range partition, so
fold them first where many rows can tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize

_POS = "_position"
_PART = "_part"
_PART_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def lay_out(df: DataFrame, order: Sequence[Column | str], label: str = "ordered") -> DataFrame:
    """Table in global order, with its position inside each range partition."""
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    return materialize(laid, label).withColumn(_PART, F.shiftright(_POS, _PART_BITS))


def accumulate(
    laid: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums to a laid-out table, per ``by`` group."""
    staged = laid.withColumns({f"_v_{name}": value for name, value in sums.items()})
    keys = [*by, _PART]
    totals = staged.groupBy(*keys).agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(_PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy(*keys).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    )
    running = staged.withColumns(
        {f"_r_{name}": F.sum(f"_v_{name}").over(inside) for name in sums}
    )
    joined = running.join(offsets, keys)
    return joined.select(
        *laid.columns,
        *[(F.col(f"_r_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums],
    )


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(_POS, _PART)


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Inclusive running sums in ``order`` inside each ``by`` group."""
    laid = lay_out(df, [*by, *order])
    return drop_layout(accumulate(laid, sums, by))


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1..n over a total order."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")})
