"""Model matrix, temporal splits, class weights and standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import SplitConfig
from tidewatch.errors import DataQualityError
from tidewatch.operators import gates


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def binary_label(label: Column | str) -> Column:
    """1 for illicit, 0 for licit; meant for labelled rows."""
    c = F.col(label) if isinstance(label, str) else label
    return (c == 1).cast("int")


def node_label(label: Column | str) -> Column:
    """1 illicit, 0 licit, -1 unknown."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == 1, 1).when(c == 2, 0).otherwise(-1)


def model_matrix(
    nodes: DataFrame, features: DataFrame, graph: DataFrame | None = None
) -> DataFrame:
    """Labelled rows with raw and, if given, graph features: (id, step, y, ...)."""
    base = labelled(nodes).select("id", "step", binary_label("label").alias("y"))
    joined = base.join(features, "id")
    return joined if graph is None else joined.join(graph, "id")


def check_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    gates.enforce(gates.no_nan(df, columns))
    return df


def with_side(df: DataFrame, cfg: SplitConfig = SplitConfig(), protocol: str = "test") -> DataFrame:
    """``side`` is train or test (train or validation while tuning), NULL for
    rows outside both. The test period never enters tuning."""
    step = F.col("step")
    if protocol == "test":
        side = F.when(step <= cfg.train_max, "train").when(step >= cfg.test_min, "test")
    elif protocol == "tuning":
        side = F.when(step <= cfg.tuning_train_max, "train").when(
            step.between(cfg.tuning_val_min, cfg.tuning_val_max), "validation"
        )
    else:
        raise ValueError(f"unknown protocol {protocol!r}")
    return df.withColumn("side", side)


def split_temporal(
    df: DataFrame, cfg: SplitConfig = SplitConfig(), protocol: str = "test"
) -> tuple[DataFrame, DataFrame]:
    sided = with_side(df, cfg, protocol)
    train = sided.filter("side = 'train'").drop("side")
    other = sided.filter("side <> 'train'").drop("side")
    if train.isEmpty() or other.isEmpty():
        raise DataQualityError(f"the {protocol} split has an empty side")
    return train, other


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """(y, n, weight) with balanced weights n / (2 * n_class) and the positive
    weight n0 / n1 used by neural baselines."""
    counts = df.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar().cast("double")
    return counts.select("y", "n", (total / (2 * F.col("n"))).alias("weight"))


def weighted(df: DataFrame, label: str = "y") -> DataFrame:
    """Rows with their balanced class weight; the two weights are a tiny side."""
    weights = class_weights(df, label).select(F.col("y").alias(label), "weight")
    return df.join(F.broadcast(weights), label)


def standardize_stats(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column of the training rows; one
    aggregate row, as wide as the table. A constant column keeps its scale."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()}
    )


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    maker = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")
    return maker.transform(df).select(*keep, "features")
