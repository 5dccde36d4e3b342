"""Data-quality gates.

A gate is a one-row frame (rule, expected, actual, passed), text except for the
flag. Gates over the same job are unioned and checked together before anything
is written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import DataQualityError
from tidewatch.sources.files import union_all


def _report(df: DataFrame, rule: str, expected: Column, actual: Column, passed: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def exact_count(df: DataFrame, expected: int, rule: str = "exact_count") -> DataFrame:
    n = F.col("n")
    return _report(_counted(df), rule, F.lit(expected), n, n == expected)


def min_count(df: DataFrame, minimum: int, rule: str = "min_count") -> DataFrame:
    n = F.col("n")
    return _report(_counted(df), rule, F.lit(minimum), n, n >= minimum)


def not_empty(df: DataFrame, rule: str = "not_empty") -> DataFrame:
    """Looks at one row only."""
    return min_count(df.limit(1), 1, rule)


def class_distribution(
    df: DataFrame, label: str, expected: Iterable[tuple[int | None, int]], rule: str = "class_count"
) -> DataFrame:
    """One row per expected class; NULL is a class of its own, a class without
    rows fails."""
    spec = df.sparkSession.createDataFrame(list(expected), "wanted int, expected bigint")
    counts = df.groupBy(F.col(label).cast("int").alias("found")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = spec.join(counts, F.col("wanted").eqNullSafe(F.col("found")), "left")
    name = F.concat(F.lit(f"{rule}:"), F.coalesce(F.col("wanted").cast("string"), F.lit("unknown")))
    return joined.select(
        name.alias("rule"),
        F.col("expected").cast("string").alias("expected"),
        F.coalesce(F.col("n").cast("string"), F.lit("missing")).alias("actual"),
        F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("passed"),
    )


def step_set(df: DataFrame, step: str, first: int, last: int, rule: str = "step_set") -> DataFrame:
    """The distinct steps are exactly first..last."""
    wanted = df.sparkSession.range(first, last + 1).select(
        F.col("id").alias("step"), F.lit(1).alias("wanted")
    )
    found = df.select(F.col(step).cast("bigint").alias("step")).distinct().withColumn("found", F.lit(1))
    diff = wanted.join(found, "step", "full_outer").agg(
        F.count_if(F.col("found").isNull()).alias("missing"),
        F.count_if(F.col("wanted").isNull()).alias("unexpected"),
    )
    actual = F.concat(
        F.lit("missing="), F.col("missing").cast("string"),
        F.lit(";unexpected="), F.col("unexpected").cast("string"),
    )
    ok = (F.col("missing") == 0) & (F.col("unexpected") == 0)
    return _report(diff, rule, F.lit(f"{first}..{last}"), actual, ok)


def no_rows(df: DataFrame, rule: str) -> DataFrame:
    """The frame of offending rows is empty."""
    n = F.col("n")
    return _report(_counted(df), rule, F.lit(0), n, n == 0)


def referential(nodes: DataFrame, edges: DataFrame, rule: str = "referential") -> DataFrame:
    """Every edge end is a known node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return no_rows(ends.join(nodes.select("id"), "id", "left_anti"), rule)


def same_ids(left: DataFrame, right: DataFrame, key: str, rule: str = "id_sets_equal") -> DataFrame:
    """Both sides hold the same ids. One grouped union finds the differences of
    both directions."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    diff = (
        sides.groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .agg(
            F.count_if(F.col("r") == 0).alias("only_left"),
            F.count_if(F.col("l") == 0).alias("only_right"),
        )
    )
    actual = F.concat(
        F.lit("only_left="), F.col("only_left").cast("string"),
        F.lit(";only_right="), F.col("only_right").cast("string"),
    )
    ok = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    return _report(diff, rule, F.lit("only_left=0;only_right=0"), actual, ok)


def distinct_accounts(tx: DataFrame, minimum: int, rule: str = "distinct_accounts") -> DataFrame:
    """Distinct (bank, account) over both sides of the payments."""
    both = F.array(
        F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")),
        F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")),
    )
    return min_count(tx.select(F.inline(both)).distinct(), minimum, rule)


def rate_band(
    tx: DataFrame, flag: str, target: float, tolerance: float, pinned: int, rule: str = "flagged"
) -> DataFrame:
    """Flagged share within a relative band and flagged count equal to its pin:
    two rows from one aggregate."""
    row = tx.agg(
        F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias("hits"),
        F.count(F.lit(1)).alias("n"),
    )
    rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    low, high = target * (1 - tolerance), target * (1 + tolerance)
    checks = F.array(
        F.struct(
            F.lit(f"{rule}_rate").alias("rule"),
            F.lit(f"{low:.6f}..{high:.6f}").alias("expected"),
            F.round(rate, 6).cast("decimal(10,6)").cast("string").alias("actual"),
            rate.between(low, high).alias("passed"),
        ),
        F.struct(
            F.lit(f"{rule}_count").alias("rule"),
            F.lit(str(pinned)).alias("expected"),
            F.col("hits").cast("string").alias("actual"),
            (F.col("hits") == pinned).alias("passed"),
        ),
    )
    return row.select(F.inline(checks))


def scalar(df: DataFrame, rule: str = "scalar") -> int:
    """The single number of a gate query; no row or NULL is itself a failure."""
    row = df.first()
    if row is None or row[0] is None:
        raise DataQualityError(f"gate query '{rule}' returned no value")
    return int(row[0])


def scalar_present(df: DataFrame, rule: str = "scalar_present") -> DataFrame:
    """The same check as a report row: the frame has exactly one non-NULL value."""
    name = df.columns[0]
    n = F.col("n")
    return _report(df.agg(F.count(name).alias("n")), rule, F.lit(1), n, n == 1)


def no_nulls(df: DataFrame, columns: Iterable[str], rule: str = "no_nulls") -> DataFrame:
    bad = F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)
    return _report(
        df.agg(F.count_if(bad).alias("n")), rule, F.lit(0), F.col("n"), F.col("n") == 0
    )


def no_nan(df: DataFrame, columns: Iterable[str], rule: str = "no_nan") -> DataFrame:
    """No NULL and no NaN in numeric columns; counts offending rows."""
    bad = F.exists(
        F.array(*[F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns]),
        lambda x: x,
    )
    return _report(
        df.agg(F.count_if(bad).alias("n")), rule, F.lit(0), F.col("n"), F.col("n") == 0
    )


def feature_coverage(features: DataFrame, nodes: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per node, same ids, no NULL in the required columns."""
    columns = list(columns)
    per_id = (
        features.select("id", F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)
                        .cast("int").alias("null_row"), F.lit(1).alias("f"), F.lit(0).alias("k"))
        .unionByName(nodes.select("id", F.lit(0).alias("null_row"), F.lit(0).alias("f"), F.lit(1).alias("k")))
        .groupBy("id")
        .agg(F.sum("f").alias("f"), F.sum("k").alias("k"), F.sum("null_row").alias("null_rows"))
        .agg(
            F.sum("f").alias("rows"), F.sum("k").alias("nodes"),
            F.count_if((F.col("f") == 0) | (F.col("k") == 0)).alias("unmatched"),
            F.sum("null_rows").alias("null_rows"),
        )
    )

    def check(rule: str, expected: Column, actual: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), expected.cast("string").alias("expected"),
            actual.cast("string").alias("actual"), (expected == actual).alias("passed"),
        )

    zero = F.lit(0).cast("bigint")
    return per_id.select(F.inline(F.array(
        check("coverage_rows", F.col("nodes"), F.col("rows")),
        check("coverage_ids", zero, F.col("unmatched")),
        check("coverage_nulls", zero, F.col("null_rows")),
    )))


def column_set(df: DataFrame, expected: Iterable[str], rule: str = "alert_schema") -> DataFrame:
    """The stored table's column set is exactly the expected one."""
    want, got = ",".join(sorted(expected)), ",".join(sorted(df.columns))
    return _report(_counted(df), rule, F.lit(want), F.lit(got), F.lit(want == got))


def two_classes(df: DataFrame, label: str, rule: str = "two_classes") -> DataFrame:
    """The labels hold at least two values; counts classes without a distinct."""
    seen = df.agg((F.max(F.col(label) == 1).cast("int") + F.max(F.col(label) == 0).cast("int")).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return _report(seen, rule, F.lit(2), n, n == 2)


def cut_before_last(cuts: DataFrame, rule: str = "cut_points") -> DataFrame:
    """The test cut lies before the last day."""
    return _report(cuts, rule, F.col("last"), F.col("day2"), F.col("day2") < F.col("last"))


def steps_before(train: DataFrame, step: str, as_of: int, rule: str = "no_lookahead_rows") -> DataFrame:
    """Training rows exist and all lie strictly before the as-of step."""
    latest = F.col("latest")
    return _report(train.agg(F.max(step).alias("latest")), rule, F.lit(f"<{as_of}"), latest, latest < as_of)


def edges_within(edges: DataFrame, limit: int, rule: str = "no_lookahead_edges") -> DataFrame:
    """No kept edge reaches beyond the limit; an empty edge set passes."""
    latest = F.coalesce(F.col("latest"), F.lit(0))
    row = edges.agg(F.max(F.greatest("src_step", "dst_step")).alias("latest"))
    return _report(row, rule, F.lit(f"<={limit}"), latest, latest <= limit)


def split_not_empty(rows: DataFrame, step: str, train_max: int, test_min: int, rule: str = "split") -> DataFrame:
    sides = rows.agg(
        F.count_if(F.col(step) <= train_max).alias("train"),
        F.count_if(F.col(step) >= test_min).alias("test"),
    )
    actual = F.concat(
        F.lit("train="), F.col("train").cast("string"), F.lit(";test="), F.col("test").cast("string")
    )
    ok = (F.col("train") > 0) & (F.col("test") > 0)
    return _report(sides, rule, F.lit("train>0;test>0"), actual, ok)


def metric_floor(metrics: DataFrame, column: str, floor: float, rule: str = "roc_auc") -> DataFrame:
    """Every model reaches the floor; one row per model."""
    value = F.col(column)
    return metrics.select(
        F.concat(F.lit(f"{rule}:"), "model").alias("rule"),
        F.lit(f">={floor}").alias("expected"),
        F.round(value, 6).cast("decimal(10,6)").cast("string").alias("actual"),
        F.coalesce(value >= floor, F.lit(False)).alias("passed"),
    )


def no_breach(drift: DataFrame, rule: str = "psi_breach") -> DataFrame:
    n = F.col("n")
    return _report(
        drift.agg(F.count_if(F.col("status") == "breach").alias("n")), rule, F.lit(0), n, n == 0
    )


def enforce(*reports: DataFrame) -> None:
    """Run all gates as one job and raise on the failures."""
    failed = union_all(list(reports)).filter("NOT passed").orderBy("rule").collect()
    if failed:
        listed = "; ".join(
            f"{r['rule']}: expected {r['expected']}, got {r['actual']}" for r in failed
        )
        raise DataQualityError(listed)
