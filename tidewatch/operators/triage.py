"""Alert triage: cut points, fused ranked queue and operational figures."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import TriageConfig
from tidewatch.errors import DataQualityError
from tidewatch.functions.columns import alert_day
from tidewatch.functions.cumulative import accumulate, drop_layout, lay_out
from tidewatch.operators.alerts import flagged_accounts

QUEUE_COLUMNS = [
    "rank", "scenario", "entity", "alert_day", "rule_component", "ml_component",
    "fused_score", "reason", "details",
]


@dataclass(frozen=True)
class CutPoints:
    first: date
    last: date
    day1: date
    day2: date

    @property
    def days_eval(self) -> int:
        return (self.last - self.day2).days


def cut_point_frame(tx: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """One row: first, last, day1, day2. Fractions of the span round half to even."""
    bounds = tx.agg(
        F.to_date(F.min("tx_time")).alias("first"), F.to_date(F.max("tx_time")).alias("last")
    )
    span = F.datediff("last", "first")

    def cut(fraction: float) -> Column:
        return F.date_add("first", F.bround(span * F.lit(fraction), 0).cast("int"))

    return bounds.select(
        "first", "last", cut(cfg.train_cut).alias("day1"), cut(cfg.test_cut).alias("day2")
    )


def cut_points(tx: DataFrame, cfg: TriageConfig = TriageConfig()) -> CutPoints:
    row = cut_point_frame(tx, cfg).first()
    if row is None or row["first"] is None:
        raise DataQualityError("there are no transactions to triage")
    cuts = CutPoints(row["first"], row["last"], row["day1"], row["day2"])
    if cuts.day2 >= cuts.last:
        raise DataQualityError("the time span is too short: no day after the test cut")
    return cuts


def account_universe(tx: DataFrame) -> DataFrame:
    """Number of distinct account names on either side."""
    return (
        tx.select(F.explode(F.array("from_account", "to_account")).alias("acct"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("universe"))
    )


def triage_meta(tx: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """One row: cut points, account universe, days in the evaluation window."""
    universe = account_universe(tx).scalar()
    return cut_point_frame(tx, cfg).select(
        "day1", "day2", universe.alias("universe"), F.datediff("last", "day2").alias("days_eval")
    )


def label_accounts(accounts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Boolean label: the account is in the flagged set."""
    marks = flagged.select("acct", F.lit(1).alias("_hit"))
    return (
        accounts.join(marks, "acct", "left")
        .withColumn("label", F.col("_hit").isNotNull().cast("int"))
        .drop("_hit")
    )


def with_alert_day(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_day", alert_day("details"))


def fuse(scored: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Weighted mean of model and rule part; the rule part alone where the
    account had no history."""
    ml, rule = F.col("ml_component"), F.col("rule_component")
    mixed = F.lit(cfg.ml_weight) * ml + F.lit(cfg.rule_weight) * rule
    return scored.withColumn("fused_score", F.when(ml.isNull(), rule).otherwise(mixed))


def fused_alerts(
    alerts: DataFrame, stats: DataFrame, scores: DataFrame, cfg: TriageConfig = TriageConfig()
) -> DataFrame:
    """Alerts with rule weight, model score and fused score. ``scores`` has one
    (acct, day, ml_component) per alert with history."""
    weights = stats.select("scenario", F.col("laundering_entity_precision").alias("weight"))
    ml = scores.select(
        F.col("acct").alias("entity"), F.col("day").alias("alert_day"), "ml_component"
    )
    staged = alerts if "alert_day" in alerts.columns else with_alert_day(alerts)
    joined = (
        # one row per scenario: a fixed handful
        staged.join(F.broadcast(weights), "scenario", "left")
        .withColumn("rule_component", F.coalesce("weight", F.lit(0.0)))
        .drop("weight")
        .join(ml, ["entity", "alert_day"], "left")
    )
    return fuse(joined, cfg)


def condense(staged: DataFrame) -> DataFrame:
    """One alert per (entity, day, scenario), the first by text: alerts that
    share these three share their score, so the queue keeps at most this one.
    Applied before any join, it removes the weight of an entity with very many
    alerts on a day on the map side."""
    first = F.min(F.struct("details", "reason")).alias("first")
    return staged.groupBy("entity", "alert_day", "scenario").agg(first).select(
        "scenario", "entity", "alert_day", "first.details", "first.reason"
    )


def queue_order() -> list[Column]:
    return [
        F.col("fused_score").desc(),
        F.col("ml_component").desc_nulls_last(),
        F.col("entity").asc(),
        F.col("alert_day").asc(),
        F.col("scenario").asc(),
    ]


def one_per_entity_day(fused: DataFrame) -> DataFrame:
    """Best alert per (entity, day). A minimum over an ordered struct combines
    on the map side, so an account with very many alerts on a day is no
    bottleneck. Alerts equal in score and scenario are told apart by text."""
    best = F.min(
        F.struct(
            (-F.col("fused_score")).alias("minus_fused"),
            F.col("ml_component").isNull().alias("no_ml"),
            (-F.col("ml_component")).alias("minus_ml"),
            "scenario", "details", "reason", "rule_component", "ml_component", "fused_score",
        )
    ).alias("best")
    return fused.groupBy("entity", "alert_day").agg(best).select(
        "entity", "alert_day", "best.scenario", "best.rule_component", "best.ml_component",
        "best.fused_score", "best.reason", "best.details",
    )


def ranked_queue(fused: DataFrame) -> DataFrame:
    """Queue with ``rank`` over all alerts and ``scenario_rank`` inside each
    scenario, from one range exchange."""
    one = F.lit(1).cast("bigint")
    laid = lay_out(one_per_entity_day(fused), queue_order(), "alert-queue")
    whole = accumulate(laid, {"rank": one})
    return drop_layout(accumulate(whole, {"scenario_rank": one}, by=["scenario"]))


def alert_queue(fused: DataFrame) -> DataFrame:
    return ranked_queue(fused).select(*QUEUE_COLUMNS)


def triage_kpi(
    queue: DataFrame,
    flagged: DataFrame,
    meta: DataFrame,
    cfg: TriageConfig = TriageConfig(),
    k: int | None = None,
    cost: float | None = None,
) -> DataFrame:
    """Operational figures per scope (all alerts and each scenario) at the
    operating point. ``queue`` comes from ``ranked_queue``; ``meta`` is the
    one-row frame of ``triage_meta``. Every scope is cut at the same k."""
    depth = cfg.operating_k if k is None else k
    price = cfg.cost_per_case if cost is None else cost
    scopes = F.array(
        F.struct(F.lit("overall").alias("scope"), F.col("rank").alias("at")),
        F.struct(F.col("scenario").alias("scope"), F.col("scenario_rank").alias("at")),
    )
    deepest = max([depth, *cfg.precision_ks])
    placed = queue.select("entity", F.inline(scopes)).filter(F.col("at") <= deepest)
    # an entity counts once per depth: its best place decides
    per_entity = placed.groupBy("scope", "entity").agg(
        F.min("at").alias("best"),
        *[
            F.count_if(F.col("at") <= n).alias(f"rows_{n}")
            for n in sorted({depth, *cfg.precision_ks})
        ],
    )
    hits = flagged.select(F.col("acct").alias("entity"), F.lit(1).alias("hit"))
    joined = per_entity.join(hits, "entity", "left")

    def found(n: int) -> Column:
        return F.count_if(F.col("hit").isNotNull() & (F.col("best") <= n))

    grouped = joined.groupBy("scope").agg(
        F.sum(f"rows_{depth}").alias("alerts_investigated"),
        F.count_if(F.col("best") <= depth).alias("alerted"),
        found(depth).alias("true_positives"),
        *[
            F.try_divide(found(n).cast("double"), F.sum(f"rows_{n}").cast("double")).alias(
                f"precision_at_{n}"
            )
            for n in cfg.precision_ks
        ],
    )
    flagged_count = flagged.agg(F.count(F.lit(1))).scalar().cast("double")
    universe = meta.select("universe").scalar().cast("double")
    days = meta.select("days_eval").scalar().cast("double")
    n, tp = F.col("alerts_investigated").cast("double"), F.col("true_positives").cast("double")
    innocent = universe - flagged_count
    false_rate = F.try_divide(F.col("alerted").cast("double") - tp, innocent)
    return grouped.select(
        "scope",
        "alerts_investigated",
        "true_positives",
        F.round(F.try_divide(tp, flagged_count), 4).alias("detection_rate"),
        F.when(innocent > 0, F.round(false_rate, 6)).alias("false_positive_rate"),
        F.round(F.try_divide(n, days), 4).alias("alerts_per_day"),
        F.round(F.try_divide(tp, n), 4).alias("investigation_yield"),
        F.round(F.try_divide(n * F.lit(float(price)), tp), 2).alias("cost_per_true_positive"),
        *[F.round(f"precision_at_{n}", 4).alias(f"precision_at_{n}") for n in cfg.precision_ks],
    )


def what_if(
    queue: DataFrame,
    flagged: DataFrame,
    meta: DataFrame,
    scenario: str | None,
    k: int,
    cost: float,
    cfg: TriageConfig = TriageConfig(),
) -> DataFrame:
    """The figures of one scope at any depth and price."""
    rows = triage_kpi(queue, flagged, meta, cfg, k=k, cost=cost)
    return rows.filter(F.col("scope") == (scenario or "overall"))


def precision_curve(
    queue: DataFrame, flagged: DataFrame, cfg: TriageConfig = TriageConfig()
) -> DataFrame:
    """Row-level precision, running hits and cost per hit at fixed depths and
    at the end of the queue. Each row goes to the first depth that covers it, so
    only one row per depth has to be accumulated."""
    depths = F.array(*[F.lit(d).cast("bigint") for d in cfg.curve_depths])
    hits = flagged.select(F.col("acct").alias("entity"), F.lit(1).alias("hit"))
    cell = F.coalesce(F.get(F.filter(depths, lambda d: d >= F.col("rank")), F.lit(0)), F.lit(-1))
    cells = (
        queue.join(hits, "entity", "left")
        .groupBy(cell.alias("depth"))
        .agg(
            F.count("hit").alias("hits"),
            F.max("rank").alias("last_rank"),
        )
    )
    # at most one row per depth from here on
    packed = cells.agg(
        F.sort_array(F.collect_list(F.struct("last_rank", "hits"))).alias("cells"),
        F.max("last_rank").alias("n"),
    )
    asked = F.array_sort(
        F.array_distinct(
            F.concat(F.filter(depths, lambda d: d <= F.col("n")), F.array(F.col("n")))
        )
    )
    exploded = packed.filter("n IS NOT NULL").select("cells", F.explode(asked).alias("k"))
    total = F.aggregate(
        F.filter("cells", lambda c: c["last_rank"] <= F.col("k")),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + c["hits"],
    )
    return exploded.select("k", total.alias("true_positives")).select(
        "k",
        F.try_divide(F.col("true_positives").cast("double"), F.col("k").cast("double")).alias(
            "precision"
        ),
        "true_positives",
        F.try_divide(
            F.col("k").cast("double") * F.lit(cfg.cost_per_case),
            F.col("true_positives").cast("double"),
        ).alias("cost_per_true_positive"),
    )


def marginal_cost(kpi: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Price of one more true positive between consecutive depths, from the
    overall figures; the operating point is the middle depth."""
    low, mid, high = cfg.precision_ks[0], cfg.operating_k, cfg.precision_ks[-1]

    def hits(n: int) -> Column:
        return F.round(F.col(f"precision_at_{n}") * n, 0).cast("bigint")

    tp_mid = F.col("true_positives")

    def band(start: int, end: int, gained: Column) -> Column:
        price = F.when(
            gained > 0,
            F.lit((end - start) * cfg.cost_per_case) / F.when(gained > 0, gained).cast("double"),
        )
        return F.struct(
            F.lit(start).alias("from_depth"), F.lit(end).alias("to_depth"),
            gained.alias("extra_hits"), price.alias("cost_per_extra_hit"),
        )

    bands = F.array(
        band(low, mid, tp_mid - hits(low)), band(mid, high, hits(high) - tp_mid)
    )
    return kpi.filter("scope = 'overall'").select(F.inline(bands))


def scenario_kpi(kpi: DataFrame, cfg: TriageConfig = TriageConfig()) -> DataFrame:
    """Detection rate and precision at the operating depth per scenario."""
    column = f"precision_at_{cfg.operating_k}"
    return kpi.filter("scope <> 'overall'").select("scope", "detection_rate", column)


def evaluation_accounts(tx: DataFrame, cuts: CutPoints) -> DataFrame:
    """Flagged accounts in the evaluation window (day2, last]."""
    return flagged_accounts(tx, cuts.day2, cuts.last)


def check_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts with their day; no alerts or an alert without a day stops the job."""
    staged = with_alert_day(alerts)
    row = staged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("alert_day").isNull()).alias("bad")
    ).first()
    if row["n"] == 0:
        raise DataQualityError("the alert table is empty; nothing to triage")
    if row["bad"]:
        raise DataQualityError(f"{row['bad']} alert(s) carry no parsable window day")
    return staged
