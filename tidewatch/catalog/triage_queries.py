"""Alert statistics, account behaviour, queue and operational figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.inputs import TRIAGE
from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import FEATURE_SQL, day, kpi_sql
from tidewatch.functions.columns import day_text
from tidewatch.functions.cumulative import running_sums
from tidewatch.operators import accounts, alerts, triage


def _flag(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.col("acct").alias("entity"), F.lit(1).alias("_hit"))


# --- filters and projections ---


@query(
    "p4_filter_history",
    "SELECT from_account, to_account, CAST(amount_paid AS DOUBLE) AS amount_paid FROM bank_tx "
    "WHERE tx_time < TIMESTAMP '1996-06-01 00:00:00'",
)
def filter_history(spark: SparkSession, folder: str) -> DataFrame:
    """The bound is compared with the raw timestamp, so the scan can use it."""
    before = F.col("tx_time") < F.lit("1996-06-01 00:00:00").cast("timestamp_ntz")
    return inputs.tx(spark, folder).filter(before).select(
        "from_account", "to_account", F.col("amount_paid").cast("double").alias("amount_paid")
    )


@query("p5_filter_label_window", "SELECT acct FROM flagged_train")
def filter_label_window(spark: SparkSession, folder: str) -> DataFrame:
    c = inputs.cuts(spark, folder)
    return alerts.flagged_accounts(inputs.tx(spark, folder), c.day1, c.day2)


@query(
    "p7_project_legs",
    f"SELECT acct, cpty, {day('day')} AS day, CAST(amt_in AS DOUBLE) AS amt_in, CAST(amt_out AS DOUBLE) AS amt_out FROM account_line",
)
def project_legs(spark: SparkSession, folder: str) -> DataFrame:
    return accounts.account_legs(inputs.tx(spark, folder)).select(
        "acct", "cpty", day_text("tx_time").alias("day"),
        F.col("amt_in").cast("double").alias("amt_in"), F.col("amt_out").cast("double").alias("amt_out"),
    )


# --- joins ---


@query(
    "j6_join_hit_flag",
    """SELECT scenario, entity, CASE WHEN acct IS NULL THEN 0 ELSE 1 END AS hit
       FROM (SELECT DISTINCT scenario, entity FROM all_alerts) LEFT JOIN flagged_ever ON entity = acct""",
)
def join_hit_flag(spark: SparkSession, folder: str) -> DataFrame:
    pairs = inputs.alert_table(spark, folder).select("scenario", "entity").distinct()
    return pairs.join(_flag(inputs.flagged(spark, folder)), "entity", "left").select(
        "scenario", "entity", F.col("_hit").isNotNull().cast("int").alias("hit")
    )


@query("j7_join_totals", "SELECT scenario, alert_count, distinct_entities FROM scenario_stat")
def join_totals(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.scenario_stats(
        inputs.alert_table(spark, folder), inputs.flagged(spark, folder)
    ).select("scenario", "alert_count", "distinct_entities")


@query(
    "j8_join_asof_history",
    f"""SELECT acct, {day('alert_day')} AS day, tx_in_count, tx_out_count, active_day_count FROM alert_feature""",
)
def join_asof_history(spark: SparkSession, folder: str) -> DataFrame:
    asks = triage.with_alert_day(inputs.alert_table(spark, folder)).select(
        F.col("entity").alias("acct"), F.col("alert_day").alias("day")
    )
    # from the payments, not from the stored profile: what is made at its account stays there
    found = accounts.history_features(accounts.daily_profile(inputs.tx(spark, folder), TRIAGE), asks)
    return found.select("acct", day_text("day").alias("day"), "tx_in_count", "tx_out_count", "active_day_count")


@query(
    "j9_join_scores_back",
    f"SELECT scenario, entity, {day('alert_day')} AS alert_day, details, ml_component FROM fused_alert",
)
def join_scores_back(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fused(spark, folder).select(
        "scenario", "entity", day_text("alert_day").alias("alert_day"), "details", "ml_component"
    )


@query("j10_join_rule_weight", "SELECT scenario, entity, details, rule_component FROM fused_alert")
def join_rule_weight(spark: SparkSession, folder: str) -> DataFrame:
    weights = inputs.scenario_stats(spark, folder).select(
        "scenario", F.col("laundering_entity_precision").alias("w")
    )
    return inputs.alert_table(spark, folder).join(F.broadcast(weights), "scenario", "left").select(
        "scenario", "entity", "details", F.coalesce("w", F.lit(0.0)).alias("rule_component")
    )


@query(
    "j14_join_label_membership",
    """SELECT s.acct, CASE WHEN f.acct IS NULL THEN 0 ELSE 1 END AS label
       FROM (SELECT DISTINCT acct FROM account_line, cut WHERE account_line.day < day1) s
       LEFT JOIN flagged_train f ON s.acct = f.acct""",
)
def join_label_membership(spark: SparkSession, folder: str) -> DataFrame:
    c = inputs.cuts(spark, folder)
    snap = accounts.snapshot(inputs.profile(spark, folder), F.lit(c.day1)).select("acct")
    flagged = alerts.flagged_accounts(inputs.tx(spark, folder), c.day1, c.day2)
    return triage.label_accounts(snap, flagged)


@query(
    "j15_join_queue_membership",
    "SELECT rank, entity, CASE WHEN acct IS NULL THEN 0 ELSE 1 END AS hit FROM ranked_alert LEFT JOIN flagged_eval ON entity = acct",
)
def join_queue_membership(spark: SparkSession, folder: str) -> DataFrame:
    hits = _flag(inputs.evaluation_accounts(spark, folder))
    return inputs.queue(spark, folder).join(hits, "entity", "left").select(
        "rank", "entity", F.col("_hit").isNotNull().cast("int").alias("hit")
    )


# --- aggregations ---


@query("a5_agg_filtered", f"SELECT acct, {FEATURE_SQL} FROM account_day GROUP BY acct")
def agg_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """All behaviour features over the whole history."""
    return accounts.snapshot(inputs.profile(spark, folder), F.lit("9999-12-31").cast("date"))


@query(
    "a6_agg_ratio_nullif",
    f"""SELECT acct, CAST(count(*) FILTER (WHERE amt_out < {TRIAGE.reporting_threshold}) AS DOUBLE)
        / NULLIF(count(*), 0) AS share
        FROM account_line WHERE payment_currency = 'US Dollar' AND amt_out > 0 GROUP BY acct""",
)
def agg_ratio_nullif(spark: SparkSession, folder: str) -> DataFrame:
    legs = accounts.account_legs(inputs.tx(spark, folder)).filter(
        (F.col("payment_currency") == TRIAGE.currency) & (F.col("amt_out") > 0)
    )
    small = F.count_if(F.col("amt_out") < F.lit(TRIAGE.reporting_threshold))
    return legs.groupBy("acct").agg(
        F.try_divide(small.cast("double"), F.count(F.lit(1)).cast("double")).alias("share")
    )


@query(
    "a7_agg_any_value",
    "SELECT from_account, any_value(from_bank) AS bank, count(*) AS txs FROM bank_tx GROUP BY 1",
)
def agg_any_value(spark: SparkSession, folder: str) -> DataFrame:
    """The bank depends on the account, so any of its values will do."""
    return inputs.tx(spark, folder).groupBy("from_account").agg(
        F.any_value("from_bank").alias("bank"), F.count(F.lit(1)).alias("txs")
    )


@query("a8_agg_precision", "SELECT scenario, laundering_entity_precision FROM scenario_stat")
def agg_precision(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.scenario_stats(
        inputs.alert_table(spark, folder), inputs.flagged(spark, folder)
    ).select("scenario", "laundering_entity_precision")


@query("a11_agg_distinct_days", "SELECT acct, count(DISTINCT day) AS active_days FROM account_line GROUP BY 1")
def agg_distinct_days(spark: SparkSession, folder: str) -> DataFrame:
    legs = accounts.account_legs(inputs.tx(spark, folder))
    return legs.groupBy("acct").agg(F.count_distinct(F.to_date("tx_time")).alias("active_days"))


@query(
    "a13_agg_universe",
    "SELECT count(*) AS universe FROM (SELECT from_account FROM bank_tx UNION SELECT to_account FROM bank_tx)",
)
def agg_universe(spark: SparkSession, folder: str) -> DataFrame:
    return triage.account_universe(inputs.tx(spark, folder))


@query(
    "a14_agg_bounds",
    f"SELECT {day('min(tx_time)')} AS first, {day('max(tx_time)')} AS last FROM bank_tx",
)
def agg_bounds(spark: SparkSession, folder: str) -> DataFrame:
    bounds = inputs.tx(spark, folder).agg(F.min("tx_time").alias("a"), F.max("tx_time").alias("b"))
    return bounds.select(day_text("a").alias("first"), day_text("b").alias("last"))


# --- windows, order and top-k ---

_QUEUE_ROW = f"rank, scenario, entity, {day('alert_day')} AS alert_day, details"


@query("w2_window_rank", f"SELECT {_QUEUE_ROW} FROM ranked_alert")
def window_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranked = triage.ranked_queue(inputs.fused(spark, folder, True))
    return ranked.select("rank", "scenario", "entity", day_text("alert_day").alias("alert_day"), "details")


@query(
    "w3_window_dedup_first",
    f"SELECT entity, {day('alert_day')} AS alert_day, scenario, details, fused_score FROM best_alert",
)
def window_dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    best = triage.one_per_entity_day(inputs.fused(spark, folder, True))
    return best.select("entity", day_text("alert_day").alias("alert_day"), "scenario", "details", "fused_score")


@query(
    "w4_window_cum_hits",
    """SELECT rank, hit, CAST(sum(hit) OVER (ORDER BY rank) AS BIGINT) AS hits_so_far
       FROM (SELECT rank, CASE WHEN acct IS NULL THEN 0 ELSE 1 END AS hit
             FROM ranked_alert LEFT JOIN flagged_eval ON entity = acct)""",
)
def window_cum_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = _flag(inputs.evaluation_accounts(spark, folder))
    marked = inputs.queue(spark, folder).join(hits, "entity", "left").select(
        "rank", F.col("_hit").isNotNull().cast("int").alias("hit")
    )
    return running_sums(marked, ["rank"], {"hits_so_far": F.col("hit").cast("bigint")})


@query(
    "t1_sort_queue",
    f"SELECT entity, {day('alert_day')} AS alert_day, scenario, fused_score, ml_component FROM best_alert",
)
def sort_queue(spark: SparkSession, folder: str) -> DataFrame:
    best = triage.one_per_entity_day(inputs.fused(spark, folder)).orderBy(*triage.queue_order())
    return best.select(
        "entity", day_text("alert_day").alias("alert_day"), "scenario", "fused_score", "ml_component"
    )


@query(
    "t2_topk_operating_point",
    f"SELECT scope, place, entity FROM scoped_alert WHERE place <= {TRIAGE.operating_k}",
)
def topk_operating_point(spark: SparkSession, folder: str) -> DataFrame:
    scopes = F.array(
        F.struct(F.lit("overall").alias("scope"), F.col("rank").alias("place")),
        F.struct(F.col("scenario").alias("scope"), F.col("scenario_rank").alias("place")),
    )
    placed = inputs.queue(spark, folder).select("entity", F.inline(scopes))
    return placed.filter(F.col("place") <= TRIAGE.operating_k).select("scope", "place", "entity")


@query(
    "t3_topk_precision",
    "SELECT scope, " + ", ".join(f"precision_at_{k}" for k in TRIAGE.precision_ks) + " FROM kpi_row",
)
def topk_precision(spark: SparkSession, folder: str) -> DataFrame:
    return triage_kpi(spark, folder).select("scope", *[f"precision_at_{k}" for k in TRIAGE.precision_ks])


@query(
    "u5_intersect_count",
    """SELECT scenario, count(DISTINCT entity) AS hits FROM all_alerts
       WHERE entity IN (SELECT acct FROM flagged_ever) GROUP BY 1""",
)
def intersect_count(spark: SparkSession, folder: str) -> DataFrame:
    hits = inputs.alert_table(spark, folder).join(
        _flag(inputs.flagged(spark, folder)), "entity", "left_semi"
    )
    return hits.groupBy("scenario").agg(F.count_distinct("entity").alias("hits"))


@query(
    "f6_weighted_fusion",
    "SELECT scenario, entity, details, rule_component, ml_component, fused_score FROM fused_alert",
)
def weighted_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fused(spark, folder).select(
        "scenario", "entity", "details", "rule_component", "ml_component", "fused_score"
    )


# --- stages ---


@query("k1_alert_scenario_stats", "SELECT * FROM scenario_stat")
def alert_scenario_stats(spark: SparkSession, folder: str) -> DataFrame:
    return alerts.scenario_stats(inputs.alert_table(spark, folder), inputs.flagged(spark, folder))


@query(
    "k2_triage_cut_points",
    f"""SELECT {day('first_day')} AS first, {day('last_day')} AS last, {day('day1')} AS day1,
        {day('day2')} AS day2 FROM cut""",
)
def triage_cut_points(spark: SparkSession, folder: str) -> DataFrame:
    frame = triage.cut_point_frame(inputs.tx(spark, folder), TRIAGE)
    return frame.select(*[day_text(c).alias(c) for c in ("first", "last", "day1", "day2")])


@query("k3_account_snapshot", f"SELECT acct, {FEATURE_SQL} FROM account_day, cut WHERE account_day.day < day1 GROUP BY acct")
def account_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A single snapshot filters the payments first; the bound reaches the scan."""
    c = inputs.cuts(spark, folder)
    before = F.col("tx_time") < F.lit(str(c.day1)).cast("timestamp_ntz")
    profile = accounts.daily_profile(inputs.tx(spark, folder).filter(before), TRIAGE)
    return accounts.snapshot(profile, F.lit(c.day1))


@query("k4_laundering_accounts", "SELECT acct FROM flagged_eval")
def laundering_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return triage.evaluation_accounts(inputs.tx(spark, folder), inputs.cuts(spark, folder))


@query(
    "k6_alert_history_features",
    f"SELECT * EXCLUDE (alert_day), {day('alert_day')} AS day FROM alert_feature",
)
def alert_history_features(spark: SparkSession, folder: str) -> DataFrame:
    profile = accounts.daily_profile(inputs.tx(spark, folder), TRIAGE)
    asks = triage.with_alert_day(inputs.alert_table(spark, folder)).select(
        F.col("entity").alias("acct"), F.col("alert_day").alias("day")
    )
    return accounts.history_features(profile, asks).withColumn("day", day_text("day"))


@query(
    "k7_alert_fusion",
    f"SELECT scenario, entity, {day('alert_day')} AS alert_day, details, rule_component, ml_component, fused_score FROM fused_alert",
)
def alert_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.fused(spark, folder).select(
        "scenario", "entity", day_text("alert_day").alias("alert_day"), "details",
        "rule_component", "ml_component", "fused_score",
    )


@query(
    "k8_alert_queue",
    f"""SELECT rank, scenario, entity, {day('alert_day')} AS alert_day, rule_component, ml_component,
        fused_score, reason, details FROM ranked_alert""",
)
def alert_queue(spark: SparkSession, folder: str) -> DataFrame:
    return triage.alert_queue(inputs.fused(spark, folder, True)).withColumn("alert_day", day_text("alert_day"))


@query("k9_triage_kpi", "SELECT * FROM kpi_row")
def triage_kpi(spark: SparkSession, folder: str) -> DataFrame:
    return triage.triage_kpi(
        inputs.queue(spark, folder), inputs.evaluation_accounts(spark, folder),
        inputs.meta(spark, folder), TRIAGE,
    )


@query(
    "k10_triage_meta",
    f"SELECT {day('day1')} AS day1, {day('day2')} AS day2, universe, days_eval FROM meta_row",
)
def triage_meta(spark: SparkSession, folder: str) -> DataFrame:
    frame = triage.triage_meta(inputs.tx(spark, folder), TRIAGE)
    return frame.withColumns({"day1": day_text("day1"), "day2": day_text("day2")})


_DEPTHS = ", ".join(f"({d})" for d in TRIAGE.curve_depths)


@query(
    "k11_precision_curve",
    f"""SELECT k, CAST(hits AS DOUBLE) / k AS precision, CAST(hits AS BIGINT) AS true_positives,
        CAST(k AS DOUBLE) * {TRIAGE.cost_per_case} / NULLIF(hits, 0) AS cost_per_true_positive
        FROM (SELECT rank AS k, sum(CASE WHEN acct IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS hits
              FROM ranked_alert LEFT JOIN flagged_eval ON entity = acct)
        WHERE k IN (SELECT * FROM (VALUES {_DEPTHS})) OR k = (SELECT max(rank) FROM ranked_alert)""",
)
def precision_curve(spark: SparkSession, folder: str) -> DataFrame:
    return triage.precision_curve(
        inputs.queue(spark, folder), inputs.evaluation_accounts(spark, folder), TRIAGE
    )


_KS = TRIAGE.precision_ks


@query(
    "k12_marginal_cost",
    f"""SELECT from_depth, to_depth, extra_hits,
        CASE WHEN extra_hits > 0 THEN (to_depth - from_depth) * {TRIAGE.cost_per_case} / CAST(extra_hits AS DOUBLE) END
          AS cost_per_extra_hit
        FROM (SELECT {_KS[0]} AS from_depth, {TRIAGE.operating_k} AS to_depth,
                     CAST(true_positives - round(precision_at_{_KS[0]} * {_KS[0]}, 0) AS BIGINT) AS extra_hits
              FROM kpi_row WHERE scope = 'overall'
              UNION ALL SELECT {TRIAGE.operating_k}, {_KS[-1]},
                     CAST(round(precision_at_{_KS[-1]} * {_KS[-1]}, 0) - true_positives AS BIGINT)
              FROM kpi_row WHERE scope = 'overall')""",
)
def marginal_cost(spark: SparkSession, folder: str) -> DataFrame:
    return triage.marginal_cost(triage_kpi(spark, folder), TRIAGE)


@query("k13_operating_point_whatif", f"SELECT * FROM ({kpi_sql(250, 120.0)}) WHERE scope = 'fan-out'")
def operating_point_whatif(spark: SparkSession, folder: str) -> DataFrame:
    return triage.what_if(
        inputs.queue(spark, folder), inputs.evaluation_accounts(spark, folder),
        inputs.meta(spark, folder), "fan-out", 250, 120.0, TRIAGE,
    )


@query(
    "k14_scenario_kpi_table",
    f"SELECT scope, detection_rate, precision_at_{TRIAGE.operating_k} FROM kpi_row WHERE scope <> 'overall'",
)
def scenario_kpi_table(spark: SparkSession, folder: str) -> DataFrame:
    return triage.scenario_kpi(triage_kpi(spark, folder), TRIAGE)
