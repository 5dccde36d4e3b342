"""Scenario rules and the joins and aggregates they are made of."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.inputs import RULES
from tidewatch.catalog.registry import query
from tidewatch.catalog.sql import SCENARIO_CTES, day
from tidewatch.functions.columns import alert_day, day_text, period_start
from tidewatch.operators import community, cycles, rules
from tidewatch.sources.files import union_all

NAMES = {
    "structuring": "r1_rule_structuring",
    "velocity": "r2_rule_velocity",
    "rapid-churn": "r3_rule_rapid_churn",
    "fan-in": "r4_rule_fan_in",
    "fan-out": "r5_rule_fan_out",
    "circular-flow": "r6_rule_circular_flow",
    "dense-community": "r7_rule_dense_community",
}


def _register(scenario: str, name: str) -> None:
    @query(name, f"SELECT * FROM {SCENARIO_CTES[scenario]}")
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return rules.SCENARIOS[scenario](inputs.tx(spark, folder), RULES)


for _scenario, _name in NAMES.items():
    _register(_scenario, _name)


@query("r8_rule_all", "SELECT * FROM all_alerts")
def rule_all(spark: SparkSession, folder: str) -> DataFrame:
    return rules.all_scenarios(inputs.tx(spark, folder), RULES)


@query("s13_scenario_union_sink", "SELECT scenario, count(*) AS alerts FROM all_alerts GROUP BY 1")
def scenario_union_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per scenario of the written alert table."""
    return inputs.alert_table(spark, folder).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("alerts")
    )


def _usd(spark: SparkSession, folder: str) -> DataFrame:
    stamped = rules.with_period(inputs.tx(spark, folder), RULES)
    return stamped.filter(rules.in_currency(RULES))


def _legs(spark: SparkSession, folder: str) -> DataFrame:
    return _usd(spark, folder).filter(F.col("amount_paid") >= F.lit(RULES.cycle_min_leg))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cycles.transfer_pairs(_legs(spark, folder).withColumn("amt", F.col("amount_paid")))


def _contact_edges(spark: SparkSession, folder: str) -> DataFrame:
    stamped = inputs.tx(spark, folder).withColumn("period", period_start("tx_time", RULES.window))
    return community.undirected_edges(stamped)


# --- filters and projections ---


@query(
    "p1_filter_usd",
    "SELECT from_account, to_account, CAST(amount_paid AS DOUBLE) AS amount_paid FROM usd_tx",
)
def filter_usd(spark: SparkSession, folder: str) -> DataFrame:
    return _usd(spark, folder).select(
        "from_account", "to_account", F.col("amount_paid").cast("double").alias("amount_paid")
    )


@query(
    "p2_filter_band",
    f"""SELECT from_account, to_account, CAST(amount_paid AS DOUBLE) AS amount_paid FROM usd_tx
        WHERE amount_paid >= {RULES.structuring_floor} AND amount_paid < {RULES.reporting_threshold}""",
)
def filter_band(spark: SparkSession, folder: str) -> DataFrame:
    band = _usd(spark, folder).filter(rules.in_band(F.col("amount_paid"), RULES))
    return band.select(
        "from_account", "to_account", F.col("amount_paid").cast("double").alias("amount_paid")
    )


@query(
    "p3_filter_min_leg",
    f"""SELECT from_account, to_account, CAST(amount_paid AS DOUBLE) AS amount_paid FROM usd_tx
        WHERE amount_paid >= {RULES.cycle_min_leg}""",
)
def filter_min_leg(spark: SparkSession, folder: str) -> DataFrame:
    return _legs(spark, folder).select(
        "from_account", "to_account", F.col("amount_paid").cast("double").alias("amount_paid")
    )


@query(
    "p9_filter_scope",
    "SELECT scenario, entity, details FROM all_alerts WHERE scenario = 'fan-in'",
)
def filter_scope(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.alert_table(spark, folder).filter("scenario = 'fan-in'").select(
        "scenario", "entity", "details"
    )


@query("p10_project_alert_day", f"SELECT scenario, entity, {day('alert_day')} AS alert_day FROM dated_alerts")
def project_alert_day(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.alert_table(spark, folder).select(
        "scenario", "entity", day_text(alert_day("details")).alias("alert_day")
    )


# --- joins ---


@query(
    "j1_join_inflow_outflow",
    f"""SELECT entity, {day('period')} AS period, CAST(received AS DOUBLE) AS received,
        {day('first_in')} AS first_in, CAST(paid_out AS DOUBLE) AS paid_out FROM churn_flow""",
)
def join_inflow_outflow(spark: SparkSession, folder: str) -> DataFrame:
    flow = rules.pass_through(inputs.tx(spark, folder), RULES)
    return flow.filter("received IS NOT NULL AND paid_out IS NOT NULL").select(
        "entity", day_text("period").alias("period"), F.col("received").cast("double").alias("received"),
        day_text("first_in").alias("first_in"), F.col("paid_out").cast("double").alias("paid_out"),
    )


def _cycle_rows(df: DataFrame) -> DataFrame:
    return df.select(
        day_text("period").alias("period"), "entity", "path",
        F.col("amt_out").cast("double").alias("amt_out"),
        F.col("amt_back").cast("double").alias("amt_back"), "cycle_len",
    )


_CYCLE_SQL = f"""SELECT {day('period')} AS period, entity, path, CAST(amt_out AS DOUBLE) AS amt_out,
                CAST(amt_back AS DOUBLE) AS amt_back, cycle_len FROM """


@query("j2_join_two_cycle", _CYCLE_SQL + "cycle_two")
def join_two_cycle(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle_rows(cycles.find_cycles(_pairs(spark, folder), replace(RULES, cycle_lengths=(2,))))


@query("j3_join_three_cycle", _CYCLE_SQL + "cycle_three")
def join_three_cycle(spark: SparkSession, folder: str) -> DataFrame:
    return _cycle_rows(cycles.find_cycles(_pairs(spark, folder), replace(RULES, cycle_lengths=(3,))))


HUB_LIMIT = 10  # low enough that the given tables have hubs


@query(
    "j4_join_hub_filter",
    f"""SELECT {day('e.period')} AS period, e.acct, e.cpty FROM contact_edge e
        JOIN (SELECT period, cpty, count(*) AS n FROM contact_edge GROUP BY 1, 2) g
          ON e.period = g.period AND e.cpty = g.cpty WHERE g.n <= {HUB_LIMIT}""",
)
def join_hub_filter(spark: SparkSession, folder: str) -> DataFrame:
    light = community.without_hubs(_contact_edges(spark, folder), HUB_LIMIT)
    return light.select(day_text("period").alias("period"), "acct", "cpty")


@query(
    "j5_join_shared_counterparty",
    f"SELECT {day('period')} AS period, acct, other, shared FROM shared_pair WHERE shared >= 4",
)
def join_shared_counterparty(spark: SparkSession, folder: str) -> DataFrame:
    pairs = community.dense_pairs(_contact_edges(spark, folder), 4, RULES.community_max_hub_degree)
    return pairs.select(day_text("period").alias("period"), "acct", "other", "shared")


# --- aggregations ---


@query(
    "a1_agg_count_having",
    f"""SELECT from_account AS entity, {day('period')} AS period, count(*) AS txs FROM period_tx
        GROUP BY from_account, period_tx.period HAVING count(*) >= {RULES.velocity_min_txs}""",
)
def agg_count_having(spark: SparkSession, folder: str) -> DataFrame:
    stamped = inputs.tx(spark, folder).withColumn("period", period_start("tx_time", RULES.window))
    return (
        stamped.groupBy(F.col("from_account").alias("entity"), "period")
        .agg(F.count(F.lit(1)).alias("txs"))
        .filter(F.col("txs") >= RULES.velocity_min_txs)
        .select("entity", day_text("period").alias("period"), "txs")
    )


@query(
    "a2_agg_count_distinct",
    f"""SELECT to_account AS entity, {day('period')} AS period, count(DISTINCT from_account) AS counterparties
        FROM usd_tx GROUP BY to_account, usd_tx.period""",
)
def agg_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _usd(spark, folder).groupBy(F.col("to_account").alias("entity"), "period")
        .agg(F.count_distinct("from_account").alias("counterparties"))
        .select("entity", day_text("period").alias("period"), "counterparties")
    )


@query(
    "a3_agg_sum_min",
    f"""SELECT to_account AS entity, {day('period')} AS period, CAST(sum(amount_received) AS DOUBLE) AS received,
        {day('min(tx_time)')} AS first_in FROM usd_tx GROUP BY to_account, usd_tx.period""",
)
def agg_sum_min(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _usd(spark, folder).groupBy(F.col("to_account").alias("entity"), "period")
        .agg(F.sum("amount_received").cast("double").alias("received"), F.min("tx_time").alias("first_in"))
        .select("entity", day_text("period").alias("period"), "received", day_text("first_in").alias("first_in"))
    )


@query(
    "a4_agg_edge_rollup",
    f"""SELECT {day('period')} AS period, from_bank, from_account, to_bank, to_account,
        CAST(sum(amount_paid) AS DOUBLE) AS amt, count(*) AS txs
        FROM usd_tx WHERE amount_paid >= {RULES.cycle_min_leg}
        GROUP BY usd_tx.period, from_bank, from_account, to_bank, to_account""",
)
def agg_edge_rollup(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["from_bank", "from_account", "to_bank", "to_account"]
    return (
        _legs(spark, folder).groupBy("period", *keys)
        .agg(F.sum("amount_paid").cast("double").alias("amt"), F.count(F.lit(1)).alias("txs"))
        .select(day_text("period").alias("period"), *keys, "amt", "txs")
    )


# --- windows ---


@query(
    "w1_window_tumbling_day",
    """SELECT unit, strftime(start, '%Y-%m-%d') AS start, count(*) AS txs FROM (
         SELECT 'day' AS unit, date_trunc('day', tx_time) AS start FROM bank_tx
         UNION ALL SELECT 'week', date_trunc('week', tx_time) FROM bank_tx
         UNION ALL SELECT 'month', date_trunc('month', tx_time) FROM bank_tx)
       GROUP BY unit, start""",
)
def window_tumbling_day(spark: SparkSession, folder: str) -> DataFrame:
    units = F.array(*[
        F.struct(F.lit(u).alias("unit"), period_start("tx_time", u).alias("at"))
        for u in ("day", "week", "month")
    ])
    return (
        inputs.tx(spark, folder).select(F.inline(units)).groupBy("unit", "at")
        .agg(F.count(F.lit(1)).alias("txs"))
        .select("unit", day_text("at").alias("start"), "txs")
    )


# --- set operations ---


@query(
    "u1_union_all",
    """SELECT cycle_len, count(*) AS cycles FROM (SELECT cycle_len FROM cycle_two
       UNION ALL SELECT cycle_len FROM cycle_three) GROUP BY 1""",
)
def union_all_cycles(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    found = union_all([
        cycles.find_cycles(pairs, replace(RULES, cycle_lengths=(n,))) for n in RULES.cycle_lengths
    ])
    return found.groupBy("cycle_len").agg(F.count(F.lit(1)).alias("cycles"))


@query("u2_union_distinct", f"SELECT {day('period')} AS period, acct, cpty FROM contact_edge")
def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return _contact_edges(spark, folder).select(day_text("period").alias("period"), "acct", "cpty")


@query(
    "u3_except_distinct",
    f"""SELECT side, {day('period')} AS period, account FROM (
         SELECT 'no inflow' AS side, * FROM (SELECT period, from_account AS account FROM period_tx
                                             EXCEPT SELECT period, to_account FROM period_tx)
         UNION ALL SELECT 'no outflow', * FROM (SELECT period, to_account FROM period_tx
                                                EXCEPT SELECT period, from_account FROM period_tx))""",
)
def except_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts that are on one side only of a period's payments."""
    stamped = rules.with_period(inputs.tx(spark, folder), RULES)
    period = day_text("period").alias("period")
    senders = stamped.select(period, F.col("from_account").alias("account"))
    receivers = stamped.select(period, F.col("to_account").alias("account"))
    return (
        senders.subtract(receivers).withColumn("side", F.lit("no inflow"))
        .unionByName(receivers.subtract(senders).withColumn("side", F.lit("no outflow")))
    )


@query("u4_select_distinct", "SELECT DISTINCT scenario, entity FROM all_alerts")
def select_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.alert_table(spark, folder).select("scenario", "entity").distinct()


# --- scalar functions ---


@query(
    "f1_string",
    """SELECT 'account=' || from_account || ';bank=' || from_bank || ';line=' || CAST(is_laundering AS VARCHAR) AS text,
       regexp_extract(from_account, '([0-9]+)$', 1) AS digits, count(*) AS n FROM bank_tx GROUP BY 1, 2""",
)
def string_functions(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(
        F.lit("account="), "from_account", F.lit(";bank="), "from_bank", F.lit(";line="),
        F.col("is_laundering").cast("string"),
    )
    digits = F.regexp_extract("from_account", "([0-9]+)$", 1)
    return inputs.tx(spark, folder).groupBy(text.alias("text"), digits.alias("digits")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f2_date",
    """SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d + 30, '%Y-%m-%d') AS later,
       date_diff('day', DATE '1995-01-01', d) AS age,
       strftime(strptime(strftime(d, '%Y/%m/%d') || ' 09:30', '%Y/%m/%d %H:%M'), '%Y-%m-%d %H:%M') AS opened,
       count(*) AS n
       FROM (SELECT CAST(tx_time AS DATE) AS d FROM bank_tx) GROUP BY ALL""",
)
def date_functions(spark: SparkSession, folder: str) -> DataFrame:
    days = inputs.tx(spark, folder).select(F.to_date("tx_time").alias("d"))
    opened = F.to_timestamp_ntz(
        F.concat(F.date_format("d", "yyyy/MM/dd"), F.lit(" 09:30")), F.lit("yyyy/MM/dd HH:mm")
    )
    counted = days.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        day_text("d").alias("day"), day_text(F.date_add("d", 30)).alias("later"),
        F.datediff("d", F.lit("1995-01-01").cast("date")).cast("bigint").alias("age"),
        F.date_format(opened, "yyyy-MM-dd HH:mm").alias("opened"), "n",
    )


@query(
    "f3_math",
    f"""SELECT entity, {day('period')} AS period, round(100 * r, 1) AS pct, round(abs(ln(greatest(r, 0.000001))), 6) AS log_ratio,
        r BETWEEN 0.9 AND 1.1 AS close
        FROM (SELECT entity, period, CAST(paid_out AS DOUBLE) / CAST(received AS DOUBLE) AS r FROM churn_flow)""",
)
def math_functions(spark: SparkSession, folder: str) -> DataFrame:
    flow = rules.pass_through(inputs.tx(spark, folder), RULES)
    r = F.col("paid_out").cast("double") / F.col("received").cast("double")
    return flow.filter("received IS NOT NULL AND paid_out IS NOT NULL").select(
        "entity", day_text("period").alias("period"),
        F.round(100 * r, 1).alias("pct"),
        F.round(F.abs(F.ln(F.greatest(r, F.lit(0.000001)))), 6).alias("log_ratio"),
        r.between(0.9, 1.1).alias("close"),
    )


@query(
    "f4_conditional",
    """SELECT from_account, payment_format,
       CASE WHEN sum(is_laundering) > 0 THEN 'flagged' ELSE 'plain' END AS kind,
       COALESCE(CAST(count(*) FILTER (WHERE payment_currency = 'Euro') AS DOUBLE)
         / NULLIF(count(*) FILTER (WHERE payment_currency = 'US Dollar'), 0), 0.0) AS euro_per_usd,
       COALESCE(TRY_CAST(substr(payment_format, 1, 1) AS INT), -1) AS priority
       FROM bank_tx GROUP BY from_account, payment_format""",
)
def conditional_functions(spark: SparkSession, folder: str) -> DataFrame:
    euro = F.count_if(F.col("payment_currency") == "Euro").cast("double")
    usd = F.count_if(F.col("payment_currency") == "US Dollar")
    return inputs.tx(spark, folder).groupBy("from_account", "payment_format").agg(
        F.when(F.sum("is_laundering") > 0, "flagged").otherwise("plain").alias("kind"),
        F.coalesce(F.try_divide(euro, F.nullif(usd, F.lit(0))), F.lit(0.0)).alias("euro_per_usd"),
        F.coalesce(F.substring(F.col("payment_format"), 1, 1).try_cast("int"), F.lit(-1)).alias("priority"),
    )


@query(
    "f5_canonical_path",
    f"SELECT {day('period')} AS period, path, cycle_len FROM (SELECT * FROM cycle_two UNION ALL SELECT * FROM cycle_three)",
)
def canonical_path(spark: SparkSession, folder: str) -> DataFrame:
    found = cycles.find_cycles(_pairs(spark, folder), RULES)
    return found.select(day_text("period").alias("period"), "path", "cycle_len")
