"""Data-quality gates as report rows over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.inputs import SPLIT
from tidewatch.catalog.registry import query
from tidewatch.operators import accounts, alerts, gates, graph, rules, triage
from tidewatch.sources.adapters import NODE_FEATURES, graph_vectors, table
from tidewatch.sources.files import union_all


def report(rule: str, expected: str, actual: str, passed: str, source: str) -> str:
    return f"""SELECT '{rule}' AS rule, CAST({expected} AS VARCHAR) AS expected,
        CAST({actual} AS VARCHAR) AS actual, {passed} AS passed FROM {source}"""


def counted(rule: str, expected: int, test: str, source: str) -> str:
    return report(rule, str(expected), "count(*)", f"count(*) {test} {expected}", source)


PINNED_NODES = 15_000  # a pin that holds at one scale only, so the gate shows both outcomes


@query("g1_gate_exact_count", counted("exact_count", PINNED_NODES, "=", "graph_node"))
def gate_exact_count(spark: SparkSession, folder: str) -> DataFrame:
    return gates.exact_count(inputs.nodes(spark, folder), PINNED_NODES)


@query("g2_gate_min_count", counted("min_count", 5_000, ">=", "bank_tx"))
def gate_min_count(spark: SparkSession, folder: str) -> DataFrame:
    return gates.min_count(inputs.tx(spark, folder), 5_000)


CLASSES = [(1, 5_000), (2, 5_000), (None, 5_088)]


@query(
    "g3_gate_class_distribution",
    """SELECT 'class_count:' || COALESCE(CAST(w AS VARCHAR), 'unknown') AS rule, CAST(expected AS VARCHAR) AS expected,
       COALESCE(CAST(n AS VARCHAR), 'missing') AS actual, COALESCE(n = expected, false) AS passed
       FROM (VALUES """ + ", ".join(f"({'NULL' if c is None else c}, {n})" for c, n in CLASSES) + """) e(w, expected)
       LEFT JOIN (SELECT label, count(*) AS n FROM graph_node GROUP BY 1) g ON w IS NOT DISTINCT FROM label""",
)
def gate_class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return gates.class_distribution(inputs.nodes(spark, folder), "label", CLASSES)


@query(
    "g4_gate_step_set",
    """SELECT 'step_set' AS rule, '1..50' AS expected,
       'missing=' || count(*) FILTER (WHERE f.step IS NULL) || ';unexpected=' || count(*) FILTER (WHERE w.step IS NULL) AS actual,
       count(*) FILTER (WHERE f.step IS NULL OR w.step IS NULL) = 0 AS passed
       FROM (SELECT range AS step FROM range(1, 51)) w FULL JOIN (SELECT DISTINCT step FROM graph_node) f ON w.step = f.step""",
)
def gate_step_set(spark: SparkSession, folder: str) -> DataFrame:
    """One step more than the data has, so that the difference shows."""
    return gates.step_set(inputs.nodes(spark, folder), "step", 1, 50)


@query("g5_gate_referential", report(
    "referential", "0", "count(*)", "count(*) = 0",
    """(SELECT src AS id FROM graph_edge UNION ALL SELECT dst FROM graph_edge)
       WHERE id NOT IN (SELECT id FROM graph_node WHERE step <= 48)"""))
def gate_referential(spark: SparkSession, folder: str) -> DataFrame:
    """The last step's nodes are held back, so some edge ends are unknown."""
    known = inputs.nodes(spark, folder).filter("step <= 48")
    return gates.referential(known, inputs.edges(spark, folder))


@query(
    "g6_gate_id_sets_equal",
    """SELECT 'id_sets_equal' AS rule, 'only_left=0;only_right=0' AS expected,
       'only_left=' || a || ';only_right=' || b AS actual, a = 0 AND b = 0 AS passed
       FROM (SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS a,
                    (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS b)""",
)
def gate_id_sets_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against the orders that have line items."""
    left = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    right = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    return gates.same_ids(left, right, "id")


@query("g7_gate_distinct_accounts", counted(
    "distinct_accounts", 100, ">=",
    "(SELECT from_bank, from_account FROM bank_tx UNION SELECT to_bank, to_account FROM bank_tx)"))
def gate_distinct_accounts(spark: SparkSession, folder: str) -> DataFrame:
    return gates.distinct_accounts(inputs.tx(spark, folder), 100)


TOLERANCE = 0.05
# (rate, flags): the first pair fits the tables of scale 0.01, the second does not
RATES = ((0.0159, 956), (0.02, 1_176))


def _rate_sql(rate: float, flags: int) -> str:
    low, high = rate * (1 - TOLERANCE), rate * (1 + TOLERANCE)
    return f"""SELECT 'flagged_rate' AS rule, '{low:.6f}..{high:.6f}' AS expected,
        CAST(CAST(round(CAST(hits AS DOUBLE) / n, 6) AS DECIMAL(10,6)) AS VARCHAR) AS actual,
        CAST(hits AS DOUBLE) / n BETWEEN {low!r} AND {high!r} AS passed
        FROM (SELECT sum(is_laundering) AS hits, count(*) AS n FROM bank_tx)
        UNION ALL SELECT 'flagged_count', '{flags}', CAST(sum(is_laundering) AS VARCHAR), sum(is_laundering) = {flags} FROM bank_tx"""


@query("g8_gate_rate_band", " UNION ALL ".join(_rate_sql(*pair) for pair in RATES))
def gate_rate_band(spark: SparkSession, folder: str) -> DataFrame:
    held, missed = (
        gates.rate_band(inputs.tx(spark, folder), "is_laundering", rate, TOLERANCE, flags) for rate, flags in RATES
    )
    return held.unionByName(missed)


@query("g9_gate_scalar_present", """
    SELECT 'scalar_present' AS rule, '1' AS expected, CAST(count(v) AS VARCHAR) AS actual, count(v) = 1 AS passed
    FROM (SELECT count(*) AS v FROM bank_tx)
    UNION ALL SELECT 'scalar_missing', '1', CAST(count(v) AS VARCHAR), count(v) = 1
    FROM (SELECT max(tx_time) AS v FROM bank_tx WHERE tx_time < TIMESTAMP '1990-01-01 00:00:00')""")
def gate_scalar_present(spark: SparkSession, folder: str) -> DataFrame:
    """The number of payments exists; the latest payment before 1990 does not."""
    rows = inputs.tx(spark, folder)
    there = rows.agg(F.count(F.lit(1)).alias("v"))
    absent = rows.filter("tx_time < TIMESTAMP_NTZ '1990-01-01 00:00:00'").agg(F.max("tx_time").alias("v"))
    return union_all([
        gates.scalar_present(there, "scalar_present"), gates.scalar_present(absent, "scalar_missing"),
    ])


_NULLS = " OR ".join(f"{c} IS NULL" for c in graph.FEATURES if c != "louvain_community")


@query(
    "g10_gate_feature_coverage",
    f"""SELECT rule, CAST(expected AS VARCHAR) AS expected, CAST(actual AS VARCHAR) AS actual, expected = actual AS passed FROM (
          SELECT 'coverage_rows' AS rule, (SELECT count(*) FROM graph_node) AS expected, (SELECT count(*) FROM graph_feature) AS actual
          UNION ALL SELECT 'coverage_ids', 0, (SELECT count(*) FROM graph_node n FULL JOIN graph_feature f ON n.id = f.id
                                               WHERE n.id IS NULL OR f.id IS NULL)
          UNION ALL SELECT 'coverage_nulls', 0, (SELECT count(*) FROM graph_feature WHERE {_NULLS}))""",
)
def gate_feature_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return gates.feature_coverage(
        inputs.graph_feature_table(spark, folder), inputs.nodes(spark, folder), graph.FEATURES
    )


@query("g11_gate_dangling_edge", report(
    "dangling_edge", "0", "count(*)", "count(*) = 0",
    "(SELECT src FROM graph_edge UNION ALL SELECT dst FROM graph_edge) e(id) ANTI JOIN graph_node USING (id)"))
def gate_dangling_edge(spark: SparkSession, folder: str) -> DataFrame:
    ends = graph.dangling_ends(inputs.nodes(spark, folder), inputs.edges(spark, folder))
    return gates.no_rows(ends, "dangling_edge")


_BAD = " OR ".join(f"{c} IS NULL OR isnan({c})" for c in NODE_FEATURES)


@query("g12_gate_no_nan", report("no_nan", "0", "count(*)", "count(*) = 0", f"node_vector WHERE {_BAD}"))
def gate_no_nan(spark: SparkSession, folder: str) -> DataFrame:
    return gates.no_nan(graph_vectors(spark, folder), NODE_FEATURES)


@query("g13_gate_nonempty", counted("not_empty", 1, ">=", "(SELECT * FROM all_alerts LIMIT 1)"))
def gate_nonempty(spark: SparkSession, folder: str) -> DataFrame:
    return gates.not_empty(inputs.alert_table(spark, folder))


@query("g14_gate_alert_schema", """
    SELECT 'alert_schema' AS rule, 'details,entity,reason,scenario' AS expected,
           string_agg(name, ',' ORDER BY name) AS actual,
           string_agg(name, ',' ORDER BY name) = 'details,entity,reason,scenario' AS passed
    FROM (SELECT DISTINCT unnest(json_keys(to_json(a))) AS name FROM all_alerts a)""")
def gate_alert_schema(spark: SparkSession, folder: str) -> DataFrame:
    return gates.column_set(inputs.alert_table(spark, folder), rules.ALERT_COLUMNS)


@query("g15_gate_alert_day", report(
    "alert_day", "0", "count(*)", "count(*) = 0", "dated_alerts WHERE alert_day IS NULL"))
def gate_alert_day(spark: SparkSession, folder: str) -> DataFrame:
    dated = triage.with_alert_day(inputs.alert_table(spark, folder))
    return gates.no_rows(dated.filter("alert_day IS NULL"), "alert_day")


def _classes(name: str, snapshot_cut: str, flagged: str) -> str:
    return f"""SELECT '{name}_classes' AS rule, '2' AS expected, CAST(count(DISTINCT f.acct IS NULL) AS VARCHAR) AS actual,
        count(DISTINCT f.acct IS NULL) = 2 AS passed
        FROM (SELECT DISTINCT acct FROM account_line, cut WHERE account_line.day < {snapshot_cut}) s LEFT JOIN {flagged} f ON s.acct = f.acct"""


@query(
    "g16_gate_label_windows",
    "SELECT 'train_window' AS rule, '1' AS expected, CAST(least(1, count(*)) AS VARCHAR) AS actual, count(*) > 0 AS passed FROM flagged_train"
    " UNION ALL SELECT 'test_window', '1', CAST(least(1, count(*)) AS VARCHAR), count(*) > 0 FROM flagged_eval"
    f" UNION ALL {_classes('train', 'day1', 'flagged_train')} UNION ALL {_classes('test', 'day2', 'flagged_eval')}",
)
def gate_label_windows(spark: SparkSession, folder: str) -> DataFrame:
    c = inputs.cuts(spark, folder)
    rows, profile = inputs.tx(spark, folder), inputs.profile(spark, folder)
    parts = []
    for name, start, end in (("train", c.day1, c.day2), ("test", c.day2, c.last)):
        flagged = alerts.flagged_accounts(rows, start, end)
        snap = triage.label_accounts(accounts.snapshot(profile, F.lit(start)).select("acct"), flagged)
        parts += [gates.not_empty(flagged, f"{name}_window"), gates.two_classes(snap, "label", f"{name}_classes")]
    return union_all(parts)


@query("g17_gate_cut_points", report(
    "cut_points", "strftime(last_day, '%Y-%m-%d')", "strftime(day2, '%Y-%m-%d')", "day2 < last_day", "cut"))
def gate_cut_points(spark: SparkSession, folder: str) -> DataFrame:
    return gates.cut_before_last(triage.cut_point_frame(inputs.tx(spark, folder)))


@query(
    "g18_gate_no_lookahead_rows",
    "SELECT 'no_lookahead_rows' AS rule, '<40' AS expected, CAST(max(step) AS VARCHAR) AS actual, max(step) < 40 AS passed FROM graph_node WHERE step < 40"
    " UNION ALL SELECT 'leaky_split', '<40', CAST(max(step) AS VARCHAR), max(step) < 40 FROM graph_node WHERE step <= 40",
)
def gate_no_lookahead_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.nodes(spark, folder)
    return union_all([
        gates.steps_before(rows.filter("step < 40"), "step", 40),
        gates.steps_before(rows.filter("step <= 40"), "step", 40, "leaky_split"),
    ])


@query("g19_gate_no_lookahead_edges", f"""
    SELECT 'no_lookahead_edges' AS rule, '<={SPLIT.train_max}' AS expected, CAST(max(visible_step) AS VARCHAR) AS actual,
           max(visible_step) <= {SPLIT.train_max} AS passed FROM stepped_edge WHERE visible_step <= {SPLIT.train_max}""")
def gate_no_lookahead_edges(spark: SparkSession, folder: str) -> DataFrame:
    return gates.edges_within(inputs.train_edges(spark, folder), SPLIT.train_max)


@query("g20_gate_split_nonempty", f"""
    SELECT 'split' AS rule, 'train>0;test>0' AS expected,
           'train=' || count(*) FILTER (WHERE step <= {SPLIT.train_max}) || ';test=' || count(*) FILTER (WHERE step >= {SPLIT.test_min}) AS actual,
           count(*) FILTER (WHERE step <= {SPLIT.train_max}) > 0 AND count(*) FILTER (WHERE step >= {SPLIT.test_min}) > 0 AS passed
    FROM graph_node""")
def gate_split_nonempty(spark: SparkSession, folder: str) -> DataFrame:
    return gates.split_not_empty(inputs.nodes(spark, folder), "step", SPLIT.train_max, SPLIT.test_min)
