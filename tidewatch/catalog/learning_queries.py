"""Model matrix, fits, evaluation, drift and attribution.

Fits run over all rows of the order graph. Baselines and the tuning of the grid run at full
size; the other boosted trees are fewer than the default (``MODELS``), as every tree is some
rounds of Spark jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.catalog.inputs import SPLIT, TRIAGE
from tidewatch.catalog.registry import cte, query
from tidewatch.config import DriftConfig, ModelConfig, RuleConfig, fingerprint
from tidewatch.functions.sampling import seeded_sample
from tidewatch.learning import attribution, matrix, runs, sage, training
from tidewatch.operators import drift, gates, graph, metrics
from tidewatch.plans.alerting import account_model
from tidewatch.session import materialize, scratch_path, spread
from tidewatch.sources.adapters import NODE_FEATURES, graph_vectors
from tidewatch.sources.files import union_all

MODELS = replace(ModelConfig(), boosted_trees=25, patience=10)
DRIFT = DriftConfig()
GRAPH_COLUMNS = [c for c in graph.FEATURES]
ALL_COLUMNS = [*NODE_FEATURES, *GRAPH_COLUMNS]


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.stage(
        spark, folder, "model-matrix",
        lambda: matrix.model_matrix(
            inputs.nodes(spark, folder), graph_vectors(spark, folder),
            inputs.graph_feature_table(spark, folder),
        ),
    )


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.stage(
        spark, folder, "model-vectors",
        lambda: spread(matrix.assemble(_matrix(spark, folder), ALL_COLUMNS, training.KEEP), "id"),
    )


# --- matrix and splits ---

_RAW = ", ".join(NODE_FEATURES)


@query(
    "j11_join_model_matrix",
    f"""SELECT n.id, n.step, CASE WHEN n.label = 1 THEN 1 ELSE 0 END AS y, {_RAW}
        FROM graph_node n JOIN node_vector v ON n.id = v.id WHERE n.label IS NOT NULL""",
)
def join_model_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.model_matrix(inputs.nodes(spark, folder), graph_vectors(spark, folder))


@query(
    "m19_model_matrix",
    f"""SELECT n.id, n.step, CASE WHEN n.label = 1 THEN 1 ELSE 0 END AS y, {_RAW}, in_degree, out_degree,
        reciprocity, ego_illicit_1hop, ego_illicit_2hop, time_since_activity
        FROM graph_node n JOIN node_vector v ON n.id = v.id JOIN graph_feature g ON n.id = g.id
        WHERE n.label IS NOT NULL""",
)
def model_matrix(spark: SparkSession, folder: str) -> DataFrame:
    built = matrix.model_matrix(
        inputs.nodes(spark, folder), graph_vectors(spark, folder),
        inputs.graph_feature_table(spark, folder),
    )
    return built.drop("louvain_community")


@query(
    "m1_temporal_split",
    f"""SELECT protocol, side, count(*) AS n FROM (
          SELECT 'test' AS protocol, CASE WHEN step <= {SPLIT.train_max} THEN 'train'
                 WHEN step >= {SPLIT.test_min} THEN 'test' END AS side FROM graph_node WHERE label IS NOT NULL
          UNION ALL
          SELECT 'tuning', CASE WHEN step <= {SPLIT.tuning_train_max} THEN 'train'
                 WHEN step BETWEEN {SPLIT.tuning_val_min} AND {SPLIT.tuning_val_max} THEN 'validation' END
          FROM graph_node WHERE label IS NOT NULL)
        WHERE side IS NOT NULL GROUP BY 1, 2""",
)
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = matrix.labelled(inputs.nodes(spark, folder))
    parts = [
        matrix.with_side(rows, SPLIT, p).filter("side IS NOT NULL")
        .groupBy(F.lit(p).alias("protocol"), "side").agg(F.count(F.lit(1)).alias("n"))
        for p in ("test", "tuning")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "m4_class_weights",
    f"""SELECT y, count(*) AS n, CAST((SELECT count(*) FROM graph_node WHERE label IS NOT NULL AND step <= {SPLIT.train_max}) AS DOUBLE)
          / (2 * count(*)) AS weight
        FROM (SELECT CASE WHEN label = 1 THEN 1 ELSE 0 END AS y FROM graph_node
              WHERE label IS NOT NULL AND step <= {SPLIT.train_max}) GROUP BY 1""",
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = matrix.labelled(inputs.nodes(spark, folder)).filter(F.col("step") <= SPLIT.train_max)
    return matrix.class_weights(rows.select(matrix.binary_label("label").alias("y")))


# --- evaluation on a plain score ---


def _plain_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores of every labelled node of the test period for three seeds. They
    are plain arithmetic on the node, so SQL can check the evaluation."""
    rows = matrix.labelled(inputs.nodes(spark, folder)).filter(F.col("step") >= SPLIT.test_min)
    seeds = F.array(*[F.lit(s).cast("bigint") for s in MODELS.seeds])
    y = matrix.binary_label("label")
    noise = (F.col("id") * F.col("seed") % 1009).cast("double")
    both = F.array(
        F.struct(F.lit("plain").alias("model"), (noise / 1009.0).alias("score")),
        F.struct(F.lit("informed").alias("model"), ((noise + 250.0 * F.col("label")) / 2018.0).alias("score")),
    )
    return (
        rows.select("id", "step", y.alias("label"), F.explode(seeds).alias("seed"))
        .select("id", "step", "seed", "label", F.inline(both))
    )


_SEEDS = ", ".join(f"({s})" for s in MODELS.seeds)
cte("plain_score", f"""
    SELECT id, step, seed, y AS label, model, CASE model WHEN 'plain' THEN noise / 1009.0
           ELSE (noise + 250.0 * y) / 2018.0 END AS score
    FROM (SELECT id, step, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, s.seed,
                 CAST(id * s.seed % 1009 AS DOUBLE) AS noise
          FROM graph_node CROSS JOIN (VALUES {_SEEDS}) s(seed)
          WHERE label IS NOT NULL AND step >= {SPLIT.test_min})
    CROSS JOIN (VALUES ('plain'), ('informed')) m(model)""")
cte("score_group", """
    SELECT model, seed, score, sum(label) AS pos, count(*) AS n FROM plain_score GROUP BY 1, 2, 3""")
cte("score_run", """
    SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen,
           sum(pos) OVER (PARTITION BY model, seed) AS p, sum(n) OVER (PARTITION BY model, seed) AS total
    FROM score_group WINDOW w AS (PARTITION BY model, seed ORDER BY score DESC)""")
cte("score_metric", """
    SELECT model, seed, CAST(any_value(total) AS BIGINT) AS rows, CAST(any_value(p) AS BIGINT) AS positives,
           sum(CAST(pos AS DOUBLE) / p * tp / seen) AS pr_auc,
           sum(CAST((n - pos) * (2 * (tp - pos) + pos) AS DOUBLE)) / (2.0 * any_value(p) * (any_value(total) - any_value(p))) AS roc_auc
    FROM score_run GROUP BY 1, 2""")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.rank_metrics(_plain_scores(spark, folder), ["model", "seed"])


@query(
    "m9_rank_metrics",
    "SELECT model, seed, rows, positives, round(pr_auc, 9) AS pr_auc, round(roc_auc, 9) AS roc_auc FROM score_metric",
)
def rank_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).withColumns(
        {"pr_auc": F.round("pr_auc", 9), "roc_auc": F.round("roc_auc", 9)}
    )


@query(
    "a12_agg_seed_stats",
    """SELECT model, count(*) AS runs, round(avg(pr_auc), 9) AS mean_pr_auc, round(stddev_pop(pr_auc), 9) AS std_pr_auc,
       round(avg(roc_auc), 9) AS mean_roc_auc, round(stddev_pop(roc_auc), 9) AS std_roc_auc FROM score_metric GROUP BY 1""",
)
def agg_seed_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = metrics.seed_statistics(_runs(spark, folder))
    return stats.select("model", "runs", *[F.round(c, 9).alias(c) for c in stats.columns[2:]])


@query(
    "t5_argmax_tiebreak",
    "SELECT seed, round(pr_auc, 9) AS pr_auc FROM score_metric WHERE model = 'informed' ORDER BY score_metric.pr_auc DESC, seed LIMIT 1",
)
def argmax_tiebreak(spark: SparkSession, folder: str) -> DataFrame:
    best = _runs(spark, folder).filter("model = 'informed'").orderBy(F.desc("pr_auc"), F.asc("seed"))
    return best.limit(1).select("seed", F.round("pr_auc", 9).alias("pr_auc"))


@query(
    "m8_seed_selection",
    "SELECT model, arg_max(seed, score_metric.pr_auc - seed * 1e-15) AS best_seed FROM score_metric GROUP BY 1",
)
def seed_selection(spark: SparkSession, folder: str) -> DataFrame:
    best = F.max(F.struct("pr_auc", (-F.col("seed")).alias("minus"))).alias("best")
    return _runs(spark, folder).groupBy("model").agg(best).select(
        "model", (-F.col("best.minus")).alias("best_seed")
    )


@query(
    "m10_threshold_metrics",
    """SELECT model, seed, step, count(*) AS n_eval, CAST(sum(label) AS DOUBLE) / count(*) AS illicit_rate,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(called, 0), 0.0) AS precision,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(sum(label), 0), 0.0) AS recall,
       COALESCE(2.0 * tp / NULLIF(called + sum(label), 0), 0.0) AS f1
       FROM (SELECT *, count(*) FILTER (WHERE score >= 0.5 AND label = 1) OVER (PARTITION BY model, seed, step) AS tp,
                    count(*) FILTER (WHERE score >= 0.5) OVER (PARTITION BY model, seed, step) AS called
             FROM plain_score)
       GROUP BY model, seed, step, tp, called""",
)
def threshold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _plain_scores(spark, folder)
    return metrics.threshold_metrics(rows, ["model", "seed", "step"], MODELS.decision_threshold)


def _named(frame: DataFrame) -> DataFrame:
    """The plain runs under the names the decision expects."""
    best = F.when(F.col("model") == "informed", "challenger").otherwise("baseline")
    renamed = frame.withColumn("model", best)
    ablation = renamed.filter("model = 'challenger' AND seed = 42").withColumn("model", F.lit("ablation"))
    return renamed.unionByName(ablation)


@query(
    "m13_promotion_decision",
    """SELECT 'baseline' AS best_baseline, round(b, 9) AS baseline_pr_auc, round(c, 9) AS challenger_pr_auc,
       round(a, 9) AS ablation_pr_auc, round(c - b, 9) AS gain,
       CASE WHEN c - b >= 0.01 THEN 'promote' ELSE 'retain' END AS verdict
       FROM (SELECT avg(pr_auc) FILTER (WHERE model = 'plain') AS b, avg(pr_auc) FILTER (WHERE model = 'informed') AS c,
                    avg(pr_auc) FILTER (WHERE model = 'informed' AND seed = 42) AS a FROM score_metric)""",
)
def promotion_decision(spark: SparkSession, folder: str) -> DataFrame:
    named = materialize(_named(_runs(spark, folder)), "runs")
    row = training.promotion(named, "challenger", "ablation", MODELS)
    rounded = ["baseline_pr_auc", "challenger_pr_auc", "ablation_pr_auc", "gain"]
    return row.withColumns({c: F.round(c, 9) for c in rounded})


@query(
    "m14_model_comparison",
    """SELECT model, runs, round(mean_pr_auc, 9) AS mean_pr_auc, round(std_pr_auc, 9) AS std_pr_auc,
       round(mean_roc_auc, 9) AS mean_roc_auc, round(std_roc_auc, 9) AS std_roc_auc, round(d, 9) AS pr_auc_delta,
       CASE WHEN d > 0.01 THEN 'loses' WHEN d < -0.01 THEN 'beats' ELSE 'tie' END AS verdict
       FROM (SELECT model, count(*) AS runs, avg(pr_auc) AS mean_pr_auc, stddev_pop(pr_auc) AS std_pr_auc,
                    avg(roc_auc) AS mean_roc_auc, stddev_pop(roc_auc) AS std_roc_auc FROM score_metric GROUP BY 1)
       CROSS JOIN (SELECT avg(pr_auc) FILTER (WHERE model = 'informed') - avg(pr_auc) FILTER (WHERE model = 'plain') AS d
                   FROM score_metric)""",
)
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    table = training.comparison(materialize(_runs(spark, folder), "runs"), "plain", "informed", MODELS)
    numbers = [c for c in table.columns if c not in ("model", "runs", "verdict")]
    return table.withColumns({c: F.round(c, 9) for c in numbers})


@query("m20_config_fingerprint", """
    SELECT 'evaluation' AS stage, model, seed, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc,
           64 AS fingerprint_length FROM score_metric""")
def config_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated runs appended to a runs table and read back."""
    path = scratch_path(spark, "runs")
    settings = fingerprint(RuleConfig(), TRIAGE, SPLIT, MODELS, DRIFT)
    runs.append_runs(runs.run_records(_runs(spark, folder), "evaluation", settings), path)
    return runs.read_runs(spark, path).select(
        "stage", "model", "seed", "pr_auc", "roc_auc",
        F.length("fingerprint").alias("fingerprint_length"),
    )


# --- drift ---


def _sided(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_reference", F.col("step") <= SPLIT.train_max)


_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS col, step, CAST({c} AS DOUBLE) AS value FROM drift_row" for c in ALL_COLUMNS
    if c != "louvain_community"
)
DRIFT_COLUMNS = [c for c in ALL_COLUMNS if c != "louvain_community"]
cte("drift_row", "SELECT * FROM node_vector JOIN graph_node USING (id) JOIN graph_feature USING (id) WHERE label IS NOT NULL")
cte("drift_cell", _CELLS)
# the probabilities are the doubles a step of 0.1 gives, not the literals
_PROBS = ", ".join(f"({i} * CAST(0.1 AS DOUBLE))" for i in range(1, DRIFT.bins))
cte("drift_sorted", f"""
    SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) AS place, count(*) OVER (PARTITION BY col) AS n
    FROM drift_cell WHERE step <= {SPLIT.train_max}""")
cte("drift_edge", f"""
    SELECT DISTINCT col, value AS edge FROM drift_sorted CROSS JOIN (VALUES {_PROBS}) p(p)
    WHERE place = greatest(1, CAST(ceil(n * p) AS BIGINT))""")
cte("drift_range", "SELECT col, min(value) AS lowest, max(value) AS highest FROM drift_sorted GROUP BY 1")
cte("drift_bin", f"""
    SELECT c.col, CASE WHEN r.lowest = r.highest
                       THEN CASE WHEN c.value < r.lowest THEN 0 WHEN c.value = r.lowest THEN 1 ELSE 2 END
                       ELSE (SELECT count(*) FROM drift_edge e WHERE e.col = c.col AND e.edge <= c.value) END AS bin,
           c.step <= {SPLIT.train_max} AS ref
    FROM drift_cell c JOIN drift_range r ON c.col = r.col""")
cte("drift_count", """
    SELECT col, bin, count(*) FILTER (WHERE ref) AS reference, count(*) FILTER (WHERE NOT ref) AS actual
    FROM drift_bin GROUP BY 1, 2""")


def psi_sql(bins: str, key: str) -> str:
    e = f"greatest(CAST(reference AS DOUBLE) / sum(reference) OVER (PARTITION BY {key}), {DRIFT.floor})"
    a = f"greatest(CAST(actual AS DOUBLE) / sum(actual) OVER (PARTITION BY {key}), {DRIFT.floor})"
    return f"""SELECT {key}, sum((a - e) * ln(a / e)) AS psi
        FROM (SELECT {key}, {e} AS e, {a} AS a FROM {bins}) GROUP BY 1"""


_STATUS = f"CASE WHEN psi > {DRIFT.breach} THEN 'breach' WHEN psi > {DRIFT.watch} THEN 'watch' ELSE 'ok' END AS status"


@query("w6_quantile_edges", 'SELECT col AS "column", edge FROM drift_edge')
def quantile_edges(spark: SparkSession, folder: str) -> DataFrame:
    reference = _matrix(spark, folder).filter(F.col("step") <= SPLIT.train_max)
    found = drift.quantile_edges(reference, DRIFT_COLUMNS, DRIFT)
    return found.select("column", F.explode("edges").alias("edge"))


@query("w7_histogram_bins", 'SELECT col AS "column", CAST(bin AS INT) AS bin, reference, actual FROM drift_count')
def histogram_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sided(_matrix(spark, folder))
    edges = drift.quantile_edges(rows.filter("is_reference"), DRIFT_COLUMNS, DRIFT)
    return drift.histogram(rows, DRIFT_COLUMNS, edges)


@query("m15_psi_drift", f'SELECT col AS "column", round(psi, 9) AS psi, {_STATUS} FROM ({psi_sql("drift_count", "col")}) d')
def psi_drift(spark: SparkSession, folder: str) -> DataFrame:
    table = drift.psi_drift(_sided(_matrix(spark, folder)), DRIFT_COLUMNS, DRIFT)
    return table.withColumn("psi", F.round("psi", 9))


@query(
    "t4_topk_psi",
    f'SELECT col AS "column", round(psi, 9) AS psi FROM ({psi_sql("drift_count", "col")}) d ORDER BY d.psi DESC LIMIT 5',
)
def topk_psi(spark: SparkSession, folder: str) -> DataFrame:
    table = drift.psi_drift(_sided(_matrix(spark, folder)), DRIFT_COLUMNS, DRIFT)
    return table.orderBy(F.desc("psi")).limit(5).select("column", F.round("psi", 9).alias("psi"))


cte("format_count", """
    SELECT 'payment_format' AS col, payment_format AS bin,
           count(*) FILTER (WHERE day <= day1) AS reference, count(*) FILTER (WHERE day > day1) AS actual
    FROM (SELECT payment_format, CAST(tx_time AS DATE) AS day FROM bank_tx), cut GROUP BY 2""")


@query(
    "m16_category_share_stability",
    f'SELECT col AS "column", round(psi, 9) AS psi, {_STATUS} FROM ({psi_sql("format_count", "col")}) d',
)
def category_share_stability(spark: SparkSession, folder: str) -> DataFrame:
    c = inputs.cuts(spark, folder)
    rows = inputs.tx(spark, folder).select(
        "payment_format", (F.to_date("tx_time") <= F.lit(c.day1)).alias("is_reference")
    )
    return drift.category_stability(rows, "payment_format", DRIFT).withColumn("psi", F.round("psi", 9))


@query("g22_gate_psi_breach", f"""
    SELECT 'psi_breach' AS rule, '0' AS expected, CAST(count(*) FILTER (WHERE psi > {DRIFT.breach}) AS VARCHAR) AS actual,
           count(*) FILTER (WHERE psi > {DRIFT.breach}) = 0 AS passed FROM ({psi_sql("drift_count", "col")}) d""")
def gate_psi_breach(spark: SparkSession, folder: str) -> DataFrame:
    return gates.no_breach(drift.psi_drift(_sided(_matrix(spark, folder)), DRIFT_COLUMNS, DRIFT))


@query("t6_sample_seeded", """
    SELECT id, step FROM graph_node WHERE step >= 35
    ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 2000""")
def sample_seeded(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.nodes(spark, folder).filter(F.col("step") >= SPLIT.test_min)
    return seeded_sample(rows, "id", 2000, 42).select("id", "step")


# --- fits (no SQL form) ---


_FITTED: dict[tuple[str, str, str], object] = {}


def _fitted(spark: SparkSession, folder: str, name: str, fit: Callable[[], object]) -> object:
    """A fitted model, whose size does not grow with the data, once per application and
    folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _baselines(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.stage(
        spark, folder, "baseline-metrics",
        lambda: training.baselines(_matrix(spark, folder), NODE_FEATURES, SPLIT, MODELS),
    )


@query("m2_baseline_logistic")
def baseline_logistic(spark: SparkSession, folder: str) -> DataFrame:
    return _baselines(spark, folder).filter("model = 'logistic_regression'")


@query("m3_baseline_forest")
def baseline_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _baselines(spark, folder).filter("model = 'random_forest'")


@query("g21_gate_roc_auc")
def gate_roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return gates.metric_floor(_baselines(spark, folder), "roc_auc", MODELS.smoke_roc_auc)


def _challengers(spark: SparkSession, folder: str) -> dict:
    """Per seed the booster and its calibrated folds; all grow together."""
    def fit() -> dict:
        train, _ = matrix.split_temporal(_vectors(spark, folder), SPLIT)
        return training.fit_seeds(train, len(ALL_COLUMNS), MODELS)

    return _fitted(spark, folder, "challengers", fit)


@query("m5_gbt_challenger")
def gbt_challenger(spark: SparkSession, folder: str) -> DataFrame:
    """Uncalibrated boosted trees per seed on the test period."""
    _, test = matrix.split_temporal(_vectors(spark, folder), SPLIT)
    parts = [
        training.scored(model, test).withColumn("seed", F.lit(s))
        for s, (model, _) in _challengers(spark, folder).items()
    ]
    return metrics.rank_metrics(union_all(parts), ["seed"])


@query("m6_grid_tuning")
def grid_tuning(spark: SparkSession, folder: str) -> DataFrame:
    """All grid points with the full number of trees and the full patience."""
    return training.tune(_vectors(spark, folder), len(ALL_COLUMNS), SPLIT, ModelConfig())


@query("m7_isotonic_calibration")
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated scores of the test period for every seed."""
    _, test = matrix.split_temporal(_vectors(spark, folder), SPLIT)
    return union_all([
        model.scores(test).select(F.lit(s).alias("seed"), "id", "label", F.round("score", 9).alias("score"))
        for s, (_, model) in _challengers(spark, folder).items()
    ])


@query("m11_walk_forward")
def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    return training.walk_forward(_vectors(spark, folder), len(ALL_COLUMNS), SPLIT, MODELS)


@query("m12_ablation")
def ablation(spark: SparkSession, folder: str) -> DataFrame:
    kept = [c for c in ALL_COLUMNS if not c.startswith("ego_illicit")]
    slim = materialize(spread(matrix.assemble(_matrix(spark, folder), kept, training.KEEP), "id"), "vectors")
    train, test = matrix.split_temporal(slim, SPLIT)
    model = training.fit_calibrated(train, len(kept), MODELS.seeds[0], MODELS)
    scores = model.scores(test).withColumn("model", F.lit("boosted_no_ego_labels"))
    return metrics.rank_metrics(scores, ["model"])


@query("m17_tree_attribution")
def tree_attribution(spark: SparkSession, folder: str) -> DataFrame:
    _, test = matrix.split_temporal(_vectors(spark, folder), SPLIT)
    model, _ = _challengers(spark, folder)[MODELS.seeds[0]]
    return attribution.mean_attribution(model, test, ALL_COLUMNS)


@query("m18_sage_baseline")
def sage_baseline(spark: SparkSession, folder: str) -> DataFrame:
    stepped = graph.edge_steps(inputs.nodes(spark, folder), inputs.edges(spark, folder))
    return sage.sage_baseline(
        inputs.nodes(spark, folder), graph_vectors(spark, folder), stepped, NODE_FEATURES, SPLIT,
        MODELS, hidden=64, epochs=200,
    )


@query("k5_walk_forward_account_model")
def walk_forward_account_model(spark: SparkSession, folder: str) -> DataFrame:
    """Account behaviour before a cut predicts flagged payments after it."""
    _, figures = account_model(
        inputs.tx(spark, folder), inputs.profile(spark, folder), inputs.cuts(spark, folder), MODELS
    )
    return figures

