"""Graph track: graph features, baselines, challenger, validation, drift and
attribution as jobs over a table folder. Each job checks its inputs, computes
everything and only then writes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import DriftConfig, ModelConfig, SplitConfig, fingerprint
from tidewatch.errors import DataQualityError
from tidewatch.functions.cumulative import global_rank
from tidewatch.learning import attribution, boosting, matrix, runs, sage, training
from tidewatch.operators import communities, drift, gates, graph
from tidewatch.operators.metrics import base_rate_labelled
from tidewatch.session import materialize, replace_table, spread
from tidewatch.sources.files import open_tables, path_exists, union_all

BASE = {
    "graph_tx": "ingest the graph files first",
    "graph_tx_features": "ingest the graph files first",
}
WITH_EDGES = {**BASE, "graph_edge": "ingest the graph files first"}
WITH_GRAPH = {**BASE, "graph_features": "run the graph features first"}


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    return replace_table(df, f"{folder}/{name}")


def _nodes(tables: dict[str, DataFrame]) -> DataFrame:
    steps = tables["graph_tx_features"].select("tx_id", "time_step")
    return tables["graph_tx"].join(steps, "tx_id").select(
        F.col("tx_id").alias("id"), F.col("time_step").alias("step"),
        F.col("class_label").alias("label"),
    )


def _vectors(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    table = tables["graph_tx_features"]
    names = [c for c in table.columns if c not in ("tx_id", "time_step")]
    return table.select(F.col("tx_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in names]), names


def _edges(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["graph_edge"].select(
        F.col("src_tx_id").alias("src"), F.col("dst_tx_id").alias("dst")
    )


def _matrix(tables: dict[str, DataFrame], with_graph: bool) -> tuple[DataFrame, list[str]]:
    features, names = _vectors(tables)
    extra = tables["graph_features"] if with_graph else None
    columns = [*names, *(graph.FEATURES if with_graph else [])]
    rows = materialize(matrix.model_matrix(_nodes(tables), features, extra), "model-matrix")
    return matrix.check_matrix(rows, columns), columns


def _record(metrics: DataFrame, folder: str, stage: str, *configs: object) -> None:
    runs.append_runs(runs.run_records(metrics, stage, fingerprint(*configs)), f"{folder}/runs")


def run_graph_features(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(),
    moving: communities.MovingConfig = communities.MovingConfig(), hub_degree: int = 512,
) -> DataFrame:
    """Write ``graph_features``. Communities are numbered from 1 in the order of their
    smallest node ids, which may be text; -1 stays free for no community."""
    tables = open_tables(spark, folder, WITH_EDGES)
    nodes, edges = materialize(_nodes(tables), "nodes"), _edges(tables)
    gates.enforce(gates.no_rows(graph.dangling_ends(nodes, edges), "dangling_edge"))
    stepped = materialize(graph.edge_steps(nodes, edges), "edge-steps")
    found = communities.communities(graph.inductive_edges(stepped, split.train_max), moving)
    found = materialize(found, "communities")
    numbers = global_rank(found.select("community").distinct(), ["community"], "number")
    numbered = found.join(numbers, "community").select("id", F.col("number").alias("community"))
    features = materialize(graph.graph_features(nodes, edges, numbered, hub_degree), "graph-features")
    gates.enforce(gates.feature_coverage(features, nodes, graph.FEATURES))
    return _write(features, folder, "graph_features")


def run_smoke(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(), cfg: ModelConfig = ModelConfig()
) -> DataFrame:
    rows, columns = _matrix(open_tables(spark, folder, BASE), False)
    return _write(training.smoke_gate(rows, columns, split, cfg), folder, "smoke_metrics")


def run_baselines(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(), cfg: ModelConfig = ModelConfig()
) -> DataFrame:
    rows, columns = _matrix(open_tables(spark, folder, BASE), False)
    written = _write(training.baselines(rows, columns, split, cfg), folder, "baseline_metrics")
    _record(written, folder, "baselines", split, cfg)
    return written


def run_challenger(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(),
    cfg: ModelConfig = ModelConfig(), tune: bool = True,
) -> DataFrame:
    """Tune inside the training period, fit all seeds, decide, and write the
    metrics, the decision and the best model. The tree count and subsampling
    are fixed outside the grid and carry over to the winner."""
    tables = open_tables(
        spark, folder, {**WITH_GRAPH, "baseline_metrics": "run the baselines first"}
    )
    rows, columns = _matrix(tables, True)
    chosen, trials = cfg, None
    if tune:
        vectors = materialize(spread(matrix.assemble(rows, columns, training.KEEP), "id"), "vectors")
        trials = materialize(training.tune(vectors, len(columns), split, cfg), "trials")
        winner = training.best_trial(trials).first()["trial"]
        point = next(p for p in training.grid_points(cfg) if training.point_text(p) == winner)
        chosen = training.with_point(cfg, point)
    result = training.run_challenger(rows, columns, split, chosen)
    metrics = materialize(result.metrics, "challenger")
    known = tables["baseline_metrics"].unionByName(metrics)
    decision = training.promotion(
        known, "boosted_challenger", "boosted_challenger_no_ego_labels", chosen
    ).withColumn("best_seed", F.lit(result.best_seed))
    if trials is not None:
        _write(trials, folder, "tuning_trials")
    boosting.save(spark, result.models[result.best_seed], f"{folder}/challenger_model")
    _write(result.validation, folder, "challenger_validation")
    written = _write(metrics, folder, "challenger_metrics")
    _record(written, folder, "challenger", split, chosen)
    return _write(decision, folder, "challenger_decision")


def run_validation(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(),
    cfg: ModelConfig = ModelConfig(), train_rows=training.rows_before,
) -> DataFrame:
    """Walk-forward figures per step and the base-rate curve."""
    tables = open_tables(spark, folder, WITH_GRAPH)
    rows, columns = _matrix(tables, True)
    vectors = materialize(spread(matrix.assemble(rows, columns, training.KEEP), "id"), "vectors")
    steps = materialize(
        training.walk_forward(vectors, len(columns), split, replace(cfg, subsample=1.0), train_rows),
        "walk-forward",
    )
    _write(base_rate_labelled(_nodes(tables)), folder, "base_rate")
    return _write(steps, folder, "validation_metrics")


def _load_model(folder: str, spark: SparkSession) -> boosting.BoostedModel:
    if not path_exists(spark, f"{folder}/challenger_model"):
        raise DataQualityError("challenger_model does not exist; run the challenger first")
    return boosting.load(spark, f"{folder}/challenger_model")


def run_drift(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(), cfg: DriftConfig = DriftConfig()
) -> DataFrame:
    """PSI of every feature and of the score, plus the share stability of the
    community; the table is written first, then a breach raises."""
    tables = open_tables(spark, folder, WITH_GRAPH)
    model = _load_model(folder, spark)
    rows, columns = _matrix(tables, True)
    scores = training.scored(model, matrix.assemble(rows, columns, training.KEEP)).select("id", "score")
    sided = materialize(
        rows.join(scores, "id").withColumn("is_reference", F.col("step") <= split.train_max), "drift"
    )
    monitored = [c for c in columns if c != "louvain_community"] + ["score"]
    table = drift.psi_drift(sided, monitored, cfg)
    shares = drift.category_stability(sided, "louvain_community", cfg)
    _write(shares, folder, "category_stability")
    return drift.check_breach(_write(table, folder, "drift"))


def run_attribution(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(), cfg: ModelConfig = ModelConfig()
) -> DataFrame:
    tables = open_tables(spark, folder, WITH_GRAPH)
    model = _load_model(folder, spark)
    rows, columns = _matrix(tables, True)
    _, test = matrix.split_temporal(rows, split)
    vectors = matrix.assemble(test, columns, training.KEEP)
    return _write(attribution.mean_attribution(model, vectors, columns), folder, "attribution")


def run_sage(
    spark: SparkSession, folder: str, split: SplitConfig = SplitConfig(),
    cfg: ModelConfig = ModelConfig(), hidden: int = 64, epochs: int = 200,
) -> DataFrame:
    """Graph baseline and its comparison with the challenger, whose metrics must
    exist before anything is fitted."""
    tables = open_tables(
        spark, folder, {**WITH_EDGES, "challenger_metrics": "run the challenger first"}
    )
    nodes = materialize(_nodes(tables), "nodes")
    features, names = _vectors(tables)
    gates.enforce(gates.no_nan(features, names))
    stepped = graph.edge_steps(nodes, _edges(tables))
    metrics = materialize(
        sage.sage_baseline(nodes, features, stepped, names, split, cfg, hidden, epochs), "sage"
    )
    both = union_all([metrics, tables["challenger_metrics"]])
    table = training.comparison(both, "sage_inductive", "boosted_challenger", cfg)
    _write(metrics, folder, "sage_metrics")
    _record(metrics, folder, "sage", split, cfg)
    return _write(table, folder, "model_comparison")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    if not path_exists(spark, f"{folder}/runs"):
        raise DataQualityError("the runs table does not exist; run a training stage first")
    return runs.read_runs(spark, f"{folder}/runs")

