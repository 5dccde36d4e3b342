"""Splits, fits, leak rules, decisions and attribution; then all jobs of the
graph track in order."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import learning_queries
from tidewatch.config import DriftConfig, IngestConfig, ModelConfig, SplitConfig
from tidewatch.errors import DataQualityError, SmokeGateError
from tidewatch.learning import attribution, matrix, training
from tidewatch.plans import ingest, modelling

COLUMNS = [f"f{i:03d}" for i in range(1, 5)]
CFG = ModelConfig(
    seeds=(42, 7), boosted_trees=4, forest_trees=12, leaves=6, min_rows_per_leaf=2, learning_rate=0.3,
    grid={"leaves": (3, 6), "learning_rate": (0.3,), "min_rows_per_leaf": (2,), "feature_share": (1.0,)},
)


def table(seed=0, rows=490):
    """Illicit where |f001| is large; the rest is noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, len(COLUMNS)))
    x[:, 0] *= 5
    return [
        (f"{i:05d}", i % 49 + 1, int(abs(x[i, 0]) > 4), *map(float, x[i])) for i in range(rows)
    ]


@pytest.fixture(scope="module")
def rows(spark):
    schema = "id string, step int, y int, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(table(), schema).persist()


@pytest.fixture(scope="module")
def vectors(rows):
    return matrix.assemble(rows, COLUMNS, training.KEEP).persist()


def test_splits(rows):
    train, test = matrix.split_temporal(rows)
    assert (train.count(), test.count()) == (340, 150)
    train, validation = matrix.split_temporal(rows, protocol="tuning")
    assert train.agg(F.max("step")).first()[0] == 30
    assert validation.agg(F.min("step"), F.max("step")).first()[:] == (31, 34)
    with pytest.raises(DataQualityError, match="empty side"):
        matrix.split_temporal(rows.filter("step < 35"))


def test_weights_and_scaling(spark, rows):
    got = {r["y"]: (r["n"], r["weight"]) for r in matrix.class_weights(rows).collect()}
    assert sum(n * w for n, w in got.values()) == pytest.approx(490)
    flat = rows.withColumn("c", F.lit(2.0))
    stats = matrix.standardize_stats(flat, [*COLUMNS, "c"])
    scaled = matrix.standardize(flat, stats).agg(F.avg("f001"), F.stddev_pop("f001"), F.max("c")).first()
    assert scaled[:] == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)


def test_forest_beats_the_linear_model_and_the_smoke_gate(rows):
    one = replace(CFG, seeds=(42,))
    mean = {r["model"]: r["pr_auc"] for r in training.baselines(rows, COLUMNS, cfg=one).collect()}
    assert mean["random_forest"] > 0.9 > mean["logistic_regression"]
    with pytest.raises(SmokeGateError, match="logistic"):
        training.smoke_gate(rows, COLUMNS, cfg=one)
    assert training.smoke_gate(rows, COLUMNS, cfg=replace(one, smoke_roc_auc=0.1)).count() == 2
    with pytest.raises(SmokeGateError, match="too slow"):
        training.smoke_gate(rows, COLUMNS, cfg=replace(one, smoke_roc_auc=0.1, smoke_seconds=0.0))


def test_test_period_rows_do_not_reach_tuning(vectors):
    """Turning every test-period label round changes no trial."""
    turned = vectors.withColumn("y", F.when(F.col("step") >= 35, 1 - F.col("y")).otherwise(F.col("y")))
    trials = [
        sorted(tuple(r) for r in training.tune(v, len(COLUMNS), cfg=CFG).collect()) for v in (vectors, turned)
    ]
    assert trials[0] == trials[1] and len(trials[0]) == 2


def test_best_trial_breaks_ties_by_text(spark):
    trials = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.4)], "trial string, pr_auc double")
    assert training.best_trial(trials).first()["trial"] == "a"
    seeds = spark.createDataFrame([(42, 0.5), (7, 0.5)], "seed int, pr_auc double")
    assert training.best_seed(seeds) == 7


def test_walk_forward_covers_every_step_and_refuses_leaks(vectors):
    short = vectors.filter("step <= 37")
    got = training.walk_forward(short, len(COLUMNS), cfg=CFG).collect()
    assert sorted(r["step"] for r in got) == [35, 36, 37]
    assert all(0.0 <= r[m] <= 1.0 for r in got for m in ("f1", "precision", "recall", "pr_auc"))
    with pytest.raises(DataQualityError, match="look-ahead"):
        training.walk_forward(short, len(COLUMNS), cfg=CFG, train_rows=lambda df, t: df.filter(F.col("step") <= t))
    with pytest.raises(DataQualityError, match="look-ahead"):
        training.walk_forward(short, len(COLUMNS), cfg=CFG, train_rows=lambda df, t: df.limit(0))


def test_walk_forward_moves_a_row_once_and_a_splitter_of_the_same_rows_changes_nothing(vectors, monkeypatch):
    short, moved, grow = vectors.filter("step <= 37"), [], training.grow

    def counted(rows, *args, **more):
        moved.append(rows.count())
        return grow(rows, *args, **more)

    monkeypatch.setattr(training, "grow", counted)
    one, two = (
        sorted(tuple(r) for r in training.walk_forward(short, len(COLUMNS), cfg=CFG, train_rows=t).collect())
        for t in (training.rows_before, lambda df, t: df.filter(F.col("step") < t))
    )
    assert moved == [short.count(), short.filter("step < 35").count() * 3 + short.filter("step = 35").count() * 2
                     + short.filter("step = 36").count()]
    assert one == two


def test_baselines_fit_on_every_core(spark, rows, monkeypatch):
    used, fit = [], training.fit_forest

    def counted(train, *args):
        used.append(train.groupBy(F.spark_partition_id()).count().count())
        return fit(train, *args)

    monkeypatch.setattr(training, "fit_forest", counted)
    training.baselines(rows.coalesce(1), COLUMNS, cfg=replace(CFG, seeds=(42,)))
    assert used == [spark.sparkContext.defaultParallelism]


def test_calibrated_scores_are_probabilities(vectors):
    model = training.fit_calibrated(vectors.filter("step <= 34"), len(COLUMNS), 42, CFG)
    got = model.scores(vectors.filter("step > 34")).agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert got[0] == 150 and 0.0 <= got[1] <= got[2] <= 1.0


def test_attribution_adds_up_and_ranks_the_signal_first(rows, vectors):
    model = training.fit_booster(vectors, len(COLUMNS), 42, CFG)
    paths = attribution.leaf_paths(model)
    x = np.array([r[3:] for r in table()[:60]])
    total = attribution.attributions(paths, x).sum(axis=1) + attribution.base_value(paths)
    margin = np.zeros(len(x))
    for p in paths:
        inside = np.ones(len(x), dtype=bool)
        for i, f in enumerate(p.features):
            inside &= (x[:, f] > p.low[i]) & (x[:, f] <= p.high[i])
        margin += p.value * inside
    assert total == pytest.approx(margin)
    # the same margin as the model's own probability
    own = [r["probability"][1] for r in model.transform(vectors.filter("id < '00060'")).orderBy("id").collect()]
    assert own == pytest.approx(list(1 / (1 + np.exp(-margin))))
    ranked = attribution.mean_attribution(model, vectors, COLUMNS).orderBy("position").collect()
    assert ranked[0]["feature"] == "f001" and [r["position"] for r in ranked] == [1, 2, 3, 4]


def test_attribution_explains_every_test_row(spark, monkeypatch):
    step = F.when(F.col("id") < 30_000, SplitConfig().test_min).otherwise(SplitConfig().train_max)
    rows = spark.range(30_010).select("id", step.alias("step"))
    monkeypatch.setattr(learning_queries, "_vectors", lambda *_: rows)
    monkeypatch.setattr(training, "fit_seeds", lambda *_: {42: (None, None)})
    monkeypatch.setattr(attribution, "mean_attribution", lambda model, explained, names: explained)
    assert learning_queries.tree_attribution(spark, "").count() == 30_000



def test_decisions(spark):
    runs = [
        ("base", 1, 0.50, 0.5), ("base", 2, 0.60, 0.5), ("other", 1, 0.52, 0.5),
        ("new", 1, 0.56, 0.9), ("new", 2, 0.56, 0.7), ("cut", 1, 0.30, 0.5),
    ]
    frame = spark.createDataFrame(runs, "model string, seed int, pr_auc double, roc_auc double")
    row = training.promotion(frame, "new", "cut").first()
    assert row["best_baseline"] == "base" and row["verdict"] == "promote"
    assert row["gain"] == pytest.approx(0.01)
    weaker = frame.withColumn("pr_auc", F.when(F.col("model") == "new", 0.555).otherwise(F.col("pr_auc")))
    assert training.promotion(weaker, "new", "cut").first()["verdict"] == "retain"
    with pytest.raises(DataQualityError, match="ablation"):
        training.promotion(frame.filter("model <> 'cut'"), "new", "cut")
    verdicts = [training.comparison(f, "base", "new").first()["verdict"] for f in (frame, weaker)]
    assert verdicts == ["loses", "tie"]
    assert training.comparison(frame, "new", "cut").first()["verdict"] == "beats"
    stats = {r["model"]: r for r in training.comparison(frame, "base", "new").collect()}
    assert stats["base"]["std_pr_auc"] == pytest.approx(0.05)
    assert stats["new"]["std_roc_auc"] == pytest.approx(0.1)


def test_graph_track_end_to_end(spark, tmp_path):
    raw, store = tmp_path / "raw", str(tmp_path / "store")
    raw.mkdir()
    data = table(1)
    (raw / "elliptic_txs_features.csv").write_text(
        "\n".join(",".join(map(str, [r[0], r[1], *r[3:]])) for r in data) + "\n"
    )
    classes = ["1" if r[2] else "2" for r in data]
    classes[::25] = ["unknown"] * len(classes[::25])
    (raw / "elliptic_txs_classes.csv").write_text(
        "txId,class\n" + "\n".join(f"{r[0]},{c}" for r, c in zip(data, classes, strict=True)) + "\n"
    )
    edges = [(data[i][0], data[i + 49][0]) for i in range(0, 441, 3)]
    (raw / "elliptic_txs_edgelist.csv").write_text("txId1,txId2\n" + "\n".join(map(",".join, edges)) + "\n")
    pins = {"datasets": {"elliptic": {"files": {
        p.name: {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()}
        for p in raw.iterdir()
    }}}}
    counts = ((1, classes.count("1")), (2, classes.count("2")), (None, classes.count("unknown")))
    good = IngestConfig(feature_count=len(COLUMNS), graph_tx=490, graph_edges=len(edges), graph_classes=counts)
    with pytest.raises(DataQualityError, match="edges: expected 1"):
        ingest.ingest_graph(spark, str(raw), store, pins, replace(good, graph_edges=1))
    with pytest.raises(DataQualityError, match="ingest"):
        modelling.run_graph_features(spark, store)
    ingest.ingest_graph(spark, str(raw), store, pins, good)
    with pytest.raises(DataQualityError, match="run the baselines first"):
        modelling.run_challenger(spark, store)

    assert modelling.run_graph_features(spark, store).count() == 490
    one = replace(CFG, seeds=(42,), boosted_trees=3)
    modelling.run_baselines(spark, store, cfg=one)
    decision = modelling.run_challenger(spark, store, cfg=one).first()
    assert decision["verdict"] in ("promote", "retain") and decision["best_seed"] == 42
    split = SplitConfig(test_min=48)  # two refits are enough here
    assert modelling.run_validation(spark, store, split, one).count() == 2
    try:
        drift = modelling.run_drift(spark, store, cfg=DriftConfig(breach=10.0))
        assert "score" in {r["column"] for r in drift.collect()}
    finally:
        assert spark.read.parquet(f"{store}/drift").count() == len(COLUMNS) + 6 + 1
    assert modelling.run_attribution(spark, store, cfg=one).orderBy("position").first()["feature"] == "f001"
    compared = modelling.run_sage(spark, store, cfg=one, hidden=4, epochs=10)
    assert compared.count() == 2
    assert modelling.list_runs(spark, store).select("stage").distinct().count() == 3
