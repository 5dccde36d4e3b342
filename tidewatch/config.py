"""Frozen settings. Every job takes them as an argument, so a changed value
always reaches the plan."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class RuleConfig:
    """Scenario thresholds; the defaults are fixed values."""

    window: str = "day"
    currency: str = "US Dollar"
    reporting_threshold: Decimal = Decimal("10000")
    structuring_floor: Decimal = Decimal("9000")
    structuring_min_txs: int = 3
    structuring_min_total: Decimal | None = None  # None: the reporting threshold
    velocity_min_txs: int = 20
    churn_max_retained: Decimal = Decimal("0.10")
    fan_min_counterparties: int = 5
    fan_min_amount: Decimal = Decimal("50000")
    cycle_lengths: tuple[int, ...] = (2, 3)
    cycle_tolerance: Decimal = Decimal("0.10")
    cycle_min_leg: Decimal = Decimal("1000")
    exclude_self_loops: bool = False
    community_min_shared: int = 5
    community_max_hub_degree: int = 64

    @property
    def structuring_total(self) -> Decimal:
        if self.structuring_min_total is None:
            return self.reporting_threshold
        return self.structuring_min_total


@dataclass(frozen=True)
class TriageConfig:
    """Cut points, fusion weights and the operating point; fixed values."""

    train_cut: float = 0.60
    test_cut: float = 0.80
    ml_weight: float = 0.60
    rule_weight: float = 0.40
    operating_k: int = 500
    precision_ks: tuple[int, ...] = (100, 500, 1000)
    cost_per_case: float = 50.0
    curve_depths: tuple[int, ...] = (
        1, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000,
    )
    reporting_threshold: Decimal = Decimal("10000")
    currency: str = "US Dollar"


@dataclass(frozen=True)
class SplitConfig:
    """Temporal split by integer step; fixed values."""

    first_step: int = 1
    last_step: int = 49
    train_max: int = 34
    test_min: int = 35
    tuning_train_max: int = 30
    tuning_val_min: int = 31
    tuning_val_max: int = 34


@dataclass(frozen=True)
class ModelConfig:
    """Model settings; fixed values. Tree counts are parameters because every
    refit is a distributed job."""

    seeds: tuple[int, ...] = (42, 7, 2026)
    smoke_seed: int = 42
    smoke_roc_auc: float = 0.80
    smoke_seconds: float = 600.0
    forest_trees: int = 300
    boosted_trees: int = 400
    learning_rate: float = 0.05
    subsample: float = 0.8
    leaves: int = 31
    min_rows_per_leaf: int = 20
    feature_share: float = 1.0
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "leaves": (15, 31, 63),
            "learning_rate": (0.05, 0.1),
            "min_rows_per_leaf": (20, 50),
            "feature_share": (0.8, 1.0),
        }
    )
    patience: int = 50
    forest_depth: int = 10
    calibration_folds: int = 3
    min_gain: float = 0.01
    decision_threshold: float = 0.5


@dataclass(frozen=True)
class DriftConfig:
    """Population stability index settings; fixed values."""

    bins: int = 10
    floor: float = 1e-6
    breach: float = 0.25
    watch: float = 0.10


@dataclass(frozen=True)
class IngestConfig:
    """Expected sizes of the two public datasets; fixed values."""

    feature_count: int = 165
    graph_tx: int = 203_769
    graph_edges: int = 234_355
    graph_classes: tuple[tuple[int | None, int], ...] = (
        (1, 4_545), (2, 42_019), (None, 157_205),
    )
    bank_min_tx: int = 5_078_345
    bank_min_accounts: int = 515_000
    flagged_rate: float = 1 / 981
    flagged_tolerance: float = 0.05
    flagged_count: int = 5_177


def fingerprint(*configs: object) -> str:
    """SHA-256 over the sorted settings, used to tie a run to its parameters."""
    values = sorted(
        (type(c).__name__ + "." + name, repr(value))
        for c in configs
        for name, value in asdict(c).items()
    )
    return hashlib.sha256(repr(values).encode()).hexdigest()
