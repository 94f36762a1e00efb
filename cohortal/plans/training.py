"""The staged training run: buyer, high-value, revenue, gates, stacking."""

from __future__ import annotations

from copy import deepcopy
from functools import reduce
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.keys import sample_key
from cohortal.core.settle import settle
from cohortal.functions.gates import (
    final_gate,
    gate_revenue,
    meta_features,
    scale_probability,
    whale_multiplier,
)
from cohortal.models.base import with_vector
from cohortal.models.buyer import BuyerModel, load_classifier, train_classifier
from cohortal.models.calibration import fit_calibrator
from cohortal.models.revenue import BOOSTED, RevenueModel, load_revenue, train_revenue
from cohortal.models.stacking import StackingModel, load_stacking, train_stacking
from cohortal.operators.sampling import (
    add_high_value_label,
    fit_bins,
    high_value_threshold,
    undersample_bins,
    zero_anchors,
)
from cohortal.operators.search import alpha_curve, best_of, fit_zero_rate
from cohortal.operators.splits import NON_FEATURES, drop_whales, paying_buyers, stratified_split
from cohortal.plans.prepare import Preparation, fit_preparation
from cohortal.sources.files import read_params, write_params


@dataclass
class Settings:
    """Run parameters. Rounds and depth are one size for all tree stages and meant to be raised in production."""

    reference: str = "2025-10-08"
    revenue_cap: float = 500.0
    train_fraction: float = 0.8
    stratify: str = "buyer_d7"
    anchors_per_hour: int = 2
    histus_bins: int = 30
    histus_percentile: float = 2.0
    calibration: str = "beta"
    calibration_regularization: float = 0.05
    calibration_epsilon: float = 1e-4
    high_value_quantile: float = 0.995
    high_value_min: float = 75.0
    objective: str = "log_trees"
    horizons: tuple[int, ...] = (1, 7, 14)
    whale_filter: dict[str, float] | None = None
    gating: dict[str, float] = field(
        default_factory=lambda: {"power": 1.25, "floor": 0.0, "cap": 0.8, "cutoff": 0.01}
    )
    zero_rate: dict[str, float] = field(
        default_factory=lambda: {"target": 0.975, "low": 0.005, "high": 0.2, "tolerance": 0.002}
    )
    whale_gate: dict[str, float] = field(
        default_factory=lambda: {
            "power": 0.8, "cap": 0.95, "cutoff": 0.35, "boost": 2.0, "low": 1.0, "high": 3.5
        }
    )
    loss_weights: dict[str, float] = field(default_factory=lambda: {"d1": 0.3, "d7": 0.5, "d14": 0.2})
    feature_cap: float | None = 15.0
    rounds: int = 50
    depth: int = 5
    folds: int = 5
    oof_folds: int = 5  # parts for the stage-3 training features; below 2 they come from the fitted rows
    seed: int = 42
    tune_on_gated: bool = False
    portable: bool = False


@dataclass
class TrainedRun:
    """All fitted stages; ``score`` chains them lazily over raw rows."""

    settings: Settings
    prep: Preparation
    buyer: BuyerModel
    whale: BuyerModel | None
    revenue: RevenueModel
    stacking: StackingModel | None = None
    alpha: float = 1.0
    zero_rate_report: dict[str, Any] = field(default_factory=dict)

    @property
    def horizon_columns(self) -> dict[str, str]:
        return {f"d{h}": f"pred_d{h}" for h in sorted(self.revenue.models)}

    def stage_scores(self, prepared: DataFrame, gated: bool = True) -> DataFrame:
        """Buyer, whale and revenue predictions of prepared rows, revenue gated if asked."""
        out = self.buyer.score(with_vector(prepared, self.prep.features), "buyer_proba")
        out = out.withColumn("buyer_proba", scale_probability(F.col("buyer_proba"), self.alpha))
        if self.whale is not None:
            out = self.whale.score(out, "whale_proba")
        out = self.revenue.score(out).drop("features")
        if not gated:
            return out
        g, w = self.settings.gating, self.settings.whale_gate
        boost = F.lit(1.0)
        if self.whale is not None:
            boost = whale_multiplier(
                F.col("whale_proba"), w["boost"], w["low"], w["high"], w["power"], w["cap"], w["cutoff"]
            )
        value = lambda c: gate_revenue(
            F.col(c), F.col("buyer_proba"), g["power"], g["floor"], g["cap"], g["cutoff"]
        )
        return out.withColumns({c: value(c) * boost for c in self.horizon_columns.values()})

    def meta_table(self, scored: DataFrame, keep: list[str]) -> DataFrame:
        made = meta_features(
            scored, self.horizon_columns, self.settings.loss_weights, self.settings.gating,
            self.settings.whale_gate, whale="whale_proba" if self.whale is not None else None,
            feature_cap=self.settings.feature_cap,
        )
        return scored.select(*keep, *made)

    def score(self, raw: DataFrame, keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
        """``keep`` columns plus ``iap_revenue_d7`` predicted for raw rows."""
        prepared = self.prep.apply(raw, keep)
        meta = self.meta_table(self.stage_scores(prepared), list(keep))
        assert self.stacking is not None, "train the stacking stage first"
        out = self.stacking.score(meta, "stacked")
        value = final_gate(F.col("stacked"), F.col("buyer_proba"), self.settings.gating["cutoff"])
        return out.select(*keep, value.alias("iap_revenue_d7"))

    def save(self, path: str) -> None:
        self.buyer.save(f"{path}/buyer")
        if self.whale is not None:
            self.whale.save(f"{path}/whale")
        self.revenue.save(f"{path}/revenue")
        if self.stacking is not None:
            self.stacking.save(f"{path}/stacking")
        params: dict[str, Any] = {
            "settings": asdict(self.settings), "prep": self.prep.to_params(), "alpha": self.alpha,
            "has_whale": self.whale is not None, "has_stacking": self.stacking is not None,
            "zero_rate_report": self.zero_rate_report,
        }
        write_params(SparkSession.active(), params, f"{path}/run")


def load_run(spark: SparkSession, path: str) -> TrainedRun:
    """Reload a saved run; stages that were never trained stay empty."""
    params = read_params(spark, f"{path}/run")
    return TrainedRun(
        Settings(**params["settings"]),
        Preparation.from_params(params["prep"]),
        load_classifier(spark, f"{path}/buyer"),
        load_classifier(spark, f"{path}/whale") if params["has_whale"] else None,
        load_revenue(spark, f"{path}/revenue"),
        load_stacking(spark, f"{path}/stacking") if params["has_stacking"] else None,
        params["alpha"],
        params.get("zero_rate_report", {}),
    )


def _stage_rows(prepared: DataFrame, features: list[str], label: str) -> DataFrame:
    """Labels, keys and the model vector of prepared rows, written once: all that the stages read, in few columns."""
    kept = [c for c in NON_FEATURES if c in prepared.columns]
    return settle(with_vector(prepared, features).select(*kept, "features"), label)


def fit_stages(
    train: DataFrame, val: DataFrame, prep: Preparation, s: Settings
) -> tuple[BuyerModel, BuyerModel | None, RevenueModel]:
    """Calibrated buyer model, whale model (none without whales) and revenue models of prepared rows."""
    size = dict(maxIter=s.rounds, maxDepth=s.depth, seed=s.seed)
    buyer = train_classifier(train, val, prep.features, "buyer_d7", **size)
    raw_scores = settle(buyer.score(val, "p", raw=True).select("p", "buyer_d7"), "raw")
    buyer.calibrator = fit_calibrator(
        raw_scores, "p", "buyer_d7", s.calibration, s.calibration_regularization, s.calibration_epsilon
    )

    threshold = high_value_threshold(train, "iap_revenue_d7", s.high_value_quantile, s.high_value_min)
    high_train, high_val = (add_high_value_label(d, threshold) for d in (train, val))
    whale = None
    if not high_train.where("high_value = 1").isEmpty():
        whale = train_classifier(high_train, high_val, prep.features, "high_value", min_weight=1.0, **size)

    payers, _ = paying_buyers(train)
    if s.whale_filter:
        payers = drop_whales(payers, **s.whale_filter)
    bins = fit_bins(payers, "iap_revenue_d7", s.histus_bins)
    balanced = settle(
        undersample_bins(payers, bins, s.histus_percentile, seed=s.seed, portable=s.portable), "balanced"
    )
    trees = size if s.objective == "log_trees" else dict(rounds=s.rounds, depth=s.depth) if s.objective in BOOSTED else {}
    revenue = train_revenue(
        balanced, paying_buyers(val)[0], prep.features, s.horizons, s.objective, **trees
    )
    return buyer, whale, revenue


def out_of_fold_meta(run: TrainedRun, train: DataFrame, val: DataFrame, keep: list[str]) -> DataFrame:
    """Meta-features of the training rows from stages that never saw them.

    Rows fall into ``oof_folds`` parts by a hash of their id. Each part is scored
    by stages fitted on the others; a fold without whales borrows the whole run's
    whale model. Fewer than two folds score the rows with the run itself.
    """
    s = run.settings
    if s.oof_folds < 2:
        return run.meta_table(run.stage_scores(train), keep)
    fold = F.pmod(sample_key("row_id", s.seed + 1, s.portable), F.lit(s.oof_folds))
    parts = []
    for k in range(s.oof_folds):
        buyer, whale, revenue = fit_stages(train.where(fold != k), val, run.prep, s)
        other = TrainedRun(s, run.prep, buyer, whale or run.whale if run.whale else None, revenue, alpha=run.alpha)
        parts.append(run.meta_table(other.stage_scores(train.where(fold == k)), keep))
    return reduce(DataFrame.unionByName, parts)


def train_run(raw: DataFrame, settings: Settings | None = None, val_raw: DataFrame | None = None) -> TrainedRun:
    """Train every stage on labelled raw rows.

    Without ``val_raw`` the rows are split by stratum. Anchors are added to the
    training part only. Both the split and the anchors are filters and small
    tables over the raw scan; the first full copy written is the flattened one.
    The stages scan the model vectors, not the wide prepared rows.
    """
    s = deepcopy(settings) if settings else Settings()
    if val_raw is None:
        split = stratified_split(raw, s.train_fraction, s.stratify, seed=s.seed, portable=s.portable)
        train_raw = split.where("split = 'train'").drop("split")
        val_raw = split.where("split = 'val'").drop("split")
    else:
        train_raw = raw
    if s.anchors_per_hour > 0:
        train_raw = zero_anchors(train_raw, s.anchors_per_hour, seed=s.seed, portable=s.portable)

    prep, train = fit_preparation(train_raw, s.reference, s.revenue_cap, portable_hash=s.portable)
    train, val = _stage_rows(train, prep.features, "train"), _stage_rows(prep.apply(val_raw), prep.features, "val")
    run = TrainedRun(s, prep, *fit_stages(train, val, prep, s))

    needed = ["row_id", "iap_revenue_d7", "buyer_proba", "pred_d7"]
    tuning = settle(run.stage_scores(val, gated=s.tune_on_gated).select(*needed), "tuning")
    curve = alpha_curve(tuning, "buyer_proba", "pred_d7", "iap_revenue_d7")
    run.alpha = float(best_of(curve, "alpha", 1.0).first()["alpha"])

    scaled = tuning.withColumn("p", scale_probability(F.col("buyer_proba"), run.alpha))
    aligned = fit_zero_rate(scaled, "p", "iap_revenue_d7", **s.zero_rate)
    s.gating["cutoff"] = float(aligned["probability_cutoff"])
    run.zero_rate_report = aligned

    meta = settle(out_of_fold_meta(run, train, val, ["row_id", "iap_revenue_d7"]), "meta")
    names = [c for c in meta.columns if c not in ("row_id", "iap_revenue_d7")]
    run.stacking = train_stacking(meta, names, folds=s.folds, rounds=s.rounds, depth=s.depth, seed=s.seed)
    return run
