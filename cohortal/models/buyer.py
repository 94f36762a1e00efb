"""Buyer and high-value classifiers with optional probability calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.settle import settle
from cohortal.models.base import (
    positive_probability,
    stored_params,
    training_frame,
    with_validation_flag,
    with_vector,
)
from cohortal.models.boosting import BoostedTrees, Growth, Loss, fit_boosted, load_boosted
from cohortal.models.calibration import Calibrator, load_calibrator
from cohortal.operators.metrics import average_precision, roc_auc
from cohortal.operators.sampling import add_class_weight, class_ratio
from cohortal.sources.files import write_params

# Size of the production configuration, leaves as a depth.
OWN_DEFAULTS = dict(rounds=500, depth=5, rate=0.05, l1=0.3, l2=0.3, min_rows=60, row_share=0.8, feature_share=0.8)
DEFAULTS = dict(maxIter=50, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=42)


@dataclass
class BuyerModel:
    """Fitted trees, their input columns and an optional calibrator."""

    model: GBTClassificationModel | BoostedTrees
    columns: list[str]
    calibrator: Calibrator | None = None

    def score(self, df: DataFrame, name: str = "buyer_proba", raw: bool = False) -> DataFrame:
        """Add P(label = 1); ``raw`` skips the calibrator."""
        if isinstance(self.model, BoostedTrees):
            out = self.model.transform(with_vector(df, self.columns), [name]).select(*df.columns, name)
        else:
            out = self.model.transform(with_vector(df, self.columns))
            out = out.select(*df.columns, positive_probability().alias(name))
        return out if raw or self.calibrator is None else self.calibrator.apply(out, name)

    def importance(self, spark: SparkSession) -> DataFrame:
        own = isinstance(self.model, BoostedTrees)
        rows = [(c, float(w)) for c, w in zip(self.columns, self.model.importance() if own else self.model.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double")

    def metrics(self, df: DataFrame, label: str) -> DataFrame:
        """(metric, value): ROC AUC and average precision."""
        scored = self.score(df.select(label, *[c for c in self.columns if c in df.columns and c != label]))
        scored = settle(scored.select(label, "buyer_proba"), "scored")
        auc = roc_auc(scored, label, "buyer_proba")
        ap = average_precision(scored, label, "buyer_proba")
        return auc.select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")).unionByName(
            ap.select(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("value"))
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        own = isinstance(self.model, BoostedTrees)
        (self.model if own else self.model.write().overwrite()).save(f"{path}/trees")
        write_params(spark, {"columns": self.columns, "calibrated": self.calibrator is not None, "own": own}, f"{path}/params")
        if self.calibrator is not None:
            self.calibrator.save(f"{path}/calibrator")


def train_classifier(
    train: DataFrame,
    val: DataFrame | None,
    columns: Sequence[str],
    label: str = "buyer_d7",
    min_weight: float | None = None,
    patience: int | None = None,
    **params: Any,
) -> BuyerModel:
    """Boosted trees with positives weighted by the class ratio; stops early on the validation rows.

    With ``patience``, the trees are grown by ``fit_boosted`` (``params`` are
    fields of ``Growth``): the validation loss of every round is recorded,
    fitting ends after that many rounds without a new minimum, and the model
    keeps the rounds up to its minimum.
    """
    cols = list(columns)
    weight = class_ratio(train, label).first()["scale_pos_weight"]
    if min_weight is not None:
        weight = max(min_weight, weight)
    frame = lambda d: add_class_weight(
        training_frame(d, cols, [label]).withColumn(label, F.col(label).cast("double")), label, weight
    )
    both = with_validation_flag(frame(train), None if val is None else frame(val))
    if patience is not None:
        growth = Growth(**{**OWN_DEFAULTS, **params, "patience": patience})
        return BuyerModel(fit_boosted(both, [label], Loss("logistic"), growth, weight="class_weight", validation="_is_val"), cols)
    both = both.persist()
    try:
        trees = GBTClassifier(
            featuresCol="features", labelCol=label, weightCol="class_weight", **{**DEFAULTS, **params}
        )
        if val is not None:
            trees = trees.setValidationIndicatorCol("_is_val")
        return BuyerModel(trees.fit(both), cols)
    finally:
        both.unpersist()


def load_classifier(spark: SparkSession, path: str) -> BuyerModel:
    params = stored_params(spark, path)
    calibrator = load_calibrator(spark, f"{path}/calibrator") if params["calibrated"] else None
    trees = load_boosted(spark, f"{path}/trees") if params.get("own") else GBTClassificationModel.load(f"{path}/trees")
    return BuyerModel(trees, params["columns"], calibrator)
