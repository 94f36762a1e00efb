"""Revenue regression for several horizons, one independent model each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.functions.gates import enforce_order
from cohortal.functions.scalars import clip
from cohortal.models.boosting import BoostedTrees, Growth, Loss, fit_boosted, load_boosted
from cohortal.models.base import stored_params, training_frame, with_validation_flag, with_vector
from cohortal.sources.files import write_params

HORIZONS = (1, 7, 14)
OBJECTIVES = ("log_trees", "tweedie", "huber", "tweedie_linear", "huber_linear")
# Losses and tree sizes of the production and the test configuration.
BOOSTED = {
    "tweedie": (
        Loss("tweedie", power=1.1),
        Growth(rounds=1000, depth=6, rate=0.015, l1=0.5, l2=0.5, min_rows=20, max_step=5.0, row_share=0.7, feature_share=0.7, patience=100),
    ),
    "huber": (Loss("huber", delta=0.9), Growth(rounds=50, depth=4, rate=0.1, l2=0.0, row_share=0.7, feature_share=0.7, patience=10)),
}


def _fit_one(objective: str, data: DataFrame, with_val: bool, params: dict[str, Any]) -> Any:
    if objective == "log_trees":
        settings = dict(maxIter=50, maxDepth=5, stepSize=0.1, subsamplingRate=0.7, seed=42) | params
        trees = GBTRegressor(featuresCol="features", labelCol="_log", predictionCol="_out", **settings)
        return (trees.setValidationIndicatorCol("_is_val") if with_val else trees).fit(data)
    data = data.where("NOT _is_val")
    if objective == "tweedie_linear":
        settings = dict(variancePower=1.1, linkPower=0.0, regParam=0.5, maxIter=25) | params
        return GeneralizedLinearRegression(
            family="tweedie", featuresCol="features", labelCol="_y", predictionCol="_out",
            linkPredictionCol="_link", **settings
        ).fit(data)
    settings = dict(loss="huber", epsilon=1.35, regParam=0.1, maxIter=100) | params
    return LinearRegression(featuresCol="features", labelCol="_y", predictionCol="_out", **settings).fit(data)


@dataclass
class RevenueModel:
    """Fitted model per horizon; predictions are never negative.

    Boosted objectives keep all horizons in ``boosted``; ``models`` then names each horizon's place in it.
    """

    models: dict[int, Any]
    columns: list[str]
    objective: str
    boosted: BoostedTrees | None = None

    def score(
        self, df: DataFrame, prefix: str = "pred", ordered: bool = True, max_log_mean: float | None = None
    ) -> DataFrame:
        """Add ``<prefix>_d<N>`` per horizon, raised to non-decreasing order if asked.

        ``max_log_mean`` bounds the Tweedie link; without it an outlying row may be infinite.
        """
        out = with_vector(df, self.columns)
        if self.boosted is not None:
            names = [f"{prefix}_d{days}" for days in sorted(self.models)]
            out = self.boosted.transform(out, names).select(*df.columns, *[clip(F.col(n), 0.0).alias(n) for n in names])
            return enforce_order(out, names) if ordered else out
        names = []
        for days, model in sorted(self.models.items()):
            if self.objective == "log_trees":
                value = F.expm1(F.col("_out"))
            elif self.objective == "tweedie_linear":
                link = F.col("_link")
                value = F.exp(link if max_log_mean is None else F.least(link, F.lit(max_log_mean)))
            else:
                value = F.col("_out")
            names.append(f"{prefix}_d{days}")
            out = model.transform(out).select(*out.columns, clip(value, 0.0).alias(names[-1]))
        out = out.select(*df.columns, *names)
        return enforce_order(out, names) if ordered else out

    def save(self, path: str) -> None:
        if self.boosted is not None:
            self.boosted.save(f"{path}/boosted")
        for days, model in self.models.items() if self.boosted is None else ():
            model.write().overwrite().save(f"{path}/d{days}")
        payload = {"columns": self.columns, "objective": self.objective, "horizons": sorted(self.models)}
        write_params(SparkSession.active(), payload, f"{path}/params")


def train_revenue(
    train: DataFrame,
    val: DataFrame | None,
    columns: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    objective: str = "log_trees",
    **params: Any,
) -> RevenueModel:
    """Fit every horizon whose target column exists; rows are buyers with known revenue.

    ``log_trees`` boosts squared errors of log1p revenue; ``tweedie`` and
    ``huber`` boost those losses, all horizons together, with ``params`` as
    fields of ``Growth``, and keep each horizon's best round if there are
    validation rows; the two linear objectives fit one linear model each.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective: {objective}")
    cols = list(columns)
    present = [h for h in horizons if f"iap_revenue_d{h}" in train.columns]
    if not present:
        raise ValueError("no revenue target column")
    targets = [f"iap_revenue_d{h}" for h in present]
    frame = lambda d: training_frame(d, cols, targets)
    if objective in BOOSTED:
        loss, growth = BOOSTED[objective]
        data = with_validation_flag(frame(train), None if val is None else frame(val))
        data = data.withColumns({t: F.greatest(F.col(t).cast("double"), F.when(F.col(t).isNotNull(), F.lit(0.0))) for t in targets})
        order = sorted(present)
        boosted = fit_boosted(data, [f"iap_revenue_d{h}" for h in order], loss, replace(growth, **params), validation="_is_val")
        return RevenueModel({h: k for k, h in enumerate(order)}, cols, objective, boosted)
    both = with_validation_flag(frame(train), None if val is None else frame(val)).persist()
    try:
        models = {}
        for days, target in zip(present, targets):
            y = F.greatest(F.col(target).cast("double"), F.lit(0.0))
            data = both.where(F.col(target).isNotNull()).select(
                "features", "_is_val", y.alias("_y"), F.log1p(y).alias("_log")
            )
            models[days] = _fit_one(objective, data, val is not None, params)
        return RevenueModel(models, cols, objective)
    finally:
        both.unpersist()


def load_revenue(spark: SparkSession, path: str) -> RevenueModel:
    params = stored_params(spark, path)
    if params["objective"] in BOOSTED:
        places = {h: k for k, h in enumerate(params["horizons"])}
        return RevenueModel(places, params["columns"], params["objective"], load_boosted(spark, f"{path}/boosted"))
    kind = {
        "log_trees": GBTRegressionModel,
        "tweedie_linear": GeneralizedLinearRegressionModel,
        "huber_linear": LinearRegressionModel,
    }[params["objective"]]
    models = {h: kind.load(f"{path}/d{h}") for h in params["horizons"]}
    return RevenueModel(models, params["columns"], params["objective"])
