"""Stacking: out-of-fold base predictions feed a boosted meta-learner."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.settle import settle
from cohortal.functions.scalars import clip
from cohortal.models.base import stored_params, training_frame, with_vector
from cohortal.sources.files import write_params

AT_ONCE = 2  # base models that are fitted at the same time; each keeps its own copy of its rows

LOADERS = {
    "elastic_net": LinearRegressionModel,
    "forest": RandomForestRegressionModel,
    "boosting": GBTRegressionModel,
}


def base_estimators(rounds: int = 20, depth: int = 5, seed: int = 42) -> dict[str, Any]:
    common = dict(featuresCol="features", labelCol="_y")
    return {
        "elastic_net": LinearRegression(regParam=0.6, elasticNetParam=0.7, maxIter=100, **common),
        "forest": RandomForestRegressor(numTrees=rounds, maxDepth=depth, seed=seed, **common),
        "boosting": GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed, **common),
    }


def _fit_bases(data: DataFrame, folds: int, rounds: int, depth: int, seed: int) -> dict[int | None, dict[str, Any]]:
    """Per fold the base models that did not see it, and under None those of all rows.

    The fits do not depend on each other. Where one is between two stages or in
    a last wave of tasks, another uses the cores, as in Spark's cross-validator.
    """

    def fit(k: int | None, name: str) -> tuple[int | None, str, Any]:
        estimator = base_estimators(rounds, depth, seed)[name]
        return k, name, estimator.fit(data if k is None else data.where(F.col("_fold") != k))

    names = list(base_estimators(rounds, depth, seed))
    bound = inheritable_thread_target(data.sparkSession)
    tasks = [bound(lambda k=k, name=name: fit(k, name)) for k in (*range(folds), None) for name in reversed(names)]
    models: dict[int | None, dict[str, Any]] = {k: dict.fromkeys(names) for k in (*range(folds), None)}
    with ThreadPool(AT_ONCE) as pool:
        for k, name, model in pool.imap_unordered(lambda task: task(), tasks):
            models[k][name] = model
    return models


def _predict_all(df: DataFrame, models: dict[str, Any]) -> DataFrame:
    for name, model in models.items():
        df = model.transform(df).withColumnRenamed("prediction", f"base_{name}")
    return df


@dataclass
class StackingModel:
    bases: dict[str, Any]
    meta: GBTRegressionModel
    columns: list[str]

    def score(self, df: DataFrame, name: str = "stacked") -> DataFrame:
        """Add the stacked prediction, clipped at 0."""
        bases = [f"base_{b}" for b in self.bases]
        out = _predict_all(with_vector(df, self.columns), self.bases).select(*df.columns, *bases)
        out = self.meta.transform(with_vector(out, bases))
        return out.select(*df.columns, clip(F.col("prediction"), 0.0).alias(name))

    def save(self, path: str) -> None:
        for name, model in self.bases.items():
            model.write().overwrite().save(f"{path}/{name}")
        self.meta.write().overwrite().save(f"{path}/meta")
        write_params(SparkSession.active(), {"columns": self.columns, "bases": list(self.bases)}, f"{path}/params")


def train_stacking(
    df: DataFrame,
    columns: Sequence[str],
    target: str = "iap_revenue_d7",
    ident: str = "row_id",
    folds: int = 5,
    rounds: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> StackingModel:
    """Each fold is scored by base models that did not see it; the bases are then refitted on all rows.

    Folds come from a hash of the row identifier. The feature table is written
    once and every fit scans it, a few fits at the same time; scored folds are
    written before the meta fit.
    """
    cols = list(columns)
    fold = F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(folds)).cast("int")
    labelled = df.withColumns({"_y": F.col(target).cast("double"), "_fold": fold})
    data = settle(training_frame(labelled, cols, ["_y", "_fold"]), "stack").persist()
    try:
        models = _fit_bases(data, folds, rounds, depth, seed)
        parts = [_predict_all(data.where(F.col("_fold") == k), models[k]) for k in range(folds)]
        bases = [f"base_{n}" for n in models[None]]
        held_out = settle(reduce(DataFrame.unionByName, parts).select("_y", *bases), "folds")
        meta = GBTRegressor(featuresCol="features", labelCol="_y", maxIter=rounds, maxDepth=3, seed=seed)
        fitted_meta = meta.fit(training_frame(held_out, bases, ["_y"]))
        return StackingModel(models[None], fitted_meta, cols)
    finally:
        data.unpersist()


def load_stacking(spark: SparkSession, path: str) -> StackingModel:
    params = stored_params(spark, path)
    bases = {b: LOADERS[b].load(f"{path}/{b}") for b in params["bases"]}
    return StackingModel(bases, GBTRegressionModel.load(f"{path}/meta"), params["columns"])
