"""Probability calibration: Platt, isotonic and beta, fitted on scored rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortal.functions.scalars import clip
from cohortal.models.isotonic import isotonic_steps
from cohortal.models.base import positive_probability, stored_params
from cohortal.sources.files import write_params

METHODS = ("none", "platt", "isotonic", "beta")


def _inputs(method: str, p: Column, eps: float) -> list[Column]:
    if method == "beta":
        inside = clip(p, eps, 1.0 - eps)
        return [F.ln(inside), F.log1p(-inside)]
    return [p]


def _vector(df: DataFrame, method: str, score: str, eps: float) -> DataFrame:
    names = {f"_c{i}": c for i, c in enumerate(_inputs(method, F.col(score), eps))}
    return VectorAssembler(inputCols=list(names), outputCol="_cal").transform(df.withColumns(names)).drop(*names)


@dataclass
class Calibrator:
    """Fitted mapping of a probability; ``method='none'`` only clips to [0, 1]."""

    method: str
    epsilon: float = 1e-6
    model: Any = None

    def apply(self, df: DataFrame, score: str) -> DataFrame:
        """Replace the score column by its calibrated value in [0, 1]."""
        if self.method == "none":
            return df.withColumn(score, clip(F.col(score), 0.0, 1.0))
        columns = df.columns
        out = self.model.transform(_vector(df, self.method, score, self.epsilon))
        value = F.col("_cal_out") if self.method == "isotonic" else positive_probability("_cal_p")
        return out.withColumn(score, clip(value, 0.0, 1.0)).select(*columns)

    def save(self, path: str) -> None:
        write_params(SparkSession.active(), {"method": self.method, "epsilon": self.epsilon}, f"{path}/params")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")


def fit_calibrator(
    df: DataFrame,
    score: str,
    label: str,
    method: str = "beta",
    regularization: float = 1e-3,
    epsilon: float = 1e-6,
    max_iter: int = 200,
) -> Calibrator:
    """Fit on a scored, labelled table; a label with one class gives the identity.

    The logistic penalty is per-row in Spark, so the total penalty is divided by
    the weighted row count; classes are weighted to equal totals. The isotonic
    fit takes the scores as they are: its steps are found on the executors, and
    the model interpolates between the ends of neighbouring steps.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported calibration method: {method}")
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if method == "none" or pos in (0, n):
        return Calibrator("none", epsilon)
    weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos))))
    data = _vector(df, method, score, epsilon).select(
        "_cal", F.col(label).cast("double").alias("_y"), weight.alias("_w")
    )
    if method == "isotonic":
        steps = isotonic_steps(df.withColumn("_hit", (F.col(label) == 1).cast("double")), score, "_hit")
        ends = steps.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(score), F.col("value").alias("_y"), F.col("weight").alias("_w"))
        stairs = IsotonicRegression(featuresCol="_cal", labelCol="_y", weightCol="_w", predictionCol="_cal_out")
        fitted = stairs.fit(_vector(ends, method, score, epsilon))  # rising already, so taken over as they are
        return Calibrator(method, epsilon, fitted)
    logistic = LogisticRegression(
        featuresCol="_cal", labelCol="_y", weightCol="_w", probabilityCol="_cal_p",
        rawPredictionCol="_cal_raw", predictionCol="_cal_hard", maxIter=max_iter,
        regParam=regularization / n, elasticNetParam=0.0, standardization=False,
    )
    return Calibrator(method, epsilon, logistic.fit(data))


def load_calibrator(spark: SparkSession, path: str) -> Calibrator:
    params = stored_params(spark, path)
    method = params["method"]
    if method == "none":
        return Calibrator("none", params["epsilon"])
    kind = IsotonicRegressionModel if method == "isotonic" else LogisticRegressionModel
    return Calibrator(method, params["epsilon"], kind.load(f"{path}/model"))
