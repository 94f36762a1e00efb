"""Searches for gate settings: every candidate is scored in one scan of the predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cohortal.core.ranks import quantiles
from cohortal.functions.scalars import bin_right_open


def _loss(metric: str, truth: Column, pred: Column) -> Column:
    if metric == "rmsle":
        return F.pow(F.log1p(truth) - F.log1p(pred), F.lit(2.0))
    if metric == "rmse":
        return F.pow(truth - pred, F.lit(2.0))
    if metric == "mae":
        return F.abs(truth - pred)
    raise ValueError(f"unknown metric: {metric}")


def _finish(metric: str, mean_loss: Column) -> Column:
    return mean_loss if metric == "mae" else F.sqrt(mean_loss)


def alpha_curve(
    df: DataFrame, p: str, revenue: str, truth: str, metric: str = "rmsle", steps: int = 100
) -> DataFrame:
    """(alpha, metric) of p**alpha * revenue for exponents on [0.1, 3.0].

    The literal grid is expanded inside the scan's own pipeline and summed on
    the map side, so the shuffle carries one short row per exponent and task.
    """
    grid = F.array(*[F.lit(float(a)) for a in np.linspace(0.1, 3.0, steps)])
    rows = df.select(
        F.col(p).alias("_p"), F.col(revenue).alias("_r"), F.col(truth).alias("_y"), F.explode(grid).alias("alpha")
    )
    loss = _loss(metric, F.col("_y"), F.pow(F.col("_p"), F.col("alpha")) * F.col("_r"))
    return rows.groupBy("alpha").agg(_finish(metric, F.avg(loss)).alias("metric"))


def threshold_curve(
    df: DataFrame,
    p: str,
    revenue: str,
    truth: str,
    metric: str = "rmsle",
    steps: int = 100,
    span: tuple[float, float] = (0.01, 0.99),
) -> DataFrame:
    """(threshold, metric) of revenue where p >= threshold, else 0.

    A row only needs the number of thresholds it passes. Losses are summed per
    that number (at most steps + 1 groups) and accumulated over it.
    """
    grid = [float(t) for t in np.linspace(*span, steps)]
    sums = (
        df.select(
            bin_right_open(F.col(p), grid).alias("passed"),
            _loss(metric, F.col(truth), F.col(revenue)).alias("on"),
            _loss(metric, F.col(truth), F.lit(0.0)).alias("off"),
        )
        .groupBy("passed")
        .agg(F.sum("on").alias("on"), F.sum("off").alias("off"), F.count(F.lit(1)).alias("n"))
    )
    steps_table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])
    long = sums.select("passed", "on", "off", "n", F.inline(steps_table))
    kept = F.sum(F.when(F.col("passed") > F.col("i"), F.col("on")).otherwise(F.col("off")))
    return long.groupBy("threshold").agg(_finish(metric, kept / F.sum("n")).alias("metric"))


def best_of(curve: DataFrame, setting: str, baseline: float) -> DataFrame:
    """First minimum of a curve and its improvement over the setting nearest to the baseline."""
    best = F.min(F.struct("metric", setting))
    near = F.min_by("metric", F.struct(F.abs(F.col(setting) - F.lit(baseline)), F.col(setting)))
    return curve.agg(best.alias("_b"), near.alias("baseline_metric")).select(
        F.col(f"_b.{setting}").alias(setting),
        F.col("_b.metric").alias("metric"),
        "baseline_metric",
        ((F.col("baseline_metric") - F.col("_b.metric")) / F.col("baseline_metric") * 100.0).alias("improvement_pct"),
    )


def fit_zero_rate(
    df: DataFrame,
    p: str,
    revenue: str,
    target: float | None = None,
    low: float = 0.0,
    high: float = 0.2,
    tolerance: float = 0.005,
) -> dict[str, float | bool]:
    """Probability cut-off that makes the predicted zero share meet a target share."""
    observed = df.agg(F.avg((F.col(revenue) == 0).cast("double"))).first()[0] or 0.0
    aim = observed if target is None else float(target)
    found = quantiles(df, p, [min(max(aim, 0.0), 0.9999)])
    cut = min(max(found[0] if found else 0.0, low), high)
    predicted = df.agg(F.avg((F.col(p) <= F.lit(cut)).cast("double"))).first()[0] or 0.0
    return {
        "probability_cutoff": cut,
        "target_zero_rate": aim,
        "observed_zero_rate": observed,
        "predicted_zero_rate": predicted,
        "within_tolerance": abs(predicted - aim) <= tolerance,
    }
