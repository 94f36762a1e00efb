"""Evaluation metrics, diagnostics and searches, each one aggregation over the predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortal.core.ranks import quantile_table, quantiles, running_totals, value_counts


def log_error(truth: Column, pred: Column) -> Column:
    """Squared difference of log1p values; negative predictions count as 0."""
    return F.pow(F.log1p(truth) - F.log1p(F.greatest(pred, F.lit(0.0))), F.lit(2.0))


def regression_metrics(truth: Column, pred: Column) -> list[Column]:
    """msle, rmsle, rmse, mae, mape (percent over nonzero truth) and r2."""
    err = truth - pred
    sse = F.sum(err * err)
    paired = F.when(err.isNotNull(), truth)
    sst = F.var_pop(paired) * F.count(paired)
    msle = F.avg(log_error(truth, pred))
    return [
        msle.alias("msle"),
        F.sqrt(msle).alias("rmsle"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.coalesce(F.avg(F.when(truth != 0, F.abs(err / F.nullif(truth, F.lit(0.0))))) * 100.0, F.lit(0.0)).alias("mape"),
        F.coalesce(F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0)), F.lit(0.0)).alias("r2"),
    ]


def check_inputs(df: DataFrame, truth: str, pred: str) -> None:
    """ValueError unless every truth and prediction is a finite number and no truth is negative."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = df.agg(F.count_if(odd(y)), F.count_if(odd(p)), F.count_if(y < 0)).first()
    if any(found):
        raise ValueError(f"{found[0]} truths and {found[1]} predictions are not finite, {found[2]} truths are negative")


def evaluate(df: DataFrame, truth: str, pred: str, by: Sequence[str] = (), check: bool = False) -> DataFrame:
    """All regression metrics, per group if asked; ``check`` refuses inputs that would hide in an average."""
    if check:
        check_inputs(df, truth, pred)
    return df.groupBy(*by).agg(*regression_metrics(F.col(truth), F.col(pred)))


def zero_baseline(df: DataFrame, truth: str) -> DataFrame:
    """Metrics of predicting 0 everywhere."""
    return df.agg(*regression_metrics(F.col(truth), F.lit(0.0)))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    positive = (F.col(label) == 1).cast("bigint")
    return value_counts(df, score, weights={"pos": positive, "neg": F.lit(1).cast("bigint") - positive})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve: rank sum with average ties over distinct scores."""
    run = running_totals(_score_counts(df, label, score), score, ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return run.agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the recall gained at each distinct score, best score first."""
    run = running_totals(_score_counts(df, label, score), score, ["pos", "n"])
    at_least = lambda t: F.col(f"{t}_all") - F.col(f"{t}_upto") + F.col(t)
    gained = F.sum(F.col("pos") * at_least("pos") / at_least("n"))
    return run.agg((gained / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def huber(truth: Column, pred: Column, delta: float = 1.0) -> Column:
    """Quadratic near 0, linear beyond delta."""
    gap = F.abs(truth - pred)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))


def order_huber_loss(
    df: DataFrame,
    truth: Sequence[str],
    pred: Sequence[str],
    weights: Sequence[float] = (0.3, 0.5, 0.2),
    order_weight: float = 0.1,
    delta: float = 1.0,
) -> DataFrame:
    """Weighted Huber loss over horizons plus a penalty for a later horizon below an earlier one."""
    hubers = [F.avg(huber(F.col(t), F.col(p), delta)) for t, p in zip(truth, pred)]
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * h for w, h in zip(weights, hubers)])
    drops = [F.greatest(F.col(a) - F.col(b), F.lit(0.0)) for a, b in zip(pred, pred[1:])]
    penalty = F.avg(reduce(lambda a, b: a + b, [d * d for d in drops]))
    return df.agg(
        total.alias("huber_total"),
        penalty.alias("order_penalty"),
        (total + F.lit(float(order_weight)) * penalty).alias("loss"),
    )


def prediction_diagnostics(df: DataFrame, pred: str) -> DataFrame:
    """Mean, population std, range, zero share, distinct rounded values and median of predictions."""
    middle = quantiles(df, pred, [0.5])
    zeros = F.count_if(F.col(pred) == 0)
    return df.agg(
        F.count(pred).alias("rows"),
        F.avg(pred).alias("mean"),
        F.stddev_pop(pred).alias("std"),
        F.min(pred).alias("min"),
        F.max(pred).alias("max"),
        zeros.alias("zeros"),
        (F.lit(100.0) * zeros / F.count(pred)).alias("zeros_pct"),
        F.count_distinct(F.round(pred, 2)).alias("unique_rounded"),
        F.lit(middle[0] if middle else None).cast("double").alias("median"),
    )


def horizon_report(df: DataFrame, horizons: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(horizon, mean and median actual/predicted, rmsle, rmse, mae) from one long aggregation."""
    pairs = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(t).alias("actual"), F.col(p).alias("predicted"))
            for h, (t, p) in horizons.items()
        ]
    )
    long = df.select(F.inline(pairs))
    keep = ("rmsle", "rmse", "mae")
    measured = [c for c in regression_metrics(F.col("actual"), F.col("predicted"))]
    stats = long.groupBy("horizon").agg(
        F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted"), *measured
    ).select("horizon", "mean_actual", "mean_predicted", *keep)
    mid = lambda c: quantile_table(long, c, [0.5], ["horizon"]).select(
        "horizon", F.col("quantile").alias(f"median_{c}")
    )
    return stats.join(mid("actual"), "horizon").join(mid("predicted"), "horizon")
