"""Batch scoring and holdout evaluation of a trained run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortal.core.ranks import quantiles
from cohortal.core.settle import settle
from cohortal.operators.metrics import evaluate, prediction_diagnostics
from cohortal.operators.splits import hash_sample
from cohortal.plans.training import TrainedRun
from cohortal.sources.files import write_predictions
from cohortal.sources.hourly import cap_partitions, limit_rows, scan_window


def select_rows(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    max_partitions: int | None = None,
    sample_frac: float | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Window, partition cap, hash sample, then row limit."""
    df = scan_window(df, start, end)
    if max_partitions:
        df = cap_partitions(df, max_partitions)
    return limit_rows(hash_sample(df, sample_frac), rows, ("datetime", "row_id"))


def score_table(run: TrainedRun, raw: DataFrame, path: str | None = None, **chosen: object) -> DataFrame:
    """Score the chosen rows; with ``path`` also write the prediction file."""
    scored = run.score(select_rows(raw, **chosen))
    if path is not None:
        write_predictions(scored, path)
    return scored


def evaluate_holdout(run: TrainedRun, raw: DataFrame, **chosen: object) -> tuple[DataFrame, DataFrame]:
    """(metrics, diagnostics) of the run on labelled rows, both from one written scoring."""
    rows = select_rows(raw, **chosen).withColumn("truth", F.col("iap_revenue_d7"))
    scored = settle(run.score(rows, keep=("row_id", "truth")), "holdout")
    return evaluate(scored, "truth", "iap_revenue_d7", check=True), prediction_diagnostics(scored, "iap_revenue_d7")


def validate_submission(submission: DataFrame, sample: DataFrame, align: bool = False) -> DataFrame:
    """Check a prediction table against the expected ids and summarise it.

    Distributed files have no row order, so ids are compared as sets and
    checked for duplicates. ``align`` first drops unknown ids and adds missing
    ones with a null prediction.
    """
    if submission.columns != sample.columns:
        raise ValueError(f"expected columns {sample.columns}, received {submission.columns}")
    expected = sample.select("row_id")
    if align:
        submission = expected.join(submission, "row_id", "left")
    rows, distinct = submission.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()
    wanted = expected.count()
    if rows != wanted or distinct != rows:
        raise ValueError(f"{rows} rows with {distinct} distinct ids do not match the {wanted} expected")
    if not submission.join(expected, "row_id", "left_anti").isEmpty():
        raise ValueError("submission holds ids that were not asked for")
    return submission_stats(submission)


def submission_stats(submission: DataFrame, value: str = "iap_revenue_d7") -> DataFrame:
    """Rows, mean, exact median, sample std and zero share (percent of rows)."""
    middle = quantiles(submission, value, [0.5])
    return submission.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(value).alias("mean"),
        F.lit(middle[0] if middle else None).cast("double").alias("median"),
        F.stddev_samp(value).alias("std"),
        (F.lit(100.0) * F.count_if(F.col(value) == 0) / F.count(F.lit(1))).alias("zeros_pct"),
    )
