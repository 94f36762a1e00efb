"""Isotonic regression on unrounded scores: pool violators per range slice, then merge slices pairwise upwards.

Equal scores are one weighted point. Points are range-partitioned, each slice
pools its own adjacent violators as its rows stream by, and neighbouring slices
are merged group by group on the executors. What is left is the final steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortal.core.settle import discard, settle

FAN = 16  # neighbouring slices merged by one task
STEPS = "slice int, low double, high double, total double, weight double"
_NAMES = ["slice", "low", "high", "total", "weight"]


class Stack:
    """Steps so far, means rising strictly: a new step pools with those before it while its mean is no greater."""

    def __init__(self) -> None:
        self.steps: list[list[float]] = []  # low, high, total, weight

    def add(self, low: float, high: float, total: float, weight: float) -> None:
        steps = self.steps
        while steps and steps[-1][2] * weight >= total * steps[-1][3]:
            before = steps.pop()
            low, total, weight = before[0], before[2] + total, before[3] + weight
        steps.append([low, high, total, weight])

    def batch(self, number: int) -> pa.RecordBatch:
        columns = list(zip(*self.steps)) if self.steps else [()] * 4
        arrays = [pa.array([number] * len(self.steps), pa.int32()), *(pa.array(list(c), pa.float64()) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def isotonic_steps(df: DataFrame, score: str, label: str, weight: str | None = None, slices: int | None = None) -> DataFrame:
    """Settled (low, high, value, weight) of the non-decreasing least-squares fit, one row per step, by score.

    A step covers the scores from ``low`` to ``high``; neighbouring steps differ
    in value. Rows with a null or NaN score, label or weight, or a weight of 0
    or less, are left out; an empty table has no steps. ``slices`` is the number
    of ranges (default: the session's shuffle partitions).
    """
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select((x + 0.0).alias("low"), (w * y).alias("total"), w.alias("weight")).where(
        "low IS NOT NULL AND NOT isnan(low) AND total IS NOT NULL AND NOT isnan(total) AND weight > 0"
    )
    points = settle(rows.groupBy("low").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")), "points")
    ranged = points.repartitionByRange(*([slices] if slices else []), "low").sortWithinPartitions("low")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, number = Stack(), 0
        for batch in batches:
            number = batch.column(3)[0].as_py()
            for low, total, weight_ in zip(*(batch.column(k).to_pylist() for k in range(3))):
                stack.add(low, low, total, weight_)
        yield stack.batch(number)

    numbered = ranged.select("low", "total", "weight", F.spark_partition_id().alias("slice"))
    steps = settle(numbered.mapInArrow(pool, STEPS), "steps")
    discard(points)

    def merge(group: pa.Table) -> pa.Table:
        stack = Stack()
        group = group.sort_by("low")
        for row in zip(*(group.column(n).to_pylist() for n in _NAMES[1:])):
            stack.add(*row)
        return pa.Table.from_batches([stack.batch(group.column("slice")[0].as_py() // FAN)])

    while (steps.agg(F.max("slice")).first()[0] or 0) > 0:
        merged = settle(steps.groupBy(F.floor(F.col("slice") / FAN).alias("_group")).applyInArrow(merge, STEPS), "steps")
        discard(steps)
        steps = merged
    return steps.select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")
