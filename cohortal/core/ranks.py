"""Exact ranks, quantiles and cut-offs over tables of any size and skew.

Everything starts from counts per distinct value, which Spark combines on the
map side, so repeated values (the zeros of a revenue column) cost one row.
Small count tables are ranked by one window; larger ones are range-partitioned
and each slice adds the total of the slices before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortal.core.keys import KEY_BITS
from cohortal.core.lookup import lookup
from cohortal.core.settle import settle

WINDOW_ROWS = 500_000
EDGE_ROWS = 200_000
TOP_ROWS = 10_000  # up to so many first rows are taken as one top-k


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None
) -> DataFrame:
    """Settled table (by…, value, n, weight sums…) without null values."""
    sums = [F.sum(w).alias(name) for name, w in (weights or {}).items()]
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n"), *sums
    )
    return settle(counted, "counts")


def running_totals(
    counts: DataFrame,
    order: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    window_rows: int | None = None,
) -> DataFrame:
    """Add ``<name>_upto``, the sum over rows ordered up to this one, and ``<name>_all``, the group's sum.

    ``counts`` is settled and unique in (by, order). Up to ``window_rows`` rows
    one window does it. Beyond that the table is cut into range slices: slice
    totals (one row per group and slice) give each slice its offset.
    """
    by = list(by)
    limit = WINDOW_ROWS if window_rows is None else window_rows
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if counts.count() <= limit:
        whole = Window.partitionBy(*by)
        return counts.select(
            *counts.columns,
            *[F.sum(t).over(running).alias(f"{t}_upto") for t in totals],
            *[F.sum(t).over(whole).alias(f"{t}_all") for t in totals],
        )

    sliced = settle(
        counts.repartitionByRange(*by, order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    per_slice = sliced.groupBy(*by, "_slice").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_before_{t}") for t in totals],
        *[F.sum(f"_sum_{t}").over(group).alias(f"{t}_all") for t in totals],
    )
    joined = lookup(
        sliced, settle(offsets, "offsets"), [*by, "_slice"], spread=[*by, order], skewed=False
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *counts.columns,
        *[(F.sum(t).over(inside) + F.col(f"_before_{t}")).alias(f"{t}_upto") for t in totals],
        *[f"{t}_all" for t in totals],
    )


def nth_values(
    counts: DataFrame, value: str, positions: Sequence[int], window_rows: int | None = None
) -> dict[int, object]:
    """Values at 0-based positions of the sorted column; one row per position returns."""
    wanted = sorted(set(int(p) for p in positions))
    run = running_totals(counts, value, ["n"], window_rows=window_rows)
    hits = run.select(
        value,
        F.explode(
            F.filter(
                F.array(*[F.lit(p).cast("bigint") for p in wanted]),
                lambda p: (p < F.col("n_upto")) & (p >= F.col("n_upto") - F.col("n")),
            )
        ).alias("_pos"),
    )
    return {r["_pos"]: r[value] for r in hits.collect()}


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], window_rows: int | None = None
) -> list[float] | None:
    """Exact linearly interpolated quantiles of a numeric column; None if it has no values.

    The two values around each quantile are found by rank and interpolated here,
    with the same formula at every size.
    """
    numeric = df.select(F.col(value).cast("double").alias(value))
    counts = value_counts(numeric, value)
    distinct, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not distinct:
        return None
    spots = [p * (total - 1) for p in probs]
    ends = [(math.floor(s), math.ceil(s)) for s in spots]
    at = nth_values(counts, value, [e for pair in ends for e in pair], window_rows)
    return [
        float(at[lo]) + (float(at[hi]) - float(at[lo])) * (s - lo)
        for s, (lo, hi) in zip(spots, ends)
    ]


def quantile_table(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str],
    window_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles per group as rows (by…, prob, quantile); ``counts`` are the value's counts if there are any."""
    by = list(by)
    if counts is None:
        counts = value_counts(df.select(*by, F.col(value).cast("double").alias(value)), value, by)
    run = running_totals(counts, value, ["n"], by, window_rows)
    spot = lambda p: p * (F.col("n_all") - 1)
    inside = lambda pos: (pos < F.col("n_upto")) & (pos >= F.col("n_upto") - F.col("n"))
    ends = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                end(spot(F.lit(float(p)))).cast("bigint").alias("pos"),
                F.lit(side).alias("side"),
                (spot(F.lit(float(p))) - F.floor(spot(F.lit(float(p))))).alias("part"),
            )
            for p in probs
            for side, end in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    hits = run.select(*by, value, F.explode(F.filter(ends, lambda e: inside(e["pos"]))).alias("_e"))
    low = F.max(F.when(F.col("_e.side") == "lo", F.col(value)))
    high = F.max(F.when(F.col("_e.side") == "hi", F.col(value)))
    return hits.groupBy(*by, F.col("_e.prob").alias("prob")).agg(
        (low + (high - low) * F.max("_e.part")).alias("quantile")
    )


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in the order of ``order`` (nulls first), whose last column identifies a row.

    A few rows are taken as a top-k. For more, the n-th key is found from counts
    per value, one column after the other, and the rows are filtered in place.
    """
    if n <= TOP_ROWS:
        return df.orderBy(*order).limit(n)
    before, same, left = F.lit(False), F.lit(True), n
    for name in order:
        rows = df.where(same).select(name)
        nulls = rows.where(F.col(name).isNull()).count()
        if left <= nulls:
            same = same & F.col(name).isNull()
            continue
        counts = value_counts(rows, name)
        total = counts.agg(F.sum("n")).first()[0] or 0
        if left > nulls + total:
            return df.where(before | same)
        left -= nulls
        edge = nth_values(counts, name, [left - 1])[left - 1]
        left -= counts.where(F.col(name) < F.lit(edge)).agg(F.sum("n")).first()[0] or 0
        before = before | (same & (F.col(name).isNull() | (F.col(name) < F.lit(edge))))
        same = same & (F.col(name) == F.lit(edge))
    return df.where(before | same)


def cut_per_group(
    df: DataFrame,
    by: Sequence[str],
    key: Column,
    ident: str,
    want: Callable[[Column], Column],
    bits: int | None = None,
) -> DataFrame:
    """Flag (column ``picked``) the ``want(size)`` rows of each group with the lowest (key, ident).

    Narrow passes find each group's exact cut-off: group sizes, then, when the
    largest group exceeds EDGE_ROWS, counts per key prefix, then the order inside
    the one prefix where the cut falls (one row in 2**bits of the group). The
    rows themselves are filtered in place, not shuffled. ``ident`` is unique.
    """
    groups = list(by) or ["_all"]
    source = df if by else df.withColumn("_all", F.lit(0))
    sizes = settle(source.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    if bits is None:
        largest = sizes.agg(F.max("n")).first()[0] or 1
        bits = min(KEY_BITS, max(0, math.ceil(math.log2(largest / EDGE_ROWS))))
    keyed = source.withColumn("_key", key).withColumn(
        "_prefix", F.shiftright(F.col("_key"), KEY_BITS - bits).cast("bigint")
    )
    goal = lambda n: F.least(want(n).cast("bigint"), n)
    if bits == 0:
        edge = sizes.select(
            *groups, F.lit(0).alias("_edge"), goal(F.col("n")).alias("_rest")
        ).where(F.col("_rest") > 0)
    else:
        per_prefix = settle(
            keyed.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("n")), "prefixes"
        )
        run = running_totals(per_prefix, "_prefix", ["n"], groups)
        before = F.col("n_upto") - F.col("n")
        sized = run.withColumn("_want", goal(F.col("n_all")))
        edge = settle(
            sized.where((F.col("_want") > before) & (F.col("_want") <= F.col("n_upto"))).select(
                *groups, F.col("_prefix").alias("_edge"), (F.col("_want") - before).alias("_rest")
            ),
            "edges",
        )
    narrow = keyed.select(*groups, "_key", "_prefix", ident)
    at_edge = lookup(narrow, edge, groups, spread=ident, how="inner").where(F.col("_prefix") == F.col("_edge"))
    order = Window.partitionBy(*groups, "_prefix").orderBy("_key", ident)
    cuts = settle(
        at_edge.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == F.col("_rest"))
        .select(*groups, F.col("_key").alias("_cut_key"), F.col(ident).alias("_cut_id")),
        "cuts",
    )
    below = (F.col("_key") < F.col("_cut_key")) | (
        (F.col("_key") == F.col("_cut_key")) & (F.col(ident) <= F.col("_cut_id"))
    )
    return (
        lookup(keyed, cuts, groups, spread=ident)
        .withColumn("picked", F.coalesce(below, F.lit(False)))
        .drop("_key", "_prefix", "_cut_key", "_cut_id", "_all")
    )
