"""Distribution reports: label profile, histograms, box summaries, group means, correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cohortal.core.ranks import quantile_table, quantiles, value_counts
from cohortal.operators.moments import pairwise_correlations


def label_profile(df: DataFrame, label: str = "buyer_d7", revenue: str = "iap_revenue_d7") -> DataFrame:
    """Rows, buyers, buyer rate, mean and median revenue over all rows and over buyers."""
    over = quantiles(df, revenue, [0.5])
    paid = quantiles(df.where(F.col(label) == 1), revenue, [0.5])
    is_buyer = F.col(label) == 1
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_buyer).alias("buyers"),
        (F.avg(is_buyer.cast("double")) * 100.0).alias("buyer_rate_pct"),
        F.avg(revenue).alias("mean_revenue"),
        F.avg(F.when(is_buyer, F.col(revenue))).alias("mean_buyer_revenue"),
        F.max(revenue).alias("max_revenue"),
        F.lit(over[0] if over else None).cast("double").alias("median_revenue"),
        F.lit(paid[0] if paid else None).cast("double").alias("median_buyer_revenue"),
    )


def histogram(df: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, the last one closed; empty bins are listed too."""
    x = (F.log1p(F.col(value)) if log else F.col(value)).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.limit(0).select(
            F.lit(0).cast("bigint").alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
            F.lit(0).cast("bigint").alias("n"),
        )
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    spot = F.floor((x - F.lit(low)) / F.lit(width))
    counts = (
        df.where(x.isNotNull())
        .groupBy(F.least(F.greatest(spot, F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    edge = lambda i: F.lit(low) + i * F.lit(width)
    return every.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
    )


def box_summary(df: DataFrame, group: str, value: str, log: bool = True) -> DataFrame:
    """(group, n, q1, median, q3) of a value, by default on the log1p scale."""
    x = F.log1p(F.col(value)) if log else F.col(value)
    base = df.select(group, x.alias("_x"))
    counts = value_counts(base.select(group, F.col("_x").cast("double").alias("_x")), "_x", [group])
    found = quantile_table(base, "_x", [0.25, 0.5, 0.75], [group], counts=counts)
    at = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
    boxes = found.groupBy(group).agg(at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("n"))
    return boxes.join(sizes, group).select(group, "n", "q1", "median", "q3")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their counts, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(k)
    )


def keep_top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Rows of the k most frequent values; at most k values travel as a literal list."""
    values = [r[column] for r in top_values(df, column, k).collect()]
    return df.where(F.col(column).isin(values))


def group_means(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Row count and mean of each value per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, count, mean, std, min, q25, q50, q75, max, n_unique); exact quartiles.

    All of it comes from one settled table of counts per column and value.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    counts = value_counts(long, "value", ["column_name"])
    v, n = F.col("value"), F.col("n")
    means = counts.groupBy("column_name").agg((F.sum(v * n) / F.sum(n)).alias("mean"))
    spread = F.sum(n * (v - F.col("mean")) * (v - F.col("mean")))
    stats = (
        counts.join(F.broadcast(means), "column_name")
        .groupBy("column_name")
        .agg(
            F.sum(n).alias("count"),
            F.first("mean").alias("mean"),
            F.sqrt(spread / F.nullif(F.sum(n) - 1, F.lit(0))).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.count(F.lit(1)).alias("n_unique"),
        )
    )
    found = quantile_table(long, "value", [0.25, 0.5, 0.75], ["column_name"], counts=counts)
    at = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
    quarts = found.groupBy("column_name").agg(at(0.25, "q25"), at(0.5, "q50"), at(0.75, "q75"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return (
        named.join(stats.join(quarts, "column_name"), "column_name", "left")
        .select("column_name", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean", "std", "min",
                "q25", "q50", "q75", "max", F.coalesce("n_unique", F.lit(0)).alias("n_unique"))
    )


def pair_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both values; null if one of them does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr) of the upper triangle, each pair over the rows where both have a value.

    All pairs come from one pass that sums outer products; a pair without
    spread has no correlation (null).
    """
    cols = list(columns)
    found = pairwise_correlations(df, cols) if len(cols) > 1 else None
    rows = [
        (a, b, None if np.isnan(found[i, j]) else float(found[i, j]))
        for i, a in enumerate(cols)
        for j, b in list(enumerate(cols))[i + 1 :]
    ]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def top_importances(importances: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
