"""Rebalancing of heavy-tailed targets, label weights and target transforms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from cohortal.core.keys import sample_key
from cohortal.core.lookup import lookup
from cohortal.core.ranks import cut_per_group, quantiles
from cohortal.core.settle import settle
from cohortal.functions.scalars import bin_right_open, clip


@dataclass
class TargetBins:
    """Fitted bins of a target: edges and, per 1-based bin, the number of rows."""

    column: str
    edges: list[float]
    counts: list[int]
    close_last: bool
    log: bool = False

    def bin_of(self) -> Column:
        """1-based bin of a row; with open last bin the maximum falls outside (= len(edges))."""
        value = F.col(self.column).cast("double")
        found = bin_right_open(F.log1p(value) if self.log else value, self.edges)
        last = len(self.edges) - 1
        return F.least(found, F.lit(last)) if self.close_last and last > 0 else found

    def target(self, percentile: float) -> float:
        return float(np.percentile(self.counts, percentile)) if self.counts else 0.0


def fit_bins(
    df: DataFrame,
    column: str,
    n_bins: int = 30,
    binning: str = "quantile",
    numpy_compat: bool = False,
    log: bool = False,
) -> TargetBins:
    """Bin a target by quantiles (distinct edges) or by equal width.

    ``numpy_compat`` leaves the last bin open, so the maximum belongs to no bin.
    Only edges and at most ``n_bins`` counts reach the driver.
    """
    value = F.log1p(F.col(column)) if log else F.col(column).cast("double")
    if binning == "quantile":
        found = quantiles(df.select(value.alias(column)), column, [i / n_bins for i in range(n_bins + 1)])
    else:
        low, high = df.agg(F.min(value), F.max(value)).first()
        found = None if low is None else list(np.linspace(low, high, n_bins + 1))
    edges = sorted(set(found or []))
    fitted = TargetBins(column, edges, [], not numpy_compat, log)
    seen = {r["_bin"]: r["n"] for r in df.groupBy(fitted.bin_of().alias("_bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted.counts = [seen.get(i, 0) for i in range(1, len(edges))]
    return fitted


def copies_by_bin(bins: TargetBins, percentile: float = 75.0) -> dict[int, int]:
    """Copies a row of each bin gets so that rare bins approach the target count."""
    goal = bins.target(percentile)
    return {i + 1: max(1, int(goal / n)) if n else 1 for i, n in enumerate(bins.counts)}


def _per_bin(bins: TargetBins, amounts: dict[int, int], default: int) -> Column:
    chosen = F.lit(default)
    for b, amount in amounts.items():
        if amount != default:
            chosen = F.when(bins.bin_of() == b, F.lit(amount)).otherwise(chosen)
    return chosen


def repeat_rows(df: DataFrame, copies: Column) -> DataFrame:
    """Emit each row ``copies`` times, numbered from 1 in ``copy_no``."""
    return df.select("*", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy_no"))


def oversample_bins(df: DataFrame, bins: TargetBins, percentile: float = 75.0) -> DataFrame:
    """Histogram oversampling: rows of rare bins are repeated, none is removed."""
    return repeat_rows(df, _per_bin(bins, copies_by_bin(bins, percentile), 1))


def undersample_bins(
    df: DataFrame,
    bins: TargetBins,
    percentile: float = 25.0,
    ident: str = "row_id",
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Histogram undersampling: bins above the target keep exactly int(target) pseudo-random rows.

    Whole rows are drawn once, so every horizon of a row stays aligned. A target
    without bins is returned unchanged; a target below 1 keeps one row per bin.
    With an open last bin, rows beyond it are dropped.
    """
    if not bins.counts:
        return df
    goal = bins.target(percentile)
    last = len(bins.counts)
    binned = df.withColumn("_bin", bins.bin_of())
    if not bins.close_last:
        binned = binned.where(F.col("_bin").between(1, last))
    full = [i + 1 for i, n in enumerate(bins.counts) if n > goal]
    if not full:
        return binned.drop("_bin")
    keep_n = max(1, int(goal))
    crowded = F.col("_bin").isin(full)
    cut = cut_per_group(
        binned.withColumn("_group", F.when(crowded, F.col("_bin")).otherwise(F.lit(-1))),
        ["_group"],
        sample_key(ident, seed, portable),
        ident,
        lambda n: F.lit(keep_n),
    )
    return cut.where(F.col("picked") | (F.col("_group") == -1)).drop("_bin", "_group", "picked")


def zero_anchors(
    df: DataFrame,
    rows_per_hour: int = 2,
    revenue: str = "iap_revenue_d7",
    label: str = "buyer_d7",
    ident: str = "row_id",
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Append ``rows_per_hour`` zero-revenue rows per datetime.

    Zero rows of the hour are drawn (repeated when too few). An hour without any
    gives ordinary rows with every numeric column set to 0. New identifiers end
    in ``_za<i>``. Rows are ranked on identifiers only, with the row-number limit
    applied before the shuffle; the few chosen rows are then fetched by a join.
    """
    if rows_per_hour <= 0 or "datetime" not in df.columns:
        return df
    ids = df.select(
        ident,
        "datetime",
        F.coalesce((F.col(revenue) == 0).cast("int"), F.lit(0)).alias("_zero"),
        sample_key(ident, seed, portable).alias("_key"),
    )
    order = Window.partitionBy("datetime").orderBy(F.desc("_zero"), "_key", ident)
    firsts = settle(
        ids.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= rows_per_hour).drop("_key"),
        "anchors",
    )
    hours = firsts.groupBy("datetime").agg(
        F.max("_zero").alias("_any_zero"),
        F.when(F.max("_zero") == 1, F.sum("_zero")).otherwise(F.count(F.lit(1))).alias("_usable"),
    )
    slots = F.filter(
        F.sequence(F.lit(1), F.lit(rows_per_hour)),
        lambda i: F.pmod(i - F.lit(1), F.col("_usable")) == F.col("_rn") - 1,
    )
    chosen = (
        lookup(firsts, settle(hours, "hours"), "datetime", spread=ident)
        .where((F.col("_any_zero") == 0) | (F.col("_zero") == 1))
        .select(ident, slots.alias("_slots"), (F.col("_any_zero") == 0).alias("_no_zero"))
    )
    fetched = lookup(df, settle(chosen, "chosen"), ident, spread=ident, how="inner", skewed=False)
    drawn = fetched.withColumn("_slot", F.explode("_slots"))

    def value(c: str) -> Column:
        kind = df.schema[c].dataType
        if c == ident:
            return F.concat(F.col(c).cast("string"), F.lit("_za"), F.col("_slot").cast("string")).alias(c)
        if c == revenue:
            return F.lit(0.0).cast(kind).alias(c)
        if isinstance(kind, NumericType):
            return F.when(F.col("_no_zero"), F.lit(0).cast(kind)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    anchors = drawn.select(*[value(c) for c in df.columns])
    return df.withColumn(ident, F.col(ident).cast("string")).unionByName(anchors)


def oversample_whales(
    df: DataFrame, threshold: float, revenue: str = "iap_revenue_d7", factor: int = 4
) -> DataFrame:
    """Repeat rows at or above the threshold ``factor`` times; flag them in ``is_whale``."""
    flagged = df.withColumn("is_whale", (F.col(revenue) >= F.lit(threshold)).cast("int"))
    return repeat_rows(flagged, F.when(F.col("is_whale") == 1, F.lit(factor)).otherwise(F.lit(1)))


def cap_revenue(df: DataFrame, cap: float, columns: Sequence[str]) -> DataFrame:
    """Clip revenue targets to [0, cap]."""
    present = {c: clip(F.col(c), 0.0, cap) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def cap_report(df: DataFrame, cap: float, columns: Sequence[str]) -> DataFrame:
    """(target, mean_before, mean_after, max_before, n_capped, pct_capped) in one pass."""
    present = [c for c in columns if c in df.columns]
    stats = [
        F.struct(
            F.lit(c).alias("target"),
            F.avg(c).alias("mean_before"),
            F.avg(clip(F.col(c), 0.0, cap)).alias("mean_after"),
            F.max(c).alias("max_before"),
            F.count_if(F.col(c) > cap).alias("n_capped"),
            (F.lit(100.0) * F.count_if(F.col(c) > cap) / F.count(F.lit(1))).alias("pct_capped"),
        )
        for c in present
    ]
    return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))


def log_target(df: DataFrame, upper: float, revenue: str = "iap_revenue_d7") -> DataFrame:
    """Clip to [0, upper] and take log1p into ``<revenue>_log``; ``expm1`` brings it back."""
    return df.withColumn(f"{revenue}_log", F.log1p(clip(F.col(revenue), 0.0, upper)))


def class_ratio(df: DataFrame, label: str = "buyer_d7") -> DataFrame:
    """Positives, negatives and their ratio, the weight of a positive row; 1 without positives."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)
    ratio = F.when(pos > 0, neg.cast("double") / pos).otherwise(F.lit(1.0))
    return df.agg(pos.alias("n_positive"), neg.alias("n_negative"), ratio.alias("scale_pos_weight"))


def add_class_weight(df: DataFrame, label: str, weight: float, name: str = "class_weight") -> DataFrame:
    """Weight column for estimators: ``weight`` on positives, 1 on the rest."""
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def high_value_threshold(
    df: DataFrame, revenue: str = "iap_revenue_d7", quantile: float = 0.995, min_revenue: float = 50.0
) -> float:
    """The larger of an exact revenue quantile and a floor."""
    found = quantiles(df, revenue, [quantile])
    return max(found[0] if found else 0.0, float(min_revenue))


def add_high_value_label(
    df: DataFrame, threshold: float, revenue: str = "iap_revenue_d7", name: str = "high_value"
) -> DataFrame:
    """0/1 label of rows at or above the threshold."""
    return df.withColumn(name, (F.col(revenue) >= F.lit(threshold)).cast("int"))
