"""Row filters, train/validation splits and column subsets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StructType

from cohortal.core.keys import KEY_BITS, sample_key
from cohortal.core.ranks import cut_per_group, first_rows, nth_values, quantiles, value_counts
from cohortal.sources.hourly import scan_window

# Labels and metadata that must never become model inputs.
NON_FEATURES = (
    "row_id", "datetime",
    "iap_revenue_d1", "iap_revenue_d7", "iap_revenue_d14", "iap_revenue_d28",
    "buyer_d1", "buyer_d7", "buyer_d14", "buyer_d28",
    "buy_d7", "buy_d14", "buy_d28", "registration",
    "retention_d1", "retention_d7", "retention_d14",
)
LEAKAGE_PARTS = ("retention", "registration", "local_spend", "local_avg", "spend_deviation")
CRITICAL = NON_FEATURES[:10]
REVENUE_TARGETS = ("iap_revenue_d1", "iap_revenue_d7", "iap_revenue_d14")
# Columns dense enough for the small model, and its categories.
DENSE_FEATURES = (
    "hour", "weekday", "avg_act_days", "avg_daily_sessions", "avg_duration",
    "weekend_ratio", "wifi_ratio", "weeks_since_first_seen", "release_msrp", "release_date",
)
STUDENT_CATEGORIES = ("country", "dev_os", "advertiser_category")


def hash_sample(
    df: DataFrame, fraction: float | None, ident: str = "row_id", seed: int = 42, portable: bool = False
) -> DataFrame:
    """Seeded fraction of rows by hash of the identifier: no shuffle, any layout gives the same rows."""
    if fraction is None or fraction >= 1.0:
        return df
    below = int(fraction * (1 << KEY_BITS))
    return df.where(sample_key(ident, seed, portable) < F.lit(below))


def temporal_split(
    df: DataFrame, train: tuple[str, str], val: tuple[str, str], required: Sequence[str] = REVENUE_TARGETS[1:]
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint datetime windows of a labelled table."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing target columns: {absent}")
    if not (train[1] < val[0] or val[1] < train[0]):
        raise ValueError("train and validation windows overlap")
    return scan_window(df, *train), scan_window(df, *val)


def validation_or_fallback(
    train: DataFrame,
    val: DataFrame,
    rows: int = 512,
    ident: str = "row_id",
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """The validation rows, or ``rows`` pseudo-random training rows if there are none."""
    if not val.isEmpty():
        return val
    key = sample_key(ident, seed, portable)
    return first_rows(train.withColumn("_key", key), max(1, rows), ["_key", ident]).drop("_key")


def stratified_split(
    df: DataFrame,
    fraction: float = 0.8,
    stratum: str | None = "buyer_d7",
    ident: str = "row_id",
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Add ``split``: round(fraction * n) rows of every stratum become 'train', exactly.

    Null is a stratum. A single-valued or absent stratum column gives one stratum.
    """
    by = [stratum] if stratum and stratum in df.columns else []
    flagged = cut_per_group(
        df, by, sample_key(ident, seed, portable), ident, lambda n: F.floor(n * F.lit(fraction) + F.lit(0.5))
    )
    return flagged.withColumn("split", F.when(F.col("picked"), "train").otherwise("val")).drop("picked")


def time_split(df: DataFrame, fraction: float = 0.85, ident: str = "row_id") -> DataFrame:
    """Add ``split``: the first floor(fraction * n) rows by (datetime, row) are 'train'.

    The cut is found from counts per hour, then from the rows of the one hour it
    falls in; no row is globally sorted or numbered.
    """
    hours = value_counts(df, "datetime")
    total = hours.agg(F.sum("n")).first()[0] or 0
    take = math.floor(total * fraction)
    if take == 0:
        return df.withColumn("split", F.lit("val"))
    edge = nth_values(hours, "datetime", [take - 1])[take - 1]
    before = hours.where(F.col("datetime") < edge).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at_edge = value_counts(df.where(F.col("datetime") == edge), ident)
    last = nth_values(at_edge, ident, [take - before - 1])[take - before - 1]
    inside = (F.col("datetime") < edge) | ((F.col("datetime") == edge) & (F.col(ident) <= last))
    return df.withColumn("split", F.when(inside, "train").otherwise("val"))


def buyers(df: DataFrame, label: str = "buyer_d7", revenue: str | None = None) -> DataFrame:
    """Buyer rows; with ``revenue``, only those whose revenue is known and not negative."""
    out = df.where(F.col(label) == 1)
    return out.where(F.col(revenue) >= 0) if revenue else out


def paying_buyers(
    df: DataFrame, label: str = "buyer_d7", revenue: str = "iap_revenue_d7"
) -> tuple[DataFrame, DataFrame]:
    """Buyers with revenue, and a one-row report of how many zero-revenue buyers went."""
    base = buyers(df, label)
    zero = F.count_if(F.col(revenue) == 0)
    report = base.agg(
        F.count(F.lit(1)).alias("n_buyers"),
        zero.alias("n_removed"),
        (F.lit(100.0) * zero / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_removed"),
    )
    return base.where(F.col(revenue) > 0), report


def whale_cutoff(
    df: DataFrame, revenue: str, max_revenue: float | None = None, percentile: float | None = None
) -> float | None:
    """The lower of a fixed cap and an exact percentile."""
    cuts = [float(max_revenue)] if max_revenue and max_revenue > 0 else []
    if percentile is not None:
        found = quantiles(df, revenue, [percentile / 100.0])
        cuts += found or []
    return min(cuts) if cuts else None


def drop_whales(
    df: DataFrame,
    revenue: str = "iap_revenue_d7",
    max_revenue: float | None = None,
    percentile: float | None = None,
) -> DataFrame:
    """Remove rows above the cut-off; an empty result is an error."""
    cut = whale_cutoff(df, revenue, max_revenue, percentile)
    if cut is None:
        return df
    kept = df.where(F.col(revenue) <= cut)
    if kept.isEmpty():
        raise ValueError("whale filter removed all rows; raise its thresholds")
    return kept


def is_scalar(df: DataFrame, c: str) -> bool:
    return not isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType))


def drop_nested(df: DataFrame) -> DataFrame:
    """Remove list, map and struct columns."""
    return df.select(*[c for c in df.columns if is_scalar(df, c)])


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that are neither labels, metadata nor derived from labels."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (NumericType, BooleanType))
        and f.name not in NON_FEATURES
        and not any(part in f.name for part in LEAKAGE_PARTS)
    ]
    if not names:
        raise ValueError("no numeric feature columns left")
    return names


def student_columns(df: DataFrame) -> list[str]:
    """Dense columns plus three categories, as far as present."""
    return [c for c in (*DENSE_FEATURES, *STUDENT_CATEGORIES) if c in df.columns]


def constant_columns(df: DataFrame, keep: Sequence[str] = CRITICAL) -> list[str]:
    """Columns with at most one distinct value, null counting as a value.

    One aggregation of min, max and null count; maps are compared as JSON text.
    """
    todo = [c for c in df.columns if c not in keep]
    if not todo:
        return []
    comparable = lambda c: F.to_json(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c)
    aggs = [
        F.struct(
            (F.min(comparable(c)).eqNullSafe(F.max(comparable(c)))).alias("same"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
        ).alias(c)
        for c in todo
    ]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    return [c for c in todo if row[c]["same"] and row[c]["nulls"] in (0, row["_rows"])]


def drop_constant_columns(
    train: DataFrame, val: DataFrame, keep: Sequence[str] = CRITICAL
) -> tuple[DataFrame, DataFrame]:
    """Decide on train, apply to both."""
    gone = constant_columns(train, keep)
    return train.drop(*gone), val.drop(*gone)
