"""Feature engineering: interactions, flags, cyclic time, local and encoded statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from cohortal.core.lookup import lookup
from cohortal.core.ranks import quantiles, running_totals, value_counts
from cohortal.core.settle import settle
from cohortal.functions.scalars import (
    bin_right_closed,
    cyclic,
    elapsed,
    hash_category,
    os_major,
    recency_days,
    to_number,
)

METADATA = ("row_id", "datetime")
LOCAL_CONTEXTS = ("country", "dev_os", "advertiser_category")
NEVER_FROM = 9990

# Flag name by the count it reads.
ZERO_FLAGS = {
    "num_buys_bundle_count": "no_bundle_buys",
    "num_buys_category_count": "no_category_buys",
    "num_buys_category_bottom_taxonomy_count": "no_bottom_tax_buys",
    "iap_revenue_usd_bundle_count": "no_bundle_revenue",
    "iap_revenue_usd_category_count": "no_category_revenue",
    "iap_revenue_usd_category_bottom_taxonomy_count": "no_bottom_tax_revenue",
    "new_bundles_count": "no_new_bundles",
    "user_bundles_count": "no_install_history",
    "avg_daily_sessions_total": "no_sessions_recorded",
    "avg_duration_mean": "no_session_duration",
}
HISTOGRAMS = ("country_hist", "region_hist", "city_hist", "dev_osv_hist", "dev_language_hist")
NEVER_FLAGS = {
    "last_buy_days_ago": "never_bought_before",
    "last_install_ts_bundle_days_ago": "never_installed_bundle_before",
}


def _add(df: DataFrame, made: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """Add the columns whose inputs are all present, in one projection."""
    ready = {name: expr for name, (needs, expr) in made.items() if set(needs) <= set(df.columns)}
    return df.withColumns(ready) if ready else df


def _per(top: str, bottom: str) -> Column:
    return F.try_divide(to_number(top), to_number(bottom) + F.lit(1.0))


def _product(a: str, b: str) -> Column:
    return to_number(a) * to_number(b)


def add_interactions(df: DataFrame) -> DataFrame:
    """Products and ratios between purchase, session, install and device features."""
    whale, freq = "whale_users_bundle_revenue_prank_mean", "avg_daily_sessions_total"
    buys, recency = "num_buys_bundle_mean", "last_buy_recency_weight"
    cat_rev, cat_n = "iap_revenue_usd_category_mean", "num_buys_category_count"
    new, weeks = "new_bundles_count", "weeks_since_first_seen"
    rev, price = "iap_revenue_usd_bundle_mean", "release_msrp"
    return _add(
        df,
        {
            "whale_x_freq": ((whale, freq), _product(whale, freq)),
            "purchase_recency_score": ((buys, recency), _product(buys, recency)),
            "install_velocity": ((new, weeks), _per(new, weeks)),
            "category_avg_purchase_value": ((cat_rev, cat_n), _per(cat_rev, cat_n)),
            "device_spending_ratio": ((rev, price), _per(rev, price)),
        },
    )


def add_activity_intensity(df: DataFrame) -> DataFrame:
    """Active days per week since first seen."""
    days, weeks = "avg_act_days", "weeks_since_first_seen"
    return _add(df, {"activity_intensity": ((days, weeks), _per(days, weeks))})


def add_behaviour_products(df: DataFrame) -> DataFrame:
    """Session totals times activity, duration and wifi share."""
    total = "avg_daily_sessions_total"
    return _add(
        df,
        {
            "session_consistency": ((total, "avg_act_days"), _product(total, "avg_act_days")),
            "engagement_score": ((total, "avg_duration_mean"), _product(total, "avg_duration_mean")),
            "wifi_engagement": ((total, "wifi_ratio"), _product(total, "wifi_ratio")),
        },
    )


def add_zero_flags(df: DataFrame) -> DataFrame:
    """0/1 flags for empty histories."""
    made = {flag: ((c,), (to_number(c) <= 0).cast("int")) for c, flag in ZERO_FLAGS.items()}
    made |= {
        f"{h}_missing_hist": ((f"{h}_top1_freq",), (to_number(f"{h}_top1_freq") <= 0).cast("int"))
        for h in HISTOGRAMS
    }
    made |= {flag: ((c,), (to_number(c) >= NEVER_FROM).cast("int")) for c, flag in NEVER_FLAGS.items()}
    return _add(df, made)


def add_cyclic_time(df: DataFrame) -> DataFrame:
    """sin/cos of hour and weekday, day-part flags and weekend flag as 0/1."""
    hour, day = to_number("hour"), to_number("weekday")
    part = lambda low, high: ((hour >= low) & (hour < high)).cast("int")
    h_sin, h_cos = cyclic(hour, 24)
    d_sin, d_cos = cyclic(day, 7)
    on_hour, on_day = ("hour",), ("weekday",)
    return _add(
        df,
        {
            "hour_sin": (on_hour, h_sin),
            "hour_cos": (on_hour, h_cos),
            "is_morning": (on_hour, part(6, 12)),
            "is_afternoon": (on_hour, part(12, 18)),
            "is_evening": (on_hour, part(18, 22)),
            "is_night": (on_hour, ((hour >= 22) | (hour < 6)).cast("int")),
            "weekday_sin": (on_day, d_sin),
            "weekday_cos": (on_day, d_cos),
            "is_weekend": (on_day, day.isin(5.0, 6.0).cast("int")),
        },
    )


def add_hour_groups(df: DataFrame) -> DataFrame:
    """Second day-part scheme: right-closed six-hour groups, night up to 6, evening from 18."""
    hour = F.coalesce(F.col("hour").cast("int"), F.lit(0))
    h_sin, h_cos = cyclic(hour, 24)
    group = (
        F.when((hour > -1) & (hour <= 6), "night")
        .when((hour > 6) & (hour <= 12), "morning")
        .when((hour > 12) & (hour <= 18), "afternoon")
        .when((hour > 18) & (hour <= 24), "evening")
    )
    return df.withColumns(
        {
            "hour": hour,
            "hour_sin": h_sin,
            "hour_cos": h_cos,
            "hour_group": group,
            "is_night_6": (hour <= 6).cast("int"),
            "is_evening_18": (hour >= 18).cast("int"),
        }
    )


def add_clock_recency(df: DataFrame, now: str = "debug_ts") -> DataFrame:
    """Elapsed time between a numeric row clock and the last buy, install and first request."""
    pairs = {
        "recency_last_buy": "last_buy_ts_bundle",
        "recency_last_install": "last_install_ts_bundle",
        "recency_first_request": "first_request_ts",
    }
    return df.withColumns(
        {name: elapsed(F.col(now), F.col(c) if c in df.columns else None) for name, c in pairs.items()}
    )


def add_day_recency(df: DataFrame, clock: Column, pairs: Mapping[str, str]) -> DataFrame:
    """Fractional days from event columns to the row's clock, 999 when never."""
    made = {name: recency_days(F.col(c), clock) for name, c in pairs.items() if c in df.columns}
    return df.withColumns(made) if made else df


def hash_categories(
    df: DataFrame, columns: Sequence[str] | None = None, portable: bool = False
) -> DataFrame:
    """Replace text columns, metadata aside, by 64-bit codes."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    listed = [c for c in (columns or []) if c in df.columns]
    todo = [c for c in dict.fromkeys([*listed, *texts]) if c not in METADATA]
    return df.withColumns({c: hash_category(c, portable) for c in todo}) if todo else df


def align_categories(df: DataFrame, categories: Mapping[str, DataFrame], spread: str = "row_id") -> DataFrame:
    """Null out values that the fitted category tables do not list; null becomes ``__MISSING__`` first.

    Each table has one settled column named like the one it aligns.
    """
    for c, table in categories.items():
        if c not in df.columns:
            continue
        named = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")))
        known = table.select(c, F.lit(True).alias("_known"))
        df = lookup(named, known, c, spread=spread).withColumn(c, F.when(F.col("_known"), F.col(c))).drop("_known")
    return df


def fit_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """Settled table of the distinct values of each column."""
    return {
        c: settle(
            df.select(F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c)).distinct(), "cats"
        )
        for c in columns
    }


def add_os_major(df: DataFrame) -> DataFrame:
    """Leading integer of the OS version."""
    return df.withColumn("dev_osv_major", os_major("dev_osv") if "dev_osv" in df.columns else F.lit(-1))


# --- statistics per group, attached to rows -------------------------------------------------


def _local_tables(df: DataFrame, contexts: Sequence[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Settled (name, value, target, rank) and (name, value, mean) of all contexts, from one scan's counts.

    Ranks are computed on counts per (context, value), so ties are one row and
    no window ever holds a context's rows.
    """
    long = df.select(target, *[F.col(c).cast("string").alias(c) for c in contexts]).unpivot(
        [target], list(contexts), "_name", "_value"
    )
    counts = value_counts(long.where(F.col("_value").isNotNull()), target, ["_name", "_value"])
    run = running_totals(counts, target, ["n"], ["_name", "_value"])
    pct = (F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2.0) / F.col("n_all")
    ranks = settle(run.select("_name", "_value", target, pct.alias("_rank")), "ranks")
    total = F.sum(F.col(target) * F.col("n"))
    means = settle(counts.groupBy("_name", "_value").agg((total / F.sum("n")).alias("_mean")), "means")
    return ranks, means


def _of_context(table: DataFrame, context: str, value: str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return settle(
        table.where(F.col("_name") == context).select(F.col("_value").alias("_context"), *keep, F.col(value).alias(name)), "local"
    )


def _with_rank(df: DataFrame, ranks: DataFrame, context: str, target: str, ident: str) -> DataFrame:
    name = f"{context}_local_spend_rank"
    own = _of_context(ranks, context, "_rank", name, [target])
    joined = lookup(df.withColumn("_context", F.col(context).cast("string")), own, ["_context", target], spread=ident)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0.5))).drop("_context")


def _with_mean(df: DataFrame, means: DataFrame, context: str, target: str, ident: str) -> DataFrame:
    name = f"{context}_local_avg_spend"
    own = _of_context(means, context, "_mean", name)
    joined = lookup(df.withColumn("_context", F.col(context).cast("string")), own, "_context", spread=ident).drop("_context")
    joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    deviation = F.try_divide(F.col(target) - F.col(name), F.col(name) + F.lit(1.0))
    return joined.withColumn(f"{context}_spend_deviation", deviation)


def add_local_rank(df: DataFrame, context: str, target: str, ident: str = "row_id") -> DataFrame:
    """Average-tie percent rank of the target inside each context; null target or context -> 0.5."""
    return _with_rank(df, _local_tables(df, [context], target)[0], context, target, ident)


def add_local_mean(df: DataFrame, context: str, target: str, ident: str = "row_id") -> DataFrame:
    """Group mean of the target (0 when unknown) and the relative deviation from it."""
    return _with_mean(df, _local_tables(df, [context], target)[1], context, target, ident)


def add_local_distributions(
    df: DataFrame, target: str, contexts: Sequence[str] = LOCAL_CONTEXTS, ident: str = "row_id"
) -> DataFrame:
    """Rank, mean and deviation for every context present. These read the label: off by default.

    The statistics of all contexts come from one pass over the original rows.
    """
    present = [c for c in contexts if c in df.columns]
    if not present or target not in df.columns:
        return df
    ranks, means = _local_tables(df, present, target)
    for context in present:
        df = _with_mean(_with_rank(df, ranks, context, target, ident), means, context, target, ident)
    return df


def fit_target_encoding(
    df: DataFrame, column: str, target: str, min_samples: int = 200
) -> tuple[DataFrame, float]:
    """(settled table column -> te, global mean). The weight is a sigmoid of count - min_samples."""
    overall = df.agg(F.avg(target)).first()[0] or 0.0
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.count(target) - F.lit(min_samples)).cast("double")))
    stats = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg((F.lit(overall) * (F.lit(1.0) - weight) + F.avg(target) * weight).alias(f"{column}_te"))
    )
    return settle(stats, "te"), float(overall)


def map_stats(
    df: DataFrame, table: DataFrame, column: str, default: float, ident: str = "row_id"
) -> DataFrame:
    """Attach the statistics of a settled per-value table; unmatched rows get the default."""
    made = [c for c in table.columns if c != column]
    joined = lookup(df, table, column, spread=ident)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in made})


def whale_threshold(
    df: DataFrame, revenue: str, quantile: float = 0.80, positive_only: bool = True
) -> float:
    """Revenue quantile that separates large spenders.

    Over all rows it is 0 as soon as zeros fill the quantile and every row
    would be one, hence the default over paying rows.
    """
    base = df.where(F.col(revenue) > 0) if positive_only else df
    found = quantiles(base, revenue, [quantile])
    return found[0] if found else 0.0


def whale_rate(
    df: DataFrame, column: str, revenue: str, threshold: float, name: str | None = None
) -> DataFrame:
    """Share of rows per group whose revenue reaches the threshold; settled."""
    rate = F.avg((F.col(revenue) >= F.lit(threshold)).cast("double")).alias(name or f"{column}_whale_rate")
    return settle(df.where(F.col(column).isNotNull()).groupBy(column).agg(rate), "whales")


def group_mean(df: DataFrame, column: str, value: str, name: str) -> DataFrame:
    """Mean per group; settled."""
    return settle(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(value).alias(name)), "means")


def group_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """Share of the non-null rows per value; settled."""
    counts = settle(
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), "counts"
    )
    total = counts.agg(F.sum("n")).first()[0] or 1
    return settle(counts.select(column, (F.col("n") / F.lit(float(total))).alias(name)), "shares")


def fit_quantile_bins(df: DataFrame, column: str, bins: int = 10, fill: float | None = 0.0) -> list[float]:
    """Distinct quantile edges of a column (null -> ``fill`` first)."""
    filled = df.select((to_number(column, fill)).alias(column))
    found = quantiles(filled, column, [i / bins for i in range(bins + 1)]) or []
    return sorted(set(found))


def quantile_bin(column: Column | str, edges: list[float], fill: float | None = 0.0) -> Column:
    """0-based right-closed bin of a value under fitted edges."""
    return bin_right_closed(to_number(column, fill), edges)
