"""From raw impression rows to a model table: flatten, impute, engineer.

``fit_preparation`` learns everything that depends on data from training rows;
``Preparation.apply`` replays it as one lazy chain on any batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from cohortal.core.settle import settle
from cohortal.functions.nested import (
    MAP_AGGREGATES,
    histogram_stats,
    list_stats,
    map_numbers,
    number_stats,
    pair_numbers,
)
from cohortal.functions.scalars import days_ago, recency_weight
from cohortal.operators.features import (
    add_activity_intensity,
    add_behaviour_products,
    add_cyclic_time,
    add_interactions,
    add_local_distributions,
    add_zero_flags,
    hash_categories,
)
from cohortal.operators.missing import (
    Imputer,
    add_indicators,
    apply_imputer,
    fit_imputer,
    fit_indicators,
)
from cohortal.operators.sampling import cap_revenue
from cohortal.operators.splits import NON_FEATURES, REVENUE_TARGETS, constant_columns, numeric_features

# Nested input columns by kind.
MAP_COLUMNS = (
    "iap_revenue_usd_bundle", "iap_revenue_usd_category", "iap_revenue_usd_category_bottom_taxonomy",
    "num_buys_bundle", "num_buys_category", "num_buys_category_bottom_taxonomy",
    "cpm", "ctr", "cpm_pct_rk", "ctr_pct_rk", "rev_by_adv", "rwd_prank",
    "whale_users_bundle_num_buys_prank", "whale_users_bundle_revenue_prank",
    "whale_users_bundle_total_num_buys", "whale_users_bundle_total_revenue", "hour_ratio",
)
LIST_COLUMNS = (
    "bundles_ins", "new_bundles", "user_bundles", "user_bundles_l28d",
    "bcat", "bcat_bottom_taxonomy", "bundles_cat", "bundles_cat_bottom_taxonomy",
    "first_request_ts_bundle", "first_request_ts_category_bottom_taxonomy",
    "last_buy_ts_bundle", "last_buy_ts_category", "last_install_ts_bundle", "last_install_ts_category",
    "user_actions_bundles_action_count", "user_actions_bundles_action_last_timestamp",
)
SESSION_COLUMNS = ("avg_daily_sessions", "avg_duration")
HISTOGRAM_COLUMNS = ("country_hist", "region_hist", "city_hist", "dev_osv_hist", "dev_language_hist")
TIMESTAMP_COLUMNS = ("last_buy", "last_buy_ts_bundle", "first_request_ts", "last_ins", "last_install_ts_bundle")
REFERENCE_DATE = "2025-10-08"


def _of_kind(df: DataFrame, names: Sequence[str], kind: type) -> list[str]:
    return [c for c in names if c in df.columns and isinstance(df.schema[c].dataType, kind)]


def _timestamp(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, StringType):
        return F.try_to_timestamp(F.col(c))
    return F.col(c).cast("timestamp")


def flatten_nested(df: DataFrame, reference: Column | str = REFERENCE_DATE, top_k: int = 5) -> DataFrame:
    """Replace every nested and timestamp column by its features in two projections.

    The kind of a column decides how it is read, so a timestamp that arrives as
    a list is counted and one that arrives as a timestamp becomes a recency.
    ``reference`` is a date text or the row's own clock.
    """
    maps = _of_kind(df, MAP_COLUMNS, MapType)
    lists = _of_kind(df, LIST_COLUMNS, ArrayType)
    sessions = [
        c for c in _of_kind(df, SESSION_COLUMNS, ArrayType)
        if isinstance(df.schema[c].dataType.elementType, StructType)
    ]
    hists = _of_kind(df, HISTOGRAM_COLUMNS, MapType)
    stamps = [c for c in TIMESTAMP_COLUMNS if c in df.columns and c not in lists]
    gone = {*maps, *lists, *sessions, *hists, *stamps}

    clock = F.lit(reference).cast("timestamp") if isinstance(reference, str) else reference
    second = {c: df.schema[c].dataType.elementType.fields[1].name for c in sessions}
    staged = df.select(
        *[c for c in df.columns if c not in gone],
        *lists,
        *[map_numbers(c).alias(f"_num_{c}") for c in maps],
        *[pair_numbers(c, second[c]).alias(f"_num_{c}") for c in sessions],
        *[F.sort_array(map_numbers(c), asc=False).alias(f"_num_{c}") for c in hists],
        *[days_ago(_timestamp(df, c), clock).alias(f"{c}_days_ago") for c in stamps],
    )
    return staged.select(
        *[c for c in df.columns if c not in gone],
        *[e for c in maps for e in number_stats(f"_num_{c}", c, MAP_AGGREGATES)],
        *[e for c in lists for e in list_stats(c)],
        *[e for c in sessions for e in number_stats(f"_num_{c}", c, ("total", "mean", "max", "count"))],
        *[e for c in hists for e in histogram_stats(f"_num_{c}", c, top_k)],
        *[e for c in stamps for e in (
            F.col(f"{c}_days_ago"), recency_weight(F.col(f"{c}_days_ago")).alias(f"{c}_recency_weight")
        )],
    )


def engineer(
    df: DataFrame, local_target: str | None = None, portable_hash: bool = False, ident: str = "row_id"
) -> DataFrame:
    """All feature steps in order; ``local_target`` turns on the label-based local statistics."""
    df = add_activity_intensity(add_interactions(df))
    if local_target is not None and local_target in df.columns:
        df = add_local_distributions(df, local_target, ident=ident)
    df = hash_categories(df, portable=portable_hash)
    return add_zero_flags(add_behaviour_products(add_cyclic_time(df)))


@dataclass
class Preparation:
    """Everything learned from training rows that scoring must repeat."""

    imputer: Imputer
    features: list[str]
    constants: list[str]
    reference: str = REFERENCE_DATE
    revenue_cap: float | None = 500.0
    portable_hash: bool = False

    def flatten(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Indicators and nested columns; labels, keys and ``keep`` wait in a struct no step touches."""
        kept = [c for c in dict.fromkeys([*NON_FEATURES, *keep]) if c in df.columns]
        boxed = df.select(F.struct(*kept).alias("_kept"), *[c for c in df.columns if c not in kept])
        return flatten_nested(add_indicators(boxed, self.imputer.indicators), self.reference)

    def finish(self, flat: DataFrame) -> DataFrame:
        """Fill, engineer, drop constants and cap the revenue labels."""
        out = engineer(apply_imputer(flat, self.imputer), portable_hash=self.portable_hash)
        out = out.select("_kept.*", *[c for c in out.columns if c != "_kept" and c not in self.constants])
        return cap_revenue(out, self.revenue_cap, REVENUE_TARGETS) if self.revenue_cap else out

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Lazy chain of projections: no shuffle and no action."""
        return self.finish(self.flatten(df, keep))

    def to_params(self) -> dict[str, Any]:
        return {
            "imputer": self.imputer.to_params(), "features": self.features, "constants": self.constants,
            "reference": self.reference, "revenue_cap": self.revenue_cap, "portable_hash": self.portable_hash,
        }

    @classmethod
    def from_params(cls, params: dict[str, Any]) -> Preparation:
        return cls(**{**params, "imputer": Imputer(**params["imputer"])})


def fit_preparation(
    train: DataFrame,
    reference: str = REFERENCE_DATE,
    revenue_cap: float | None = 500.0,
    indicator_threshold: float = 0.05,
    portable_hash: bool = False,
) -> tuple[Preparation, DataFrame]:
    """(fitted preparation, settled prepared training rows).

    The flattened rows are written once: the nested work is not repeated, and
    the fits scan single columns of the written table.
    """
    names = [c for c in train.columns if c not in NON_FEATURES]
    indicators = fit_indicators(train.select(*names), indicator_threshold)
    prep = Preparation(Imputer(indicators=indicators), [], [], reference, revenue_cap, portable_hash)
    flat = settle(prep.flatten(train), "flat")
    prep.imputer = fit_imputer(flat.drop("_kept"))
    prep.imputer.indicators = indicators
    prepared = settle(prep.finish(flat), "prepared")
    prep.constants = constant_columns(prepared)
    prepared = prepared.drop(*prep.constants)
    prep.features = numeric_features(prepared)
    return prep, prepared
