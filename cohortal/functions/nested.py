"""Expressions over map, array and struct columns, one row at a time.

Each family returns named columns. ``clean`` steps first reduce the nested
value to an array of numbers; the plan keeps that array as a column of its own
so the aggregates share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MAP_AGGREGATES = ("mean", "std", "max", "min", "count")


def _numbers(values: Column) -> Column:
    return F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _with_value(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; inside a lambda it would be worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_numbers(col: str) -> Column:
    """Numeric values of a map; entries that do not cast are left out."""
    return _numbers(F.map_values(col))


def pair_numbers(col: str, field: str = "value") -> Column:
    """Numeric second elements of a (key, value) list."""
    return _numbers(F.transform(col, lambda pair: pair[field]))


def number_stats(values: str, prefix: str, wanted: Sequence[str]) -> list[Column]:
    """Statistics of an array-of-double column; everything is 0 for null or empty."""
    arr = F.col(values)
    size = F.coalesce(F.size(F.coalesce(arr, F.array().cast("array<double>"))), F.lit(0))
    total = _total(arr)
    mean = total / F.nullif(F.size(arr), F.lit(0))
    squares = _with_value(mean, lambda m: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)))
    made = {
        "mean": mean,
        "std": F.when(F.size(arr) >= 2, F.sqrt(squares / F.size(arr))),
        "max": F.array_max(arr),
        "min": F.array_min(arr),
        "total": total,
    }
    return [
        (size.cast("bigint") if w == "count" else F.coalesce(made[w], F.lit(0.0))).alias(f"{prefix}_{w}")
        for w in wanted
    ]


def list_stats(col: str) -> list[Column]:
    """Length and number of different items of a list; 0 for null."""
    return [
        F.coalesce(F.size(F.coalesce(F.col(col), F.array())), F.lit(0)).cast("bigint").alias(f"{col}_count"),
        F.coalesce(F.size(F.array_distinct(F.coalesce(F.col(col), F.array()))), F.lit(0))
        .cast("bigint")
        .alias(f"{col}_unique"),
    ]


def histogram_stats(values: str, prefix: str, top_k: int = 5, eps: float = 1e-10) -> list[Column]:
    """The k largest frequencies and the entropy of a descending array of frequencies."""
    arr = F.col(values)
    total = _total(arr)
    entropy = _with_value(total, lambda t: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc - v / t * F.ln(v / t + F.lit(eps))))
    tops = [
        F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)).alias(f"{prefix}_top{i + 1}_freq")
        for i in range(top_k)
    ]
    return [*tops, F.coalesce(F.when(total > 0, entropy), F.lit(0.0)).alias(f"{prefix}_entropy")]


def item_entropy(col: str, eps: float = 1e-9) -> Column:
    """Entropy of the item frequencies of a list, 0 for null or empty.

    The row's own list is sorted and folded over its runs, so n items cost
    n log n, however many of them differ.
    """
    total = F.size(col).cast("double")
    start = F.struct(
        F.lit(None).cast("string").alias("item"), F.lit(0.0).alias("run"), F.lit(0.0).alias("entropy")
    )
    lost = lambda run: F.when(run > 0, run / total * F.ln(run / total + F.lit(eps))).otherwise(F.lit(0.0))

    def step(acc: Column, item: Column) -> Column:
        goes_on = (acc["run"] > 0) & item.eqNullSafe(acc["item"])
        return F.struct(
            item.alias("item"),
            F.when(goes_on, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(goes_on, acc["entropy"]).otherwise(acc["entropy"] - lost(acc["run"])).alias("entropy"),
        )

    ordered = F.sort_array(F.col(col).cast("array<string>"))
    folded = F.aggregate(ordered, start, step, lambda acc: acc["entropy"] - lost(acc["run"]))
    return F.coalesce(folded, F.lit(0.0))


def flatten_maps(df: DataFrame, cols: Sequence[str], wanted: Sequence[str] = MAP_AGGREGATES) -> DataFrame:
    """Replace map columns by their aggregates."""
    cols = [c for c in cols if c in df.columns]
    staged = df.select("*", *[map_numbers(c).alias(f"_num_{c}") for c in cols])
    made = [e for c in cols for e in number_stats(f"_num_{c}", c, wanted)]
    return staged.select(*[c for c in df.columns if c not in cols], *made)


def flatten_lists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace list columns by count and unique count."""
    cols = [c for c in cols if c in df.columns]
    return df.select(*[c for c in df.columns if c not in cols], *[e for c in cols for e in list_stats(c)])


def flatten_sessions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace (key, number) lists by total, mean, max and count."""
    cols = [c for c in cols if c in df.columns]
    staged = df.select("*", *[pair_numbers(c).alias(f"_num_{c}") for c in cols])
    made = [e for c in cols for e in number_stats(f"_num_{c}", c, ("total", "mean", "max", "count"))]
    return staged.select(*[c for c in df.columns if c not in cols], *made)


def flatten_histograms(df: DataFrame, cols: Sequence[str], top_k: int = 5) -> DataFrame:
    """Replace histogram maps by top-k frequencies and entropy."""
    cols = [c for c in cols if c in df.columns]
    staged = df.select("*", *[F.sort_array(map_numbers(c), asc=False).alias(f"_num_{c}") for c in cols])
    made = [e for c in cols for e in histogram_stats(f"_num_{c}", c, top_k)]
    return staged.select(*[c for c in df.columns if c not in cols], *made)


def compress_lists(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace lists by length, mean item frequency and entropy of the items."""
    cols = [c for c in cols if c in df.columns]
    made = []
    for c in cols:
        items = F.coalesce(F.col(c), F.array())
        made += [
            F.size(items).cast("bigint").alias(f"{c}_len"),
            F.coalesce(F.size(items) / F.nullif(F.size(F.array_distinct(items)), F.lit(0)), F.lit(0.0)).alias(
                f"{c}_mean"
            ),
            item_entropy(c).alias(f"{c}_entropy"),
        ]
    return df.select(*[c for c in df.columns if c not in cols], *made)
