"""Missing values: profile, fitted imputation, indicators.

What depends on the data (fill values, which indicators exist) is fitted once
on training rows and replayed, so a row scores the same in any batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from cohortal.core.ranks import quantile_table

# Name parts that decide the strategy, tried in this order.
NAME_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("zero", ("revenue", "iap", "spend", "buy", "purchase", "cpm", "ctr")),
    ("zero", ("count", "num_", "_count", "n_", "total_")),
    ("median", ("ratio", "pct", "percentage", "rate", "_prank")),
    ("large_value", ("days_ago", "last_", "first_", "recency")),
    ("median", ("avg_", "mean_", "std_", "max_", "min_", "median_")),
)
LATE_NAME_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("mode", ("dev_", "carrier", "country", "region", "os", "make", "model")),
    ("zero", ("hist_", "entropy", "top")),
    ("special_value", ("encoded",)),
)
CONSTANT_FILLS = {"zero": 0, "large_value": 9999, "special_value": -1}


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, StringType)


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (NumericType, BooleanType))


def _absent(df: DataFrame, c: str, none_text: bool = True) -> Column:
    missing = F.col(c).isNull()
    return missing | (F.col(c) == "None") if none_text and _is_text(df, c) else missing


def strategy_for(column: str, is_text: bool) -> str:
    """First rule whose part occurs in the column name; type decides the rest."""
    name = column.lower()
    hit = lambda rules: next((s for s, parts in rules if any(p in name for p in parts)), None)
    return hit(NAME_RULES) or ("mode" if is_text else hit(LATE_NAME_RULES) or "median")


def absent_counts(df: DataFrame, none_text: bool = True) -> tuple[int, dict[str, int]]:
    """Row count and missing cells per column from one aggregation."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(_absent(df, c, none_text)).alias(c) for c in df.columns],
    ).first()
    return row["_rows"], {c: row[c] for c in df.columns}


def missing_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, pct_missing, dtype) of the columns with missing cells, worst first."""
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(_absent(df, c)).alias(c) for c in df.columns]
    )
    long = one.unpivot(["_rows"], df.columns, "column_name", "n_missing")
    return (
        long.where("n_missing > 0")
        .select(
            "column_name",
            "n_missing",
            (F.col("n_missing") / F.col("_rows") * 100.0).alias("pct_missing"),
            F.element_at(kinds, F.col("column_name")).alias("dtype"),
        )
        .orderBy(F.desc("pct_missing"), "column_name")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing cells and share, columns with missing cells."""
    counts = F.array(*[F.count_if(F.col(c).isNull()) for c in df.columns])
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), counts.alias("_m"))
    total = F.aggregate("_m", F.lit(0).cast("bigint"), lambda a, v: a + v)
    cells = F.col("n_rows") * F.lit(len(df.columns))
    return one.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        cells.cast("bigint").alias("total_cells"),
        total.alias("missing_cells"),
        (total / cells * 100.0).alias("missing_pct"),
        F.size(F.filter("_m", lambda v: v > 0)).cast("bigint").alias("columns_with_missing"),
    )


def most_missing(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` columns with the largest share of missing cells, ties by name."""
    return missing_profile(df).where("n_missing > 0").orderBy(F.desc("pct_missing"), "column_name").limit(k)


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column."""
    rows, counts = absent_counts(df, none_text=False)
    return {c: n / rows if rows else 0.0 for c, n in counts.items()}


def drop_all_null(df: DataFrame) -> DataFrame:
    """Remove columns without a single value."""
    return df.drop(*[c for c, share in null_shares(df).items() if share == 1.0])


def sparse_columns(df: DataFrame, threshold: float = 0.90) -> list[str]:
    """Columns whose null share exceeds the threshold."""
    return [c for c, share in null_shares(df).items() if share > threshold]


@dataclass
class Imputer:
    """Fill values and strategies learned from training rows, by column."""

    values: dict[str, Any] = field(default_factory=dict)
    strategies: dict[str, str] = field(default_factory=dict)
    indicators: list[str] = field(default_factory=list)

    def to_params(self) -> dict[str, Any]:
        return asdict(self)

    def summary(self, spark: SparkSession) -> DataFrame:
        """(strategy, n_columns) of the fitted columns."""
        rows = [(c, s) for c, s in self.strategies.items()]
        return (
            spark.createDataFrame(rows, "column_name string, strategy string")
            .groupBy("strategy")
            .agg(F.count(F.lit(1)).alias("n_columns"))
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """(column_name, strategy, fill) with the fill value as text."""
        rows = [(c, self.strategies[c], str(v)) for c, v in self.values.items()]
        return spark.createDataFrame(rows, "column_name string, strategy string, fill string")


def fit_imputer(
    df: DataFrame,
    overrides: Mapping[str, str] | None = None,
    indicator_threshold: float | None = None,
    none_is_value: bool = False,
) -> Imputer:
    """Learn fills for the scalar columns that have a null or a 'None' text.

    Columns are counted in one pass. All medians then come from one long table
    of (column, value) counts, and all modes from another, so neither needs a
    task that sees a whole column. The texts that count as gaps (``None`` and the
    empty one) are never a mode; ``none_is_value=True`` lets them be.
    """
    scalar = [c for c in df.columns if _is_text(df, c) or _is_number(df, c)]
    rows, absent = absent_counts(df.select(*scalar))
    chosen = {
        c: (overrides or {}).get(c) or strategy_for(c, _is_text(df, c)) for c in scalar if absent[c] > 0
    }
    fitted = Imputer(strategies=chosen)
    for c, s in chosen.items():
        if s in CONSTANT_FILLS:
            fitted.values[c] = CONSTANT_FILLS[s]

    medians = [c for c, s in chosen.items() if s == "median"]
    if medians:
        long = df.select(*[F.col(c).try_cast("double").alias(c) for c in medians]).unpivot(
            [], medians, "column_name", "value"
        )
        found = quantile_table(long, "value", [0.5], by=["column_name"]).collect()
        by_name = {r["column_name"]: r["quantile"] for r in found}
        fitted.values |= {c: by_name.get(c, 0) for c in medians}

    for kind in (True, False):
        modes = [c for c, s in chosen.items() if s == "mode" and _is_text(df, c) is kind]
        if not modes:
            continue
        target = "string" if kind else "double"
        long = df.select(*[F.col(c).cast(target).alias(c) for c in modes]).unpivot(
            [], modes, "column_name", "value"
        )
        real = F.col("value").isNotNull()
        if kind and not none_is_value:
            real &= ~F.col("value").isin("None", "")
        counted = long.where(real).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counted.groupBy("column_name").agg(
            F.min(F.struct((-F.col("n")).alias("rank"), "value"))["value"].alias("value")
        )
        by_name = {r["column_name"]: r["value"] for r in best.collect()}
        fitted.values |= {c: by_name.get(c, "missing" if kind else 0) for c in modes}

    if indicator_threshold is not None:
        fitted.indicators = fit_indicators(df, indicator_threshold)
    return fitted


def apply_imputer(df: DataFrame, fitted: Imputer) -> DataFrame:
    """Fill scalar columns with learned values; never-seen gaps get 'missing' or 0."""

    def filled(c: str) -> Column:
        if _is_text(df, c):
            cleaned = F.when(~F.col(c).isin("None", ""), F.col(c))
            return F.coalesce(cleaned, F.lit(str(fitted.values.get(c, "missing")))).alias(c)
        if _is_number(df, c):
            kind = df.schema[c].dataType
            if isinstance(kind, BooleanType):
                return F.coalesce(F.col(c), F.lit(bool(fitted.values.get(c, 0)))).alias(c)
            value = fitted.values.get(c, 0)
            whole = float(value) == int(value)
            fill = F.lit(int(value)).cast(kind) if whole else F.lit(float(value))
            return F.coalesce(F.col(c), fill).alias(c)
        return F.col(c)

    return df.select(*[filled(c) for c in df.columns])


def fit_indicators(df: DataFrame, threshold: float = 0.05) -> list[str]:
    """Columns whose null share exceeds the threshold."""
    return [c for c, share in null_shares(df).items() if share > threshold]


def add_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<col>_is_missing`` 0/1 for fitted columns; a column absent from the batch counts as missing."""
    made = {
        f"{c}_is_missing": (F.col(c).isNull().cast("int") if c in df.columns else F.lit(1)) for c in columns
    }
    return df.withColumns(made) if made else df


def fill_categories(df: DataFrame, columns: Sequence[str], label: str = "UNK") -> DataFrame:
    """Constant label for missing categories."""
    present = [c for c in columns if c in df.columns]
    return df.fillna(label, subset=present) if present else df


def align_matrix(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to the fitted feature list as doubles; absent columns and nulls become 0."""
    made = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in columns
    ]
    return df.select(*[k for k in keep if k not in columns], *made)
