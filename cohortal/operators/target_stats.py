"""Ordered target statistics: categories as smoothed label means that no row takes part in itself.

Rows stand in a fixed pseudorandom order, given by a hash of their id. A
training row's statistic of a category is the smoothed mean of the label over
the earlier rows of the same value; a row scored later gets the mean over all
training rows of that value. Any number of values is encoded in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortal.core.keys import sample_key
from cohortal.core.lookup import lookup
from cohortal.core.ranks import running_totals
from cohortal.core.settle import discard, settle
from cohortal.models.base import stored_params
from cohortal.sources.files import write_params


def _smoothed(total: Column, n: Column, prior: float, strength: float) -> Column:
    return (total + F.lit(prior * strength)) / (n + F.lit(float(strength)))


@dataclass
class CategoryEncoder:
    """Label totals per value of each column, settled, with the prior and its weight in rows."""

    tables: dict[str, DataFrame]
    prior: float
    strength: float

    @property
    def names(self) -> list[str]:
        return [f"{c}_ts" for c in self.tables]

    def apply(self, df: DataFrame, spread: Sequence[str] | str = "row_id") -> DataFrame:
        """Add ``<column>_ts`` from all training rows; a value never seen has the prior. Null is a value like any other."""
        out = df
        for column, table in self.tables.items():
            made = F.coalesce(_smoothed(F.col("_total"), F.col("_n"), self.prior, self.strength), F.lit(float(self.prior)))
            named = table.withColumnRenamed("value", "_value")
            out = lookup(out.withColumn("_value", F.col(column).cast("string")), named, "_value", spread)
            out = out.withColumn(f"{column}_ts", made).drop("_value", "_total", "_n")
        return out

    def save(self, path: str) -> None:
        for k, table in enumerate(self.tables.values()):
            table.write.mode("overwrite").parquet(f"{path}/values{k}")
        payload = {"columns": list(self.tables), "prior": self.prior, "strength": self.strength}
        write_params(SparkSession.active(), payload, f"{path}/params")


def load_encoder(spark: SparkSession, path: str) -> CategoryEncoder:
    p = stored_params(spark, path)
    return CategoryEncoder({c: spark.read.parquet(f"{path}/values{k}") for k, c in enumerate(p["columns"])}, p["prior"], p["strength"])


def fit_encoder(df: DataFrame, columns: Sequence[str], label: str, prior: float = 0.5, strength: float = 1.0) -> CategoryEncoder:
    """Label totals of every value; rows without a label do not count."""
    y = F.col(label).cast("double")
    rows = df.where(y.isNotNull())
    tables = {
        c: settle(rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.sum(y).alias("_total"), F.count(F.lit(1)).alias("_n")), "values")
        for c in columns
    }
    return CategoryEncoder(tables, float(prior), float(strength))


def ordered_stats(
    df: DataFrame, columns: Sequence[str], label: str, ident: str = "row_id", prior: float = 0.5, strength: float = 1.0,
    seed: int = 42, portable: bool = False,
) -> DataFrame:
    """Add ``<column>_ts``, the statistic over the rows before each one in the fixed order.

    Copies of a row (equal ids) see neither themselves nor each other. Rows
    without a label have a statistic but enter none; rows without an id enter
    none and have the prior. Sums run along the order
    within each value: one window where the table is small, and beyond that
    range slices of (value, order), whose totals carry over from slice to slice,
    so a value that holds a third of all rows is spread over many tasks.
    """
    cols = list(columns)
    if not cols:
        return df
    y = F.col(label).cast("double")
    narrow = df.where(F.col(ident).isNotNull()).select(
        F.struct(sample_key(ident, seed, portable).alias("key"), F.col(ident).alias("id")).alias("_order"),
        F.coalesce(y, F.lit(0.0)).alias("_y"), y.isNotNull().cast("bigint").alias("_n"), *[F.col(c).cast("string").alias(f"_c{k}") for k, c in enumerate(cols)],
    )
    long = narrow.unpivot(["_order", "_y", "_n"], [f"_c{k}" for k in range(len(cols))], "_column", "_value")
    counts = settle(long.groupBy("_column", "_value", "_order").agg(F.sum("_y").alias("_y"), F.sum("_n").alias("_n")), "ordered")
    run = running_totals(counts, "_order", ["_y", "_n"], by=["_column", "_value"])
    before = _smoothed(F.col("_y_upto") - F.col("_y"), F.col("_n_upto") - F.col("_n"), prior, strength)
    # Copies of one id that differ in a category keep their own value's statistic.
    per_row = run.select("_column", "_value", F.col("_order.id").alias("_id"), before.alias("_ts"))
    wide = settle(
        per_row.groupBy("_id").agg(*[F.collect_list(F.when(F.col("_column") == f"_c{k}", F.struct("_value", "_ts"))).alias(f"_s{k}") for k in range(len(cols))]), "ordered"
    )
    discard(counts)
    joined = df.join(wide, df[ident] == wide["_id"], "left")
    own = lambda k, c: F.filter(f"_s{k}", lambda s: s["_value"].eqNullSafe(F.col(c).cast("string")))[0]["_ts"]
    return joined.withColumns({f"{c}_ts": F.coalesce(own(k, c), F.lit(float(prior))) for k, c in enumerate(cols)}).drop("_id", *[f"_s{k}" for k in range(len(cols))])
