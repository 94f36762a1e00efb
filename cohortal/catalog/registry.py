"""Named queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles: sums differ in their last bits with the order of addition."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL counterpart of ``rounded`` for one expression."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0 AS {name or expr}"


def rs(names: Sequence[str], digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def names_table(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")
