"""What all fitted stages share: feature vectors, probability columns, saving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortal.sources.files import read_params


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Add the model vector next to the row's own columns; absent columns and nulls become 0.

    A frame that already carries the vector is returned as it is, so stages
    that share their inputs build it once.
    """
    if name in df.columns:
        return df
    values = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns
    ]
    return df.select("*", array_to_vector(F.array(*values)).alias(name))


def training_frame(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Only the vector and the named columns, so that caching a training set stays small."""
    return with_vector(df, columns).select("features", *keep)


def positive_probability(name: str = "probability") -> Column:
    """Second entry of a two-class probability vector."""
    return vector_to_array(F.col(name))[1]


def with_validation_flag(train: DataFrame, val: DataFrame | None) -> DataFrame:
    """Union of both sets with ``_is_val`` for early stopping."""
    marked = train.withColumn("_is_val", F.lit(False))
    return marked if val is None else marked.unionByName(val.withColumn("_is_val", F.lit(True)))


def stored_params(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    return read_params(spark, f"{path.rstrip('/')}/params", default)
