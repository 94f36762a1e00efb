"""Sinks and sources for features, predictions and fitted parameters."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

PREDICTION_SCHEMA = "row_id string, iap_revenue_d7 double"


def write_features(df: DataFrame, path: str, by: str | None = None) -> None:
    """Store processed features as parquet, optionally foldered by one column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_predictions(df: DataFrame, path: str, value: str = "iap_revenue_d7") -> None:
    """Store ``row_id, iap_revenue_d7`` as CSV part files with a header."""
    out = df.select("row_id", F.col(value).alias("iap_revenue_d7"))
    out.write.mode("overwrite").option("header", "true").csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Load a prediction file with a fixed schema; an empty one is an error."""
    df = spark.read.option("header", "true").option("mode", "FAILFAST").schema(schema).csv(path)
    if df.isEmpty():
        raise ValueError(f"prediction file is empty: {path}")
    return df


def write_params(spark: SparkSession, params: dict[str, Any], path: str) -> None:
    """Store a small fitted-parameter dict as one JSON text row."""
    schema = StructType([StructField("value", StringType(), False)])
    one = spark.createDataFrame([(json.dumps(params, sort_keys=True),)], schema)
    one.coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str, default: dict[str, Any] | None = None) -> dict[str, Any]:
    """Load parameters; ``default`` stands in when the path was never written."""
    try:
        return json.loads(spark.read.text(path).first()[0])
    except AnalysisException:
        if default is None:
            raise
        return default
