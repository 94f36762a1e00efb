"""Scans of tables laid out by a sortable ``datetime`` string (yyyy-MM-dd-HH-mm).

On a hive-partitioned folder every window below becomes a partition filter; on
a plain column it is pushed to the parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortal.core.keys import sample_key
from cohortal.core.lookup import lookup
from cohortal.core.ranks import first_rows
from cohortal.core.settle import settle

DATETIME_FORMAT = "yyyy-MM-dd-HH-mm"


def read_hourly(
    spark: SparkSession, path: str, schema: StructType | str | None = None, merge: bool = False
) -> DataFrame:
    """Table whose folders are ``datetime=<hour>``; the hour stays a string column.

    With a ``schema`` no footer is opened before a window prunes the folders.
    Without one the columns are those of one file, or with ``merge`` of all files.
    """
    reader = spark.read.option("mergeSchema", str(merge).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path).withColumn("datetime", F.col("datetime").cast("string"))


def write_hourly(df: DataFrame, path: str) -> None:
    """Write rows into their ``datetime=<hour>`` folders; only the hours at hand are replaced, all others stay.

    Rows are gathered by hour, a large hour by several tasks and small ones by
    few, so that no hour is scattered over many files. Rows without an hour go
    to the default folder that partitioned tables have for nulls.
    """
    gathered = df.hint("rebalance", "datetime")
    gathered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("datetime").parquet(path)


def scan_window(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= datetime <= end; either end may be open."""
    if start is not None:
        df = df.where(F.col("datetime") >= start)
    if end is not None:
        df = df.where(F.col("datetime") <= end)
    return df


def cap_partitions(df: DataFrame, n: int) -> DataFrame:
    """Keep the first ``n`` hours. One scalar comes back, which then prunes the scan."""
    firsts = df.select("datetime").distinct().orderBy("datetime").limit(n)
    last = firsts.agg(F.max("datetime")).first()[0]
    return df.where(F.col("datetime") <= last) if last is not None else df


def load_split(
    df: DataFrame,
    train: tuple[str | None, str | None],
    val: tuple[str | None, str | None],
    max_partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and validation windows of one table, each with its own partition cap."""
    parts = [scan_window(df, *train), scan_window(df, *val)]
    if max_partitions:
        parts = [cap_partitions(p, max_partitions) for p in parts]
    return parts[0], parts[1]


def load_combined(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The modelling window, or the whole table when the window holds no rows."""
    window = scan_window(df, start, end)
    return df if window.isEmpty() else window


def head_sample(df: DataFrame, n: int, ident: str = "row_id") -> DataFrame:
    """First ``n`` rows in (datetime, row) order, without a full sort."""
    return first_rows(df, n, ["datetime", ident])


def datetime_from_path(path: Column) -> Column:
    """Timestamp in a ``datetime=yyyy-MM-dd-HH-mm`` path element, null when absent."""
    text = F.regexp_extract(path, r"datetime=(\d{4}-\d{2}-\d{2}-\d{2}-\d{2})", 1)
    stamp = F.nullif(text, F.lit(""))
    return F.try_to_timestamp(stamp, F.lit(DATETIME_FORMAT)).cast("timestamp_ntz")


def with_path_datetime(df: DataFrame) -> DataFrame:
    """Add ``path_datetime`` taken from each row's own input file."""
    return df.withColumn("path_datetime", datetime_from_path(F.col("_metadata.file_path")))


def readable_files(spark: SparkSession, path: str, column: str, kind: str | None = None) -> DataFrame:
    """Input files in which ``column`` can be read: (file_name, rows, labelled).

    Unreadable files are skipped by the reader; files lacking the column show
    up as all-null and are filtered out. With the column's type (``kind``) only
    that column is opened; without it the schemas of all files are merged.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    reader = reader.schema(f"`{column}` {kind}") if kind else reader.option("mergeSchema", "true")
    df = reader.parquet(path)
    return (
        df.select(F.col("_metadata.file_name").alias("file_name"), column)
        .groupBy("file_name")
        .agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("labelled"))
        .where("labelled > 0")
    )


def file_report(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """(file_path, status, rows, labelled) of every input file.

    ``read``: the column has values. ``no values``: the file is sound but lacks
    the column or has nulls only. ``skipped``: nothing came out of it, because it
    is broken, cut off or empty. Files are listed without being opened; the
    reader opens that one column of each and goes on past those it cannot read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_path"))
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").schema(f"`{column}` {kind}")
    own = F.col("_metadata.file_path").alias("file_path")
    counts = reader.parquet(path).select(own, column).groupBy("file_path").agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("labelled"))
    status = F.when(F.col("rows").isNull(), "skipped").when(F.col("labelled") == 0, "no values").otherwise("read")
    joined = listed.join(counts, "file_path", "left")
    return joined.select("file_path", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "labelled")])


def pick_groups(
    df: DataFrame, column: str, n: int, seed: int = 42, portable: bool = False
) -> DataFrame:
    """Rows of ``n`` values of ``column`` (files, hours) drawn without replacement."""
    drawn = (
        df.select(column)
        .distinct()
        .orderBy(sample_key(column, seed, portable), column)
        .limit(n)
    )
    return lookup(df, settle(drawn, "drawn"), column, spread=df.columns[0], how="left_semi")


def limit_rows(df: DataFrame, n: int | None, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """First ``n`` rows in a stated order; all rows when ``n`` is None."""
    return df if n is None else first_rows(df, n, order)


def drop_missing_keys(df: DataFrame, keys: Sequence[str] = ("row_id", "datetime")) -> DataFrame:
    """Purge rows without the identifying columns."""
    return df.dropna(subset=[k for k in keys if k in df.columns])
