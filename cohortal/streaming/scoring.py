"""Score hourly files as they arrive.

The fitted chain only projects columns, so the batch plan runs unchanged on a
stream; file tracking and restart come from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cohortal.plans.training import TrainedRun


def score_arriving(
    spark: SparkSession,
    run: TrainedRun,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    files_per_batch: int = 1_000,
    once: bool = True,
) -> StreamingQuery:
    """Read new parquet files, score their rows, append CSV predictions.

    ``once`` drains what is there and stops; otherwise the query keeps waiting.
    """
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
    )
    writer = (
        run.score(rows)
        .writeStream.format("csv")
        .option("header", "true")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start(sink)


def score_chunks(
    spark: SparkSession,
    score: Callable[[DataFrame], DataFrame],
    source: str,
    schema: StructType | str,
    sink: str,
    checkpoint: str,
    files_per_chunk: int = 1_000,
) -> StreamingQuery:
    """Score a large table chunk by chunk so that a run that was killed goes on where it stopped.

    Chunks are micro-batches of new files, in the order they are listed. A chunk
    is written to its own folder, ``batch=<number>``, which its next attempt
    replaces, and the checkpoint gives a chunk the same files and number at each
    attempt; so every row is written once, whether the stop came before, during
    or after a write. Files that arrive later become further chunks. ``score``
    returns the columns to write as CSV.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(source)

    def write(chunk: DataFrame, number: int) -> None:
        score(chunk).write.mode("overwrite").option("header", "true").csv(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
