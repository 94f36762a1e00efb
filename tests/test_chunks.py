"""Chunked scoring that is stopped at every possible place."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortal.sources.files import read_predictions
from cohortal.streaming.scoring import score_chunks

SCHEMA = "row_id bigint, value double"


@pytest.mark.parametrize("stop", ["before", "after", "no"])
def test_every_row_is_written_once(spark, tmp_path, stop):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write = lambda a, b: spark.range(a, b).select(F.col("id").alias("row_id"), (F.col("id") * 2.0).alias("value")).repartition(3).write.mode("append").parquet(source)
    write(0, 30)
    calls = []

    def score(chunk):
        calls.append(1)
        out = chunk.select("row_id", (F.col("value") + 1).alias("iap_revenue_d7"))
        if len(calls) == 2 and stop != "no":
            if stop == "after":
                out.write.mode("overwrite").option("header", "true").csv(f"{sink}/batch=1")
            raise RuntimeError("killed")
        return out

    def run():
        query = score_chunks(spark, score, source, SCHEMA, sink, checkpoint, files_per_chunk=1)
        query.awaitTermination(240)

    if stop == "no":
        run()
    else:
        with pytest.raises(StreamingQueryException):
            run()
        run()
    written = lambda: sorted((int(r.row_id), r.iap_revenue_d7) for r in read_predictions(spark, sink).collect())
    assert written() == [(i, i * 2.0 + 1) for i in range(30)]
    done = len(calls)
    run()  # nothing new
    assert len(calls) == done
    write(30, 40)
    run()
    assert written() == [(i, i * 2.0 + 1) for i in range(40)] and len(calls) == done + 3
