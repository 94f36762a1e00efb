from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cohortal.models.distill import _fit
from cohortal.operators.target_stats import ordered_stats


def test_trees_read_written_vectors(spark):
    """A fit scans vectors and labels alone, not the joins that make them, and learns the same trees."""
    seen = []

    class Seen(GBTRegressor):
        def fit(self, dataset, params=None):
            seen.append((dataset.columns, dataset._jdf.queryExecution().optimizedPlan().toString()))
            return super().fit(dataset, params)

    size = dict(featuresCol="features", labelCol="p", maxIter=2, maxDepth=2, seed=1)
    rows = spark.range(120).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 5 / 5.0).alias("p"), F.lit("w").alias("wide"))
    made = _fit(rows, ["x"], ["c"], Seen(**size), "p", 0.5, "row_id")
    assert seen[0][0] == ["features", "p"] and "Join" not in seen[0][1]
    vector = VectorAssembler(inputCols=["x", "c_ts"], outputCol="features", handleInvalid="keep")
    plain = GBTRegressor(**size).fit(vector.transform(ordered_stats(rows, ["c"], "p", "row_id", 0.5)))
    assert made.pipeline.stages[-1].toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    assert made.transform(rows).where("prediction is not null").count() == 120
