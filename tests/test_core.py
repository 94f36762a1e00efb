import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortal.core import (
    cut_per_group,
    lookup,
    nth_values,
    quantile_table,
    quantiles,
    running_totals,
    sample_key,
    scratch_dir,
    settle,
    value_counts,
)

PROBS = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]


def heavy_frame(spark, n=3000):
    """A third of the rows share one group; most values are zero."""
    return spark.range(n).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 11))).alias("g"),
        F.when(F.col("id") % 10 < 6, 0.0).otherwise((F.col("id") * 37 % 1009) / 4.0).alias("v"),
    )


def test_settle_round_trip(spark):
    df = heavy_frame(spark, 50)
    out = settle(df)
    assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
    assert scratch_dir(spark) == scratch_dir(spark)


@pytest.mark.parametrize("large", [False, True])
def test_quantiles_equal_numpy(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    df = heavy_frame(spark)
    v = df.toPandas()["v"].to_numpy()
    assert quantiles(df, "v", PROBS) == pytest.approx(list(np.quantile(v, PROBS)), abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(heavy_frame(spark).where("v < 0"), "v", [0.5]) is None


@pytest.mark.parametrize("large", [False, True])
def test_quantile_table_equals_pandas(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    df = heavy_frame(spark)
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantile_table(df, "v", [0.25, 0.7], ["g"]).collect()}
    want = df.toPandas().groupby("g")["v"].quantile([0.25, 0.7]).to_dict()
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize("large", [False, True])
def test_running_totals(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    counts = value_counts(heavy_frame(spark), "v", ["g"])
    got = running_totals(counts, "v", ["n"], ["g"]).toPandas().sort_values(["g", "v"])
    assert (got.groupby("g")["n"].cumsum() == got["n_upto"]).all()
    assert (got.groupby("g")["n"].transform("sum") == got["n_all"]).all()


def test_range_slices_are_really_cut(spark, large_paths, many_slices):
    counts = value_counts(heavy_frame(spark), "v", ["g"])
    slices = counts.repartitionByRange("g", "v").select(F.spark_partition_id().alias("s")).distinct().count()
    assert slices > 1


def test_nth_values(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (9,)], "x int")
    assert nth_values(value_counts(df, "x"), "x", [0, 1, 2, 3]) == {0: 1, 1: 1, 2: 3, 3: 9}


@pytest.mark.parametrize("large", [False, True])
def test_lookup_with_hot_and_null_keys(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
    rows = heavy_frame(spark).withColumn("g", F.when(F.col("row_id") % 7 != 0, F.col("g")))
    stats = settle(rows.groupBy("g").agg(F.sum("v").alias("total")))
    got = lookup(rows, stats, "g", spread="row_id").toPandas()
    assert len(got) == 3000 and list(got.columns) == ["row_id", "g", "v", "total"]
    want = got.groupby("g", dropna=False)["v"].transform("sum")
    assert np.allclose(got["total"], want)


def test_lookup_spreads_a_hot_key(spark, large_paths, many_slices):
    rows = heavy_frame(spark)
    stats = settle(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    hot = lookup(rows, stats, "g", spread="row_id").where("g = 'hot'")
    sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 1000


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("portable", [False, True])
@pytest.mark.parametrize("bits", [None, 3])
def test_cut_per_group_equals_row_number(spark, request, large, portable, bits):
    if large:
        request.getfixturevalue("large_paths")
    df = heavy_frame(spark)
    key = sample_key("row_id", 7, portable)
    got = cut_per_group(df, ["g"], key, "row_id", lambda n: F.floor(n * 0.37), bits=bits).toPandas()
    keyed = df.withColumn("key", key).toPandas()
    keyed["rank"] = keyed.sort_values(["key", "row_id"]).groupby("g").cumcount()
    keyed["want"] = (keyed.groupby("g")["row_id"].transform("count") * 0.37).astype(int)
    expected = keyed[keyed["rank"] < keyed["want"]]["row_id"]
    assert set(got[got["picked"]]["row_id"]) == set(expected)


def test_cut_bounds_and_layout(spark):
    df = heavy_frame(spark, 200)
    cut = lambda d, k: {
        r["row_id"]
        for r in cut_per_group(d, [], sample_key("row_id"), "row_id", lambda n: F.lit(k)).where("picked").collect()
    }
    assert cut(df, 0) == set() and len(cut(df, 500)) == 200
    assert cut(df.repartition(1), 40) == cut(df.repartition(16), 40) and len(cut(df, 40)) == 40


def test_sample_key_range(spark):
    keys = heavy_frame(spark).select(sample_key("row_id").alias("a"), sample_key("row_id", portable=True).alias("b"))
    row = keys.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.count_distinct("a")).first()
    assert row[0] >= 0 and row[2] >= 0 and row[1] < 1 << 60 and row[3] < 1 << 60 and row[4] == 3000


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        scratch_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "hdfs:///shared/")
    assert scratch_dir(Session()) == "hdfs:///shared"
