import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortal.functions import gates, nested, scalars
from cohortal.plans.prepare import flatten_nested


def test_map_aggregates_hand_vectors(spark):
    df = spark.createDataFrame(
        [(1, {"a": 10.5, "b": 3.2}), (2, None), (3, {}), (4, {"a": 7.0})], "id int, m map<string,double>"
    )
    got = {r["id"]: r.asDict() for r in nested.flatten_maps(df, ["m"]).collect()}
    assert got[1]["m_mean"] == pytest.approx(6.85) and got[1]["m_std"] == pytest.approx(3.65)
    assert (got[1]["m_max"], got[1]["m_min"], got[1]["m_count"]) == (10.5, 3.2, 2)
    for empty in (2, 3):
        assert [got[empty][f"m_{s}"] for s in nested.MAP_AGGREGATES] == [0, 0, 0, 0, 0]
    assert got[4]["m_std"] == 0 and got[4]["m_mean"] == 7.0


def test_map_values_that_do_not_cast_are_left_out(spark):
    df = spark.createDataFrame([({"a": "4", "b": "x", "c": None, "d": "6"},)], "m map<string,string>")
    row = nested.flatten_maps(df, ["m"]).first()
    assert row["m_mean"] == 5.0 and row["m_count"] == 2


def test_list_counts(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "a"],), ([],), (None,)], "l array<string>")
    assert [tuple(r) for r in nested.flatten_lists(df, ["l"]).collect()] == [(3, 3), (2, 1), (0, 0), (0, 0)]


def test_session_stats(spark):
    df = spark.createDataFrame(
        [([("h1", 5.0), ("h2", 3.0)],), ([("h1", None)],), (None,)], "s array<struct<key:string,value:double>>"
    )
    assert [tuple(r) for r in nested.flatten_sessions(df, ["s"]).collect()] == [
        (8.0, 4.0, 5.0, 2), (0.0, 0.0, 0.0, 0), (0.0, 0.0, 0.0, 0)
    ]


def test_histogram(spark):
    df = spark.createDataFrame(
        [({"US": 100.0, "UK": 50.0, "DE": 30.0},), ({"US": 0.0},), (None,)], "h map<string,double>"
    )
    rows = nested.flatten_histograms(df, ["h"]).collect()
    assert list(rows[0])[:5] == [100, 50, 30, 0, 0] and rows[0]["h_entropy"] == pytest.approx(0.9810, abs=1e-4)
    assert list(rows[1]) == [0] * 6 and list(rows[2]) == [0] * 6


def test_item_entropy_equals_counter(spark):
    lists = [["a", "b", "a", "c", "a"], ["x"], [None, "a", None], [], None]
    df = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    for items, row in zip(lists, nested.compress_lists(df, ["l"]).collect()):
        if not items:
            assert list(row) == [0, 0, 0]
            continue
        counts = np.array([items.count(i) for i in set(items)])
        p = counts / counts.sum()
        assert row["l_len"] == len(items) and row["l_mean"] == pytest.approx(counts.mean())
        assert row["l_entropy"] == pytest.approx(-(p * np.log(p + 1e-9)).sum())


def test_recency(spark):
    df = spark.createDataFrame(
        [("2025-09-15",), (None,), ("no date",), ("2025-10-08 06:00:00",)], "t string"
    ).select(F.try_to_timestamp("t").alias("t"))
    days = scalars.days_ago(F.col("t"), F.lit("2025-10-08").cast("timestamp"))
    rows = df.select(days.alias("d"), scalars.recency_weight(days).alias("w")).collect()
    assert [r["d"] for r in rows] == [23, 9999, 9999, -1]
    assert rows[0]["w"] == pytest.approx(0.4646, abs=1e-4) and rows[1]["w"] < 1e-100


def test_scalar_casts(spark):
    df = spark.createDataFrame([("15.4",), ("x",), (None,), ("7",), (" 9.1",), ("",)], "s string")
    out = df.select(scalars.os_major("s").alias("m"), scalars.to_number("s").alias("n")).collect()
    assert [r["m"] for r in out] == [15, -1, -1, 7, 9, -1]
    assert [r["n"] for r in out][:4] == [15.4, 0.0, 0.0, 7.0]


def test_hash_category_is_stable_and_null_safe(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("__missing__",)], "c string")
    for portable in (False, True):
        codes = [r[0] for r in df.select(scalars.hash_category("c", portable)).collect()]
        assert codes[0] == codes[1] != codes[2] and codes[2] == codes[3]


@pytest.mark.parametrize("edges", [[1.0], [0.0, 0.5, 2.0], list(np.linspace(0, 9, 31))])
def test_bins_equal_numpy(spark, edges):
    values = sorted({*edges, *np.linspace(-1, 10, 57)})
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select(
        scalars.bin_right_open(F.col("v"), edges).alias("o"), scalars.bin_right_closed(F.col("v"), edges).alias("c")
    ).toPandas()
    assert list(got["o"]) == list(np.digitize(values, edges))
    assert list(got["c"]) == [max(0, int(np.searchsorted(edges, v, side="left")) - 1) for v in values]


def gate_frame(spark):
    rng = np.random.default_rng(3)
    rows = [(float(p), *map(float, v)) for p, v in zip(rng.random(200), rng.gamma(1.0, 5.0, (200, 3)))]
    return spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (1.0, 3.0, 2.0, 1.0), *rows], "p double, d1 double, d7 double, d14 double")


def test_order_holds_and_is_idempotent(spark):
    once = gates.enforce_order(gate_frame(spark), ["d1", "d7", "d14"])
    assert once.where("d1 > d7 OR d7 > d14").count() == 0
    assert gates.enforce_order(once, ["d1", "d7", "d14"]).exceptAll(once).count() == 0


def test_gate_range_and_cutoff(spark):
    out = gate_frame(spark).select("p", gates.gate(F.col("p"), 1.25, 0.8, 0.3).alias("g")).toPandas()
    want = np.where(np.minimum(out["p"], 0.8) <= 0.3, 0.0, np.minimum(out["p"], 0.8) ** 1.25)
    assert np.allclose(out["g"], want)


def test_whale_multiplier_bounds(spark):
    m = gates.whale_multiplier(F.col("p"), 2.0, 1.0, 2.2, 0.8, 0.95, 0.35)
    out = gate_frame(spark).select("p", m.alias("m")).toPandas()
    assert out["m"].between(1.0, 2.2).all() and (out[out["p"] <= 0.35]["m"] == 1.0).all()


def test_expected_value_of_broken_predictions(spark):
    df = spark.createDataFrame([(0.5, float("nan")), (0.5, float("inf")), (0.5, -3.0), (1.0, math.log(5.0))], "p double, g double")
    got = [r[0] for r in df.select(gates.expected_value(F.col("p"), F.col("g"))).collect()]
    assert got[:3] == [0.0, 1000.0, 0.0] and got[3] == pytest.approx(4.0)


def test_meta_features_without_whale(spark):
    df = gate_frame(spark).withColumnRenamed("p", "buyer_proba")
    made = gates.meta_features(df, {"d1": "d1", "d7": "d7"}, {"d1": 0.3, "d7": 0.5}, {"cap": 0.8, "cutoff": 0.1, "power": 1.2})
    out = df.select(*made).toPandas()
    assert "whale_proba" not in out and {"revenue_d1", "revenue_d7", "weighted_revenue"} <= set(out)
    assert (out["gated_revenue"] <= out["revenue_d7"]).all()


def test_flatten_decides_by_type(spark):
    df = spark.sql(
        "SELECT 1 AS row_id, array('a','b') AS last_buy_ts_bundle, timestamp '2025-10-01' AS last_install_ts_bundle, "
        "map('k', 2.0d) AS cpm, array(named_struct('key','h','value',2.0d)) AS avg_duration, "
        "map('US', 3.0d) AS country_hist, 'x' AS carrier"
    )
    row = flatten_nested(df).first().asDict()
    assert row["last_buy_ts_bundle_count"] == 2 and row["last_install_ts_bundle_days_ago"] == 7
    assert row["cpm_mean"] == 2.0 and row["avg_duration_total"] == 2.0 and row["country_hist_top1_freq"] == 3.0
    assert "last_buy_ts_bundle" not in row and "cpm" not in row and row["carrier"] == "x"


def test_statistics_work_out_mean_and_total_once_per_row(spark):
    """A mean or total inside the lambda of another fold is worked out for every element, which is quadratic."""
    df = spark.createDataFrame([({"a": 1.0, "b": 3.0}, {"x": 2.0, "y": 6.0})], "m map<string,double>, h map<string,double>")
    folds = lambda plan: plan._jdf.queryExecution().analyzed().toString().split("\n")[0].count("aggregate(")
    assert folds(nested.flatten_maps(df, ["m"], ["std"])) == 2  # the total and the squares
    assert folds(nested.flatten_histograms(df, ["h"])) == 3  # the total in the test and in the fold, and the fold
    assert tuple(nested.flatten_maps(df, ["m"], ["std"]).first())[1:] == (1.0,)
    entropy = nested.flatten_histograms(df, ["h"]).first()["h_entropy"]
    assert entropy == pytest.approx(-0.25 * math.log(0.25) - 0.75 * math.log(0.75))
