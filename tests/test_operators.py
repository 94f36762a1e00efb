import math
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortal.core import settle
from cohortal.operators import features, metrics, missing, profiling, sampling, search, selection, splits
from cohortal.plans.scoring import validate_submission
from cohortal.sources.views import impressions, scored


@pytest.fixture(scope="module")
def imp(spark, sf_dir):
    return impressions(spark, sf_dir)


@pytest.fixture(scope="module")
def preds(spark, sf_dir):
    return scored(spark, sf_dir)


# --- missing ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("column", "is_text", "strategy"),
    [
        ("country", True, "zero"), ("dev_ctry", True, "zero"), ("wifi_ratio", False, "median"),
        ("last_buy", False, "zero"), ("region_hist", False, "zero"), ("region", False, "mode"), ("last_seen", False, "large_value"),
        ("avg_act_days", False, "median"), ("dev_os", True, "mode"), ("dev_os", False, "mode"),
        ("x_encoded", False, "special_value"), ("plain", False, "median"), ("plain", True, "mode"),
        ("entropy_x", False, "zero"), ("score_mean_x", False, "zero"),
    ],
)
def test_strategy_rules(column, is_text, strategy):
    assert missing.strategy_for(column, is_text) == strategy


def test_imputer_fit_and_replay(spark):
    rows = [(1, "a", 1.0, None, 4), (2, "b", None, 2.0, None), (3, "None", 5.0, None, 6), (4, "b", 9.0, 1.0, 4), (5, "", 2.0, 3.0, 4)]
    df = spark.createDataFrame(rows, "id int, kind string, wifi_ratio double, last_seen double, digit int")
    fitted = missing.fit_imputer(df)
    assert fitted.values == {"kind": "b", "wifi_ratio": 3.5, "last_seen": 9999, "digit": 4.0}
    out = missing.apply_imputer(df, fitted).orderBy("id").collect()
    assert [r["kind"] for r in out] == ["a", "b", "b", "b", "b"]
    assert out[1]["wifi_ratio"] == 3.5 and out[0]["last_seen"] == 9999 and out[1]["digit"] == 4
    part = missing.apply_imputer(df.where("id = 2"), fitted).first()
    assert part == out[1]


def test_unseen_gaps_and_override(spark):
    df = spark.createDataFrame([(None, None, True), ("x", 2.0, None)], "s string, n double, b boolean")
    out = missing.apply_imputer(df, missing.Imputer()).collect()
    assert list(out[0]) == ["missing", 0.0, True] and out[1]["b"] is False
    assert missing.fit_imputer(df, overrides={"n": "large_value"}).values["n"] == 9999


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "kind string")
    assert missing.fit_imputer(df).values == {"kind": "a"}


def test_indicators_are_replayed(spark, imp):
    names = missing.fit_indicators(imp.select("carrier", "wifi_ratio", "value"))
    assert names == ["carrier", "wifi_ratio"]
    one = missing.add_indicators(imp.select("value").limit(1), names).first()
    assert one["carrier_is_missing"] == 1


def test_summary_of_clean_table(spark):
    row = missing.missing_summary(spark.range(3).toDF("a")).first()
    assert (row["missing_cells"], row["columns_with_missing"], row["total_cells"]) == (0, 0, 3)


# --- features -----------------------------------------------------------------------------


@pytest.mark.parametrize("large", [False, True])
def test_local_rank_equals_pandas(imp, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    df = imp.select("row_id", "carrier", F.when(F.col("k") % 5 != 0, F.col("iap_revenue_d14")).alias("t"))
    got = features.add_local_rank(df, "carrier", "t").toPandas().set_index("row_id")
    pdf = df.toPandas().set_index("row_id")
    want = pdf.groupby("carrier")["t"].rank(pct=True).fillna(0.5)
    assert np.allclose(got["carrier_local_spend_rank"].sort_index(), want.sort_index())


def test_target_encoding_formula(spark):
    rows = [("a", 1)] * 3 + [("a", 0)] * 2 + [("b", 1)] + [(None, 0)] * 4
    df = spark.createDataFrame(rows, "c string, y int").withColumn("row_id", F.monotonically_increasing_id())
    table, overall = features.fit_target_encoding(df, "c", "y", min_samples=3)
    got = {r["c"]: r["c_te"] for r in table.collect()}
    for c, n, mean in (("a", 5, 0.6), ("b", 1, 1.0)):
        s = 1 / (1 + math.exp(-(n - 3)))
        assert got[c] == pytest.approx(0.4 * (1 - s) + mean * s)
    out = features.map_stats(df, table, "c", overall).where("c IS NULL").first()
    assert out["c_te"] == pytest.approx(0.4)


@pytest.mark.parametrize("values", [[0.0] * 8 + [1, 2, 3], list(range(40)), [5.0]])
def test_quantile_bins_equal_qcut(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    edges = features.fit_quantile_bins(df, "x")
    got = df.select(features.quantile_bin("x", edges)).toPandas().iloc[:, 0]
    if len(set(values)) > 1:
        want = pd.qcut(pd.Series(values, dtype=float), 10, labels=False, duplicates="drop")
        assert list(got) == list(want)
    else:
        assert list(got) == [0]


def test_align_categories(spark):
    train = spark.createDataFrame([("a",), (None,)], "c string")
    fitted = features.fit_categories(train, ["c"])
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "row_id int, c string")
    got = {r["row_id"]: r["c"] for r in features.align_categories(df, fitted).collect()}
    assert got == {1: "a", 2: None, 3: "__MISSING__"}


def test_flags_and_time_skip_absent_columns(spark):
    df = spark.createDataFrame([(1, 23)], "row_id int, hour int")
    out = features.add_zero_flags(features.add_cyclic_time(df))
    assert "is_weekend" not in out.columns and out.first()["is_night"] == 1


# --- splits and sampling ------------------------------------------------------------------


def test_hash_sample_ignores_layout(imp):
    pick = lambda d: {r["row_id"] for r in splits.hash_sample(d, 0.3).select("row_id").collect()}
    assert pick(imp.repartition(1)) == pick(imp.repartition(13))
    assert 0.25 < len(pick(imp)) / imp.count() < 0.35


def test_stratified_split_is_exact(imp):
    out = splits.stratified_split(imp.select("row_id", "carrier"), 0.8, "carrier").toPandas()
    for _, part in out.groupby("carrier", dropna=False):
        assert (part["split"] == "train").sum() == math.floor(len(part) * 0.8 + 0.5)


def test_split_without_stratum(imp):
    out = splits.stratified_split(imp.select("row_id"), 0.5, "absent")
    assert out.where("split = 'train'").count() == imp.count() // 2


def test_time_split_has_no_overlap(imp):
    out = splits.time_split(imp.select("row_id", "datetime")).toPandas().sort_values(["datetime", "row_id"])
    assert list(out["split"]) == ["train"] * int(len(out) * 0.85) + ["val"] * (len(out) - int(len(out) * 0.85))


def test_overlapping_windows_are_refused(imp):
    with pytest.raises(ValueError):
        splits.temporal_split(imp, ("2024-01-01", "2024-01-09"), ("2024-01-05", "2024-01-12"))


def test_whale_filter_that_empties_the_table(imp):
    with pytest.raises(ValueError):
        splits.drop_whales(imp.where("iap_revenue_d7 > 0"), max_revenue=1.0)


def test_numeric_features_leave_labels_out(imp):
    df = imp.withColumns({"x_local_avg_spend": F.lit(1.0), "is_new": F.lit(True), "retention_x": F.lit(1)})
    names = splits.numeric_features(df)
    assert "is_new" in names and not {"iap_revenue_d7", "buyer_d1", "x_local_avg_spend", "retention_x", "row_id"} & set(names)
    with pytest.raises(ValueError):
        splits.numeric_features(imp.select("row_id", "carrier"))


def test_constant_columns_count_null_as_value(spark):
    df = spark.sql("SELECT id, 1 AS one, IF(id = 0, 1, NULL) AS gap, CAST(NULL AS INT) AS none, map('a', 1) AS m FROM range(3)")
    assert splits.constant_columns(df) == ["one", "none", "m"]
    train, val = splits.drop_constant_columns(df, df.limit(1))
    assert train.columns == val.columns == ["id", "gap"]


def skewed_target(spark):
    return spark.range(2000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 10 != 0, 0.0).otherwise((F.col("id") * 7919 % 1013) / 3.0).alias("y"),
    )


def test_oversampling_equals_numpy(spark):
    df = skewed_target(spark)
    y = df.toPandas()["y"].to_numpy()
    edges = np.unique(np.percentile(y, np.linspace(0, 100, 31)))
    at = np.digitize(y, edges)
    hist = np.array([(at == i).sum() for i in range(1, len(edges))])
    goal = np.percentile(hist, 75)
    copies = sum(max(1, int(goal / hist[i - 1])) if 1 <= i <= len(hist) and hist[i - 1] else 1 for i in at)
    bins = sampling.fit_bins(df, "y", 30, numpy_compat=True)
    assert np.allclose(bins.edges, edges) and bins.counts == list(hist)
    assert sampling.oversample_bins(df, bins, 75.0).count() == copies >= len(y)


def test_binary_label_is_left_alone(spark):
    df = spark.createDataFrame([(float(i >= 97),) for i in range(100)], "y double")
    assert sampling.oversample_bins(df, sampling.fit_bins(df, "y", 30)).count() == 100


def test_undersampling_counts(spark):
    df = skewed_target(spark)
    bins = sampling.fit_bins(df, "y", 30)
    out = sampling.undersample_bins(df, bins, 25.0)
    goal = int(bins.target(25.0))
    got = {r["b"]: r["count"] for r in out.groupBy(bins.bin_of().alias("b")).count().collect()}
    assert got == {i + 1: min(n, goal) if n > bins.target(25.0) else n for i, n in enumerate(bins.counts) if n}
    again = sampling.undersample_bins(df.repartition(9), bins, 25.0)
    assert out.exceptAll(again).count() == 0


def test_undersampling_keeps_or_drops_the_maximum(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "row_id int, y double")
    closed = sampling.undersample_bins(df, sampling.fit_bins(df, "y", 3), 50.0)
    opened = sampling.undersample_bins(df, sampling.fit_bins(df, "y", 3, numpy_compat=True), 50.0)
    assert closed.where("y = 4").count() + closed.where("y = 3").count() >= 1
    assert opened.where("y = 4").count() == 0


def test_constant_target_is_unchanged(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(6)], "row_id int, y double")
    assert sampling.undersample_bins(df, sampling.fit_bins(df, "y"), 25.0).count() == 6


def test_zero_anchors_per_hour(spark):
    rows = [(1, "h1", 0.0, 0, 5.0), (2, "h1", 3.0, 1, 6.0), (3, "h2", 4.0, 1, 7.0), (4, "h2", 5.0, 1, 8.0), (5, "h2", 6.0, 1, 9.0)]
    df = spark.createDataFrame(rows, "row_id long, datetime string, iap_revenue_d7 double, buyer_d7 int, x double")
    out = sampling.zero_anchors(df, 2).toPandas()
    new = out[out["row_id"].str.contains("_za")]
    assert len(new) == 4 and (new["iap_revenue_d7"] == 0).all() and out["row_id"].is_unique
    assert list(new[new["datetime"] == "h1"]["x"]) == [5.0, 5.0]
    synthetic = new[new["datetime"] == "h2"]
    assert (synthetic["x"] == 0).all() and (synthetic["buyer_d7"] == 0).all()


def test_class_ratio_without_positives(spark):
    row = sampling.class_ratio(spark.createDataFrame([(0,), (0,)], "buyer_d7 int")).first()
    assert row["scale_pos_weight"] == 1.0


# --- metrics and searches -----------------------------------------------------------------


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def brute_ap(y, s):
    total, out, seen_recall = y.sum(), 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        chosen = s >= cut
        recall, precision = y[chosen].sum() / total, y[chosen].mean()
        out, seen_recall = out + (recall - seen_recall) * precision, recall
    return out


@pytest.mark.parametrize("large", [False, True])
def test_auc_and_ap_against_brute_force(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute_auc(y, s))
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(brute_ap(y, s))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] is None


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1.0), (3.0, 2.0), (8.0, 8.0)], "y double, p double")
    row = metrics.evaluate(df, "y", "p").first()
    assert row["mae"] == pytest.approx(2 / 3) and row["mape"] == pytest.approx(100 / 6)
    assert row["r2"] == pytest.approx(1 - 2 / np.sum((np.array([0, 3, 8]) - 11 / 3) ** 2))
    assert row["msle"] == pytest.approx((math.log(2) ** 2 + math.log(4 / 3) ** 2) / 3)


def test_searches_equal_a_loop(preds):
    pdf = preds.toPandas()
    y, p, rev = pdf["iap_revenue_d7"], pdf["buyer_proba"], pdf["pred_d7"]
    loss = lambda pred: math.sqrt(np.mean((np.log1p(y) - np.log1p(pred)) ** 2))
    args = ("buyer_proba", "pred_d7", "iap_revenue_d7")
    alphas = {r["alpha"]: r["metric"] for r in search.alpha_curve(preds, *args).collect()}
    cuts = {r["threshold"]: r["metric"] for r in search.threshold_curve(preds, *args).collect()}
    assert len(alphas) == len(cuts) == 100
    for a, m in alphas.items():
        assert m == pytest.approx(loss(p**a * rev))
    for t, m in cuts.items():
        assert m == pytest.approx(loss((p >= t) * rev))
    best = search.best_of(search.alpha_curve(preds, *args), "alpha", 1.0).first()
    assert best["metric"] == pytest.approx(min(alphas.values()))


def test_submission_errors(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3.0)], "row_id long, iap_revenue_d7 double")
    assert validate_submission(df, df).first()["zeros_pct"] == 50.0
    for bad in (df.where("row_id = 1"), df.unionAll(df.limit(1)), df.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(ValueError):
            validate_submission(bad, df)
    with pytest.raises(ValueError):
        validate_submission(df.withColumnRenamed("row_id", "id"), df)


def test_histogram_keeps_every_row(imp):
    found = profiling.histogram(imp, "value", 20).toPandas()
    want, edges = np.histogram(imp.select("value").toPandas()["value"], bins=20)
    assert list(found.sort_values("bin")["n"]) == list(want)
    assert np.allclose(found.sort_values("bin")["low"], edges[:-1])


def test_describe_equals_pandas(imp):
    got = profiling.describe(imp, ["value", "wifi_ratio"]).toPandas().set_index("column_name")
    want = imp.select("value", "wifi_ratio").toPandas().describe().T
    for mine, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert np.allclose(got.loc[want.index, mine], want[theirs])


# --- selection ----------------------------------------------------------------------------


def test_correlated_groups_keep_the_widest(spark):
    df = spark.range(100).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 3.0).alias("b"), F.sin("id").alias("c"), F.lit(1.0).alias("d")
    )
    assert selection.keep_by_variance(df, ["a", "b", "c", "d"]) == ["a", "b", "c"]
    assert selection.keep_by_correlation(df, ["a", "b", "c"]) == ["b", "c"]


def test_keep_by_importance(spark):
    found = spark.createDataFrame([("a", 0.9), ("b", 0.099), ("c", 0.001)], "feature string, importance double")
    assert selection.keep_by_importance(found) == ["a", "b"]
    assert selection.keep_by_importance(found, n_features=1) == ["a"]


def test_importance_and_elimination_find_the_signal(spark):
    df = spark.range(400).select(
        (F.col("id") % 7).cast("double").alias("noise"), (F.col("id") % 20).cast("double").alias("signal"),
        (F.col("id") % 13).cast("double").alias("other"), ((F.col("id") % 20) > 9).cast("int").alias("y"),
    )
    cols = ["noise", "signal", "other"]
    assert selection.importances(df, cols, "y", rounds=3, depth=2).first()["feature"] == "signal"
    assert selection.eliminate_recursively(df, cols, "y", n_features=1, rounds=2) == ["signal"]
    assert selection.keep_top_k(selection.f_scores(df, cols, "y"), "f_value", 1) == ["signal"]
    assert selection.keep_top_k(selection.binned_mutual_information(df, cols, "y"), "mutual_information", 1) == ["signal"]
    doubled = df.withColumn("target", F.col("signal") * 2.0)
    mi = selection.binned_mutual_information(doubled, cols, "target", task="regression")
    assert selection.keep_top_k(mi, "mutual_information", 1) == ["signal"]
    chosen, report = selection.select_features(df, cols, "y", rounds=3)
    assert "signal" in chosen and report.final_features == len(chosen) <= report.initial_features


def test_correlations_use_pairwise_complete_rows(spark):
    rows = [(float(i), None if i % 3 == 0 else i + 50.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    found = {(r.feature_a, r.feature_b): r.corr for r in profiling.correlations(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == pytest.approx(1.0) and found["a", "c"] is None
    assert selection.keep_by_correlation(df, ["a", "b"]) in (["a"], ["b"])


def test_none_text_is_no_mode(spark):
    df = spark.createDataFrame([("None",), ("None",), ("None",), ("x",), ("",), (None,)], "carrier string")
    assert missing.fit_imputer(df, {"carrier": "mode"}).values["carrier"] == "x"
    assert missing.fit_imputer(df, {"carrier": "mode"}, none_is_value=True).values["carrier"] == "None"


@pytest.mark.parametrize("n", [0, 1, 5, 8, 13, 40])
def test_first_rows_without_a_top_k(spark, large_paths, n):
    rows = [(None if i % 5 == 0 else f"h{i % 3}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "datetime string, row_id long")
    found = sys.modules["cohortal.core.ranks"].first_rows(df, n, ["datetime", "row_id"])
    assert sorted(r.row_id for r in found.collect()) == sorted(r.row_id for r in df.orderBy("datetime", "row_id").limit(n).collect())
    if n:
        assert "TakeOrdered" not in found._jdf.queryExecution().toString()


def test_heavy_keys_are_shared_by_their_size(spark, monkeypatch):
    module = sys.modules["cohortal.core.lookup"]
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(module, "ROWS_PER_TASK", 10)
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = spark.range(600).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    out = module.lookup(rows, settle(table), "key", spread="id")
    assert out.count() == 600 and out.where("v <> key * 2").count() == 0
    assert module._shares(200, 4) == 20 and module._shares(3, 4) == 4
