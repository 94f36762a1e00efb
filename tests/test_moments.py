"""Matrices of sums against direct arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortal.operators import moments
from cohortal.operators.profiling import correlations
from cohortal.operators.selection import importances, lasso_weights


def gappy(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.gauss(1e6, 3)  # a large mean against a small spread
        b = a * 2 + rng.gauss(0, 1)
        c = rng.random()
        rows.append([None if rng.random() < 0.2 else v for v in (a, b, c, 5.0, float(i % 3))])
    return rows


def direct(rows, i, j):
    pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
    if not pairs:
        return None
    x, y = np.array(pairs).T
    if x.std() < 1e-12 * max(1, abs(x.mean())) or y.std() < 1e-12 * max(1, abs(y.mean())):
        return None
    return float(np.corrcoef(x, y)[0, 1])


def test_correlations_equal_pairwise_complete_ones(spark):
    rows = gappy(1)
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    names = list(df.columns)
    found = {(r.feature_a, r.feature_b): r["corr"] for r in correlations(df, names).collect()}
    assert len(found) == 10
    for (a, b), value in found.items():
        expected = direct(rows, names.index(a), names.index(b))
        assert value == (pytest.approx(expected, abs=1e-9) if expected is not None else None)
    assert found["a", "d"] is None and found["a", "b"] > 0.9


def test_correlations_of_odd_tables(spark):
    schema = "a double, b double"
    for rows in ([], [(None, None)], [(1.0, 2.0)], [(1.0, None), (None, 2.0)]):
        assert correlations(spark.createDataFrame(rows, schema), ["a", "b"]).first()["corr"] is None
    nan = spark.createDataFrame([(float("nan"), 1.0, 2.0), (1.0, 2.0, 4.0), (3.0, 5.0, 10.0)], "a double, b double, c double")
    found = {(r.feature_a, r.feature_b): r["corr"] for r in correlations(nan, ["a", "b", "c"]).collect()}
    assert found["a", "b"] is None and found["b", "c"] == pytest.approx(1.0)
    assert correlations(nan, ["a"]).count() == 0


def test_many_columns_take_one_pass_over_the_rows(spark):
    wide = spark.range(50).select(*[F.sin(F.col("id") * (k + 1)).alias(f"x{k}") for k in range(200)])
    found = correlations(wide, wide.columns)
    assert found.count() == 200 * 199 // 2
    x = np.array([[math.sin(i * (k + 1)) for k in range(200)] for i in range(50)])
    expected = np.corrcoef(x.T)
    for r in found.where("feature_a IN ('x3', 'x77')").collect():
        assert r["corr"] == pytest.approx(expected[int(r.feature_a[1:]), int(r.feature_b[1:])], abs=1e-9)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    x[:, 5] = x[:, 0] + 0.1 * rng.normal(size=400)
    y = 3 * x[:, 0] - 2 * x[:, 2] + rng.normal(size=400)
    gram, target = x.T @ x / 400, x.T @ y / 400
    for penalty in (5.0, 0.5, 0.05):
        w = moments.lasso_from_sums(gram, target, penalty, np.zeros(6))
        slope = target - gram @ w
        assert np.all(np.abs(slope) <= penalty + 1e-6)
        assert np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), atol=1e-6)


def test_lasso_path_errors_equal_direct_ones():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(90, 3)) * [1, 5, 0.2] + [0, 2, 9], rng.normal(size=90)
    y = y + 2 * x[:, 0]
    folds = rng.integers(0, 3, 90)
    v = np.column_stack([np.ones(90), x, y])
    weights, penalty, errors = moments.lasso_path([v[folds == f].T @ v[folds == f] for f in range(3)], 4, 0.01)
    expected = np.zeros(4)
    scaled = (x - x.mean(0)) / x.std(0)
    penalties = np.abs(scaled.T @ (y - y.mean()) / 90).max() * 0.01 ** (np.arange(4) / 3)
    for f in range(3):
        own, held = folds != f, folds == f
        m, s = x[own].mean(0), x[own].std(0)
        z, t = (x[own] - m) / s, y[own] - y[own].mean()
        for k, p in enumerate(penalties):
            w = moments.lasso_from_sums(z.T @ z / own.sum(), z.T @ t / own.sum(), p, np.zeros(3))
            miss = y[held] - y[own].mean() - ((x[held] - m) / s) @ w
            expected[k] += math.sqrt((miss**2).mean()) / 3
    assert errors == pytest.approx(expected.tolist(), rel=1e-6) and penalty == pytest.approx(penalties[int(expected.argmin())])
    assert abs(weights[0]) > 1.5


def test_lasso_importances(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random() * 100, None if i % 9 == 0 else rng.random(), 7.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double").withColumn("y", F.col("a") * 4 + F.col("b") * 0.02)
    w = dict(zip("abcf", lasso_weights(df, ["a", "b", "c", "flat"], "y")))
    assert w["a"] == pytest.approx(4, abs=0.05) and w["b"] == pytest.approx(0.02, abs=0.001) and abs(w["c"]) < 0.05 and w["f"] == 0
    found = importances(df, ["a", "b", "c", "flat"], "y", method="lasso", task="regression").collect()
    assert found[0].feature == "a" and found[-1].feature == "flat"
    assert lasso_weights(df.limit(0), ["a", "b"], "y") == [0.0, 0.0]
