"""Nearest-neighbour mutual information against a comparison of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortal.operators.neighbours import digamma, nearest_mi


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def brute(rows, k=3):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and x == x]
    size = {}
    for _, y in rows:
        size[y] = size.get(y, 0) + 1
    rows = [(x, y) for x, y in rows if size[y] > 1]
    if not rows:
        return 0.0
    total = 0.0
    for i, (x, y) in enumerate(rows):
        used = min(k, size[y] - 1)
        d = sorted(abs(x - a) for j, (a, b) in enumerate(rows) if b == y and j != i)[used - 1]
        m = sum(abs(x - a) < d or a == x for a, _ in rows)
        total += psi(used) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    out = spark.range(1, 400).select("id", digamma(F.col("id")).alias("v")).collect()
    assert all(r.v == pytest.approx(psi(r.id), abs=1e-9) for r in out)


@pytest.mark.parametrize("large", [False, True])
def test_estimates_equal_brute_force(spark, request, large):
    if large:
        request.getfixturevalue("large_paths")
        request.getfixturevalue("many_slices")
    rng = random.Random(5)
    rows = []
    for _ in range(260):
        y = rng.choice(["a", "a", "b", None, "c"])
        rows.append((rng.choice([None, float(rng.randrange(6))]), float(rng.randrange(4000)) / 64 + (20 if y == "b" else 0), float(rng.random() < 0.7) * 3, y))
    rows.append((1.0, 2.0, 3.0, "only one"))
    df = spark.createDataFrame(rows, "few double, many double, hot double, y string")
    found = {r.feature: r.mi for r in nearest_mi(df, ["few", "many", "hot"], "y").collect()}
    for c, name in enumerate(("few", "many", "hot")):
        assert found[name] == pytest.approx(brute([(r[c], r[3]) for r in rows]), abs=1e-9)
    assert found["many"] > 0.1


def test_odd_tables(spark):
    schema = "x double, flat double, y int"
    for rows in ([], [(1.0, 1.0, 1)], [(None, 1.0, None)], [(float("nan"), 2.0, 1), (float("nan"), 2.0, 1)]):
        found = {r.feature: r.mi for r in nearest_mi(spark.createDataFrame(rows, schema), ["x", "flat"], "y").collect()}
        assert set(found) == {"x", "flat"} and all(v == pytest.approx(0.0, abs=1e-9) for v in found.values())
    sure = spark.range(400).select(F.col("id").cast("double").alias("x"), (F.col("id") >= 200).cast("int").alias("y"))
    assert nearest_mi(sure, ["x"], "y").first().mi == pytest.approx(math.log(2), abs=0.02)
