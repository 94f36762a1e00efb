"""Exact isotonic steps against the min-max formula."""

import random

import pytest
from pyspark.sql import functions as F

from cohortal.models.calibration import fit_calibrator
from cohortal.models.isotonic import Stack, isotonic_steps


def min_max(points):
    """Fitted value of every distinct score: the largest, over starts before it, of the smallest mean up to ends behind it."""
    xs = sorted({x for x, _, _ in points})
    t = [sum(w * y for x, y, w in points if x == v) for v in xs]
    n = [sum(w for x, _, w in points if x == v) for v in xs]
    mean = lambda j, k: sum(t[j : k + 1]) / sum(n[j : k + 1])
    return {xs[i]: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))}


@pytest.mark.parametrize("slices", [1, 20])
@pytest.mark.parametrize("kind", ["labels", "numbers"])
def test_steps_equal_the_min_max_formula(spark, many_slices, slices, kind):
    rng = random.Random(slices)
    rows = []
    for _ in range(90):
        x = rng.choice([rng.random(), round(rng.random(), 1), 0.5 + rng.random() * 1e-12])
        y = float(rng.random() < x) if kind == "labels" else rng.gauss(x, 0.5)
        rows.append((x, y, rng.choice([1.0, 2.0, 0.5])))
    df = spark.createDataFrame(rows, "p double, y double, w double")
    steps = isotonic_steps(df, "p", "y", "w", slices=slices).orderBy("low").collect()
    fitted = min_max(rows)
    for x, value in fitted.items():
        own = [s for s in steps if s.low <= x <= s.high]
        assert len(own) == 1 and own[0].value == pytest.approx(value, abs=1e-9)
    assert all(a.high < b.low and a.value < b.value for a, b in zip(steps, steps[1:]))
    assert sum(s.weight for s in steps) == pytest.approx(sum(w for _, _, w in rows))


def test_scores_closer_than_any_rounding_stay_apart(spark):
    rows = [(0.3, 0), (0.3 + 1e-15, 1), (0.3 + 3e-15, 1), (-1e300, 0), (1e300, 1)]
    steps = isotonic_steps(spark.createDataFrame(rows, "p double, y int"), "p", "y").orderBy("low").collect()
    assert [(s.low, s.high, s.value) for s in steps] == [(-1e300, 0.3, 0.0), (0.3 + 1e-15, 1e300, 1.0)]


def test_merging_slices_is_pooling_all_at_once():
    rng = random.Random(3)
    for _ in range(200):
        points = [(float(i), float(rng.randrange(3)), float(rng.randrange(1, 3))) for i in range(rng.randrange(1, 30))]
        whole = Stack()
        for x, y, w in points:
            whole.add(x, x, y * w, w)
        cut, parts = rng.randrange(1, 6), Stack()
        for k in range(0, len(points), cut):
            own = Stack()
            for x, y, w in points[k : k + cut]:
                own.add(x, x, y * w, w)
            for step in own.steps:
                parts.add(*step)
        assert parts.steps == whole.steps


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(None, 1.0), (0.5, None), (nan, 1.0), (0.2, nan), (0.0, 1.0), (-0.0, 0.0)]
    df = spark.createDataFrame(rows, "p double, y double")
    assert [tuple(r) for r in isotonic_steps(df, "p", "y").collect()] == [(0.0, 0.0, 0.5, 2.0)]
    assert isotonic_steps(df.limit(0), "p", "y").count() == 0
    assert isotonic_steps(df.where("p IS NULL"), "p", "y").count() == 0
    hot = spark.range(3000).select(F.lit(0.7).alias("p"), (F.col("id") % 2).alias("y"))
    assert [tuple(r) for r in isotonic_steps(hot, "p", "y").collect()] == [(0.7, 0.7, 0.5, 3000.0)]


def test_calibrator_gives_the_steps_at_the_scores_seen(spark):
    rng = random.Random(6)
    rows = [(x, int(rng.random() < x**2)) for x in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "p double, y int")
    fitted = min_max([(x, y, 1.0) for x, y in rows])
    model = fit_calibrator(df, "p", "y", "isotonic")
    found = model.apply(df.withColumn("raw", F.col("p")), "p").collect()
    assert all(r.p == pytest.approx(fitted[r.raw], abs=1e-9) for r in found)
    outside = model.apply(spark.createDataFrame([(-3.0,), (7.0,)], "p double"), "p").collect()
    assert [r.p for r in outside] == pytest.approx([min(fitted.values()), max(fitted.values())])
