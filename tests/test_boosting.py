"""Histogram boosting against plain arithmetic on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortal.models import boosting
from cohortal.models.base import with_vector
from cohortal.models.boosting import BoostedTrees, Growth, Loss, best_splits, fit_boosted, load_boosted
from cohortal.models.revenue import train_revenue
from cohortal.operators.metrics import evaluate

PLAIN = Growth(rounds=4, depth=3, rate=0.3, l2=0.5, min_rows=3)


def table(spark, n=400, seed=1, targets=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([0.0, 1.0, 2.5, 7.0]), rng.random(), float(rng.randrange(50))]
        y = [max(0.0, 3 * x[0] + (20 if x[2] > 30 else 0) + rng.random()) * (rng.random() < 0.8) + t for t in range(targets)]
        rows.append((x, *[None if rng.random() < 0.1 and targets > 1 else v for v in y], rng.random() < 0.25))
    names = ", ".join(f"y{t} double" for t in range(targets))
    df = spark.createDataFrame(rows, f"x array<double>, {names}, held boolean")
    return df.select(array_to_vector("x").alias("features"), "*"), rows


def derivatives(loss, y, s):
    """By central differences of the loss."""
    p, e = loss.power, 1e-4
    value = {
        "tweedie": lambda s: math.exp((2 - p) * s) / (2 - p) - y * math.exp((1 - p) * s) / (1 - p),
        "huber": lambda s: 0.5 * (s - y) ** 2 if abs(s - y) <= loss.delta else loss.delta * (abs(s - y) - 0.5 * loss.delta),
        "logistic": lambda s: math.log1p(math.exp(s)) - y * s,
        "squared": lambda s: 0.5 * (s - y) ** 2,
    }[loss.name]
    return value(s), (value(s + e) - value(s - e)) / (2 * e), (value(s + e) - 2 * value(s) + value(s - e)) / e**2


@pytest.mark.parametrize("name", boosting.LOSSES)
def test_losses_are_what_their_derivatives_say(spark, name):
    loss = Loss(name)
    cases = [(y, s) for y in (0.0, 1.0) + ((7.5,) if name != "logistic" else ()) for s in (-1.3, 0.2, 2.0)]
    y, s = F.col("y"), F.col("s")
    out = spark.createDataFrame(cases, "y double, s double").select("y", "s", loss.value(y, s), loss.gradient(y, s), loss.hessian(y, s))
    for row in out.collect():
        value, first, second = derivatives(loss, row[0], row[1])
        assert row[2] == pytest.approx(value, rel=1e-6) and row[3] == pytest.approx(first, abs=1e-3)
        if name != "huber":  # whose second derivative is replaced by 1
            assert row[4] == pytest.approx(second, abs=1e-3)


def test_first_tree_is_the_best_greedy_tree(spark):
    df, rows = table(spark)
    edges = [[1.0, 2.5, 7.0], [0.25, 0.5, 0.75], [10.0, 20.0, 30.5]]
    loss = Loss("squared")
    model = fit_boosted(df, ["y0"], loss, Growth(rounds=1, depth=2, rate=1.0, l2=0.5, min_rows=3), edges=edges)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert model.starts == [pytest.approx(y.mean())]

    def grow(own, depth):
        g, h = (y.mean() - y[own]).sum(), own.sum()
        leaf = -g / (h + 0.5)
        if depth == 0:
            return leaf
        best = (1e-9, None)
        for f in range(3):
            for e in edges[f]:
                left = own & (x[:, f] < e)
                gl, hl = (y.mean() - y[left]).sum(), left.sum()
                if min(hl, h - hl) >= 3:
                    gain = gl**2 / (hl + 0.5) + (g - gl) ** 2 / (h - hl + 0.5) - g**2 / (h + 0.5)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, e))
        if best[1] is None:
            return leaf
        f, e = best[1]
        return (f, e, grow(own & (x[:, f] < e), depth - 1), grow(own & (x[:, f] >= e), depth - 1))

    def shape(tree, k=0):
        return tree[k][0] if len(tree[k]) == 1 else (tree[k][0], tree[k][2], shape(tree, int(tree[k][3])), shape(tree, int(tree[k][4])))

    def close(a, b):
        return a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3]) if isinstance(a, tuple) else a == pytest.approx(b)

    assert close(shape(model.trees[0][0]), grow(np.ones(len(y), bool), 2))


def test_training_margins_equal_the_scored_model(spark, monkeypatch):
    """Trees over bins during training and over values when scoring give the same predictions, whenever margins are written down."""
    df, _ = table(spark)
    found = []
    for hold in (1, 3):
        monkeypatch.setattr(boosting, "HOLD_ROUNDS", hold)
        model = fit_boosted(df, ["y0"], Loss("tweedie"), PLAIN)
        found.append([r.p for r in model.transform(df.select("features"), ["p"]).collect()])
    assert found[0] == pytest.approx(found[1]) and len(set(found[0])) > 5
    flat = evaluate(df.withColumn("p", F.lit(sum(found[0]) / len(found[0]))), "y0", "p").first()["mae"]
    fitted = evaluate(model.transform(df, ["p"]), "y0", "p").first()["mae"]
    assert fitted < 0.8 * flat


def test_targets_are_fitted_as_if_alone(spark):
    df, _ = table(spark, targets=3)
    joint = fit_boosted(df, ["y0", "y1", "y2"], Loss("huber"), PLAIN)
    for t in range(3):
        edges = boosting.quantile_edges(df.select("x"), 3, PLAIN.bins)
        alone = fit_boosted(df, [f"y{t}"], Loss("huber"), PLAIN, edges=edges)
        assert alone.starts[0] == joint.starts[t]
        for a, b in zip(alone.trees[0], joint.trees[t], strict=True):
            assert [n[:2] for n in a] == [n[:2] for n in b] or np.allclose([n[-1] for n in a], [n[-1] for n in b])


def test_best_round_is_the_minimum_of_the_curve(spark):
    """Noise labels: the held-out loss turns up, fitting stops after the patience and later trees go."""
    rng = random.Random(4)
    rows = [([rng.random(), rng.random(), rng.random()], float(rng.random() < 0.5), i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "x array<double>, y double, held boolean").withColumn("features", array_to_vector("x"))
    growth = Growth(rounds=30, depth=3, rate=0.5, l2=0.1, min_rows=2, patience=3)
    model = fit_boosted(df, ["y"], Loss("logistic"), growth, validation="held")
    losses = [c[0] for c in model.curve]
    best = losses.index(min(losses))
    assert model.best_rounds == [best + 1] and len(losses) == best + 1 + 3 < 30
    held = df.where("held")
    p = F.col("p")
    logloss = model.transform(held, ["p"]).agg(F.avg(-F.col("y") * F.ln(p) - (1 - F.col("y")) * F.ln(1 - p))).first()[0]
    assert logloss == pytest.approx(min(losses))
    whole = fit_boosted(df, ["y"], Loss("logistic"), Growth(rounds=2, depth=2, patience=1))
    assert whole.best_rounds == [2] and whole.curve == []


def test_draws_are_repeatable_and_reload_scores_alike(spark, tmp_path):
    df, _ = table(spark, targets=2)
    growth = Growth(rounds=3, depth=3, row_share=0.6, feature_share=0.7, min_rows=2, max_step=0.5, l1=0.2)
    first, second = (fit_boosted(df, ["y0", "y1"], Loss("tweedie"), growth) for _ in range(2))
    assert all(np.allclose(a[-1], b[-1]) for s, t in zip(first.trees, second.trees) for u, v in zip(s, t) for a, b in zip(u, v))
    assert max(abs(n[0]) for tree in first.trees[0] for n in tree if len(n) == 1) <= 0.5 * growth.rate + 1e-12
    first.save(str(tmp_path / "m"))
    again = load_boosted(spark, str(tmp_path / "m"))
    assert isinstance(again, BoostedTrees) and again == first
    scored = [m.transform(df, ["a", "b"]).select("a", "b").collect() for m in (first, again)]
    assert scored[0] == scored[1] and sum(first.importance()) == pytest.approx(1.0)


def test_odd_inputs(spark):
    """Empty tables, one value only, NaN values, null truths and no features give a constant or an own branch."""
    schema = "features_x array<double>, y double"
    made = lambda rows: spark.createDataFrame(rows, schema).select(array_to_vector("features_x").alias("features"), "y")
    one = fit_boosted(made([([1.0], 2.0)] * 30), ["y"], Loss("huber"), PLAIN)
    assert {r.p for r in one.transform(made([([5.0], None)]), ["p"]).collect()} == {2.0}
    none = fit_boosted(made([]), ["y"], Loss("tweedie"), PLAIN)
    assert none.trees[0][0] == [[0.0]] and none.n_features == 0
    nulls = fit_boosted(made([([1.0], None)] * 5), ["y"], Loss("squared"), PLAIN)
    assert nulls.starts == [0.0]
    nan = float("nan")
    gappy = made([([nan], 10.0)] * 20 + [([1.0], 0.0)] * 20 + [([2.0], 0.0)] * 20)
    model = fit_boosted(gappy, ["y"], Loss("squared"), Growth(rounds=30, depth=2, rate=0.5, min_rows=2))
    by = {str(r.features[0]): r.p for r in model.transform(gappy, ["p"]).distinct().collect()}
    assert by["1.0"] < 4 and set(by) == {"nan", "1.0", "2.0"}
    with pytest.raises(ValueError):
        fit_boosted(gappy, ["y"], Loss("other"))


def test_level_is_one_aggregation(spark):
    """All targets, nodes and features of a level come from one map-side combined shuffle of the sums."""
    df, _ = table(spark, targets=3)
    rows = boosting.with_bins(df.select("x", F.array("y0", "y1", "y2").alias("y"), F.lit(1.0).alias("w")), [[1.0], [0.5], [3.0]])
    sums = boosting.level_sums(rows, Loss("tweedie"), [F.lit(0)] * 3, [F.lit(0.0)] * 3)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "Python" not in plan
    assert sums.count() == 3 * 6


def test_best_splits_prefers_the_first_of_equals():
    sums = np.zeros((2, 4, 3))
    sums[:, 0] = [-5, 5, 5]
    sums[:, 1] = [5, 5, 5]
    gain, f, b, left, right = best_splits(sums, Growth(min_rows=1), np.array([True, True]))
    assert (f, b) == (0, 0) and gain > 0 and left[2] == right[2] == 5
    assert best_splits(sums, Growth(min_rows=6), np.array([True, True]))[0] == -np.inf
    assert best_splits(sums, Growth(min_rows=1), np.array([False, True]))[1] == 1


def test_boosted_revenue_beats_the_linear_models(spark):
    """On rows whose revenue depends on steps of the features, both losses beat their linear stand-ins on held-out rows."""
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        a, b = rng.random() * 10, rng.randrange(6)
        y = math.exp((2.5 if 3 < a < 6 else 0.3) + (1.0 if b in (1, 4) else 0.0) + rng.gauss(0, 0.2))
        rows.append((i, a, float(b), y, y * 1.5))
    df = spark.createDataFrame(rows, "row_id long, a double, b double, iap_revenue_d7 double, iap_revenue_d14 double")
    train, val, test = (df.where(f"row_id % 5 {c}") for c in ("< 3", "= 3", "= 4"))
    error = {}
    for objective, params in (("tweedie", dict(rounds=15, depth=3, rate=0.4)), ("huber", dict(rounds=15, depth=3, rate=1.0)), ("tweedie_linear", {}), ("huber_linear", {})):
        model = train_revenue(train, val, ["a", "b"], (7, 14), objective, **params)
        out = model.score(test)
        error[objective] = [evaluate(out, f"iap_revenue_d{h}", f"pred_d{h}").first()["rmsle"] for h in (7, 14)]
    for k in range(2):
        assert error["tweedie"][k] < 0.7 * error["tweedie_linear"][k] and error["huber"][k] < 0.7 * error["huber_linear"][k]


@pytest.mark.parametrize("together", [1, 1 << 16])
def test_level_sums_multiply_no_row(spark, monkeypatch, capsys, together):
    """Sums equal those of every (row, target, feature), rows without truth or node apart, and no row is exploded."""
    monkeypatch.setattr(boosting, "_TOGETHER", together)
    rng = random.Random(5)
    # Late rows have higher bins than early ones, so the arrays of a task grow.
    data = [([rng.randrange(1 + k // 20), rng.randrange(3), 0], [float(k % 7), None if k % 5 == 0 else float(k % 3)], 1.0 + k % 2, k % 4) for k in range(300)]
    rows = spark.createDataFrame(data, "bins array<smallint>, y array<double>, w double, leaf int").repartition(3, "leaf")
    node = F.when(F.col("leaf") < 3, F.col("leaf"))
    sums = boosting.level_sums(rows, Loss("squared"), [node, F.lit(0)], [F.lit(0.5), F.lit(0.0)])
    want = {}
    for bins, y, w, leaf in data:
        for t, (own, s) in enumerate([(leaf if leaf < 3 else None, 0.5), (0, 0.0)]):
            if own is None or y[t] is None:
                continue
            for f, b in enumerate(bins):
                cell = want.setdefault((t, own, f, b), [0.0, 0.0, 0])
                for k, v in enumerate((w * (s - y[t]), w, 1)):
                    cell[k] += v
    got = {(r.target, r.node, r.feature, r.bin): [r.g, r.h, r.n] for r in sums.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    sums.explain()
    assert "Generate" not in capsys.readouterr().out
    assert boosting.level_sums(rows.limit(0), Loss("squared"), [F.lit(0)], [F.lit(0.0)]).count() == 0
