"""Fitted stages. Their results depend on the trainer, so these have no oracle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from cohortal.catalog.registry import query, r, rounded
from cohortal.catalog.views_sql import IMPRESSIONS, SCORED
from cohortal.core.settle import settle
from cohortal.functions.gates import expected_value
from cohortal.models import boosting
from cohortal.models.base import with_vector
from cohortal.models.boosting import fit_boosted
from cohortal.models.buyer import train_classifier
from cohortal.models.calibration import fit_calibrator
from cohortal.models.distill import student_report, train_student, train_teacher
from cohortal.models.isotonic import isotonic_steps
from cohortal.models.revenue import BOOSTED, train_revenue
from cohortal.models.stacking import train_stacking
from cohortal.operators import features, sampling, splits
from cohortal.operators.metrics import evaluate, horizon_report
from cohortal.plans.scoring import evaluate_holdout
from cohortal.plans.training import Settings, train_run
from cohortal.sources.views import impressions, scored, wide_impressions

COLUMNS = (
    "hour", "weekday", "value", "k", "avg_act_days", "weekend_ratio", "release_msrp", "wifi_ratio",
    "weeks_since_first_seen", "country_te", "category_te",
)
SIZE = dict(maxIter=10, maxDepth=4)


def encoded_split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows, the encodings fitted on the training rows only."""
    split = settle(splits.stratified_split(impressions(spark, sf_dir), 0.8, portable=True), "split")
    train, val = (split.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    for column, name in (("country", "country_te"), ("advertiser_category", "category_te")):
        table, overall = features.fit_target_encoding(train, column, "buyer_d7")
        named = table.withColumnRenamed(f"{column}_te", name)
        train, val = (features.map_stats(d, named, column, overall) for d in (train, val))
    return settle(train, "train"), settle(val, "val")


@query("gbt_buyer")
def gbt_buyer(spark, sf_dir):
    train, val = encoded_split(spark, sf_dir)
    model = train_classifier(train, val, COLUMNS, "buyer_d7", **SIZE)
    return rounded(model.metrics(val, "buyer_d7"), 4)


@query("best_round_buyer", "SELECT * FROM (VALUES ('patience_kept', true), ('rounds_are_the_minimum', true), ('scores_in_range', true)) AS v(check_name, holds)")
def best_round_buyer(spark, sf_dir):
    """What the early stop of the buyer model promises, checked on its own curve and scores."""
    train, val = encoded_split(spark, sf_dir)
    model = train_classifier(train, val, COLUMNS, "buyer_d7", patience=3, rounds=12, depth=4, rate=0.4)
    curve = [losses[0] for losses in model.model.curve]
    best = curve.index(min(curve)) + 1
    outside = model.score(val).where("NOT coalesce(buyer_proba BETWEEN 0 AND 1, false)").count()
    rows = [
        ("rounds_are_the_minimum", model.model.best_rounds == [best]),
        ("patience_kept", len(curve) == min(12, best + 3)),
        ("scores_in_range", outside == 0),
    ]
    return spark.createDataFrame(rows, "check_name string, holds boolean")


@query("gbt_high_value")
def gbt_high_value(spark, sf_dir):
    train, val = encoded_split(spark, sf_dir)
    cut = sampling.high_value_threshold(train, min_revenue=75.0)
    train, val = (sampling.add_high_value_label(d, cut) for d in (train, val))
    model = train_classifier(train, val, COLUMNS, "high_value", min_weight=1.0, **SIZE)
    return rounded(model.metrics(val, "high_value"), 4)


def _calibrated(method: str):
    """Mean and Brier score of the calibrated stand-in probability, and its range."""

    def run(spark, sf_dir):
        df = scored(spark, sf_dir).select("buyer_d7", "buyer_proba")
        fitted = fit_calibrator(df, "buyer_proba", "buyer_d7", method, regularization=0.05, epsilon=1e-4)
        p, y = F.col("buyer_proba"), F.col("buyer_d7")
        return rounded(
            fitted.apply(df, "buyer_proba").agg(
                F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean"),
                F.avg(F.pow(p - y, F.lit(2.0))).alias("brier"),
            ),
            4,
        )

    return run


query("platt")(_calibrated("platt"))
query("isotonic")(_calibrated("isotonic"))

# Steps are the slopes of the greatest convex minorant of the running sums: from each corner the next one
# is where the line is flattest, the farthest of equals.
ISOTONIC = f"""WITH RECURSIVE {SCORED},
points AS MATERIALIZED (SELECT value / 250.0 AS x, count(*) AS w, sum(buyer_d7) AS t FROM scored GROUP BY value),
sums AS MATERIALIZED (SELECT x, lead(x) OVER up AS following, row_number() OVER up AS i, CAST(sum(w) OVER up AS DOUBLE) AS w, CAST(sum(t) OVER up AS DOUBLE) AS t
  FROM points WINDOW up AS (ORDER BY x)),
corners AS (
  SELECT CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS t
  UNION ALL
  SELECT n.i, n.w, n.t FROM corners c, LATERAL (
    SELECT s.i, s.w, s.t FROM sums s WHERE s.i > c.i ORDER BY round((s.t - c.t) / (s.w - c.w), 12), s.i DESC LIMIT 1) n),
steps AS (SELECT i, lag(i) OVER (ORDER BY i) AS before, w - lag(w) OVER (ORDER BY i) AS weight, t - lag(t) OVER (ORDER BY i) AS total FROM corners)
SELECT {r('a.x', 'low', 9)}, {r('b.x', 'high', 9)}, {r('total / weight', 'value', 9)}, weight
FROM steps JOIN sums a ON a.i = before + 1 JOIN sums b ON b.i = steps.i"""


@query("isotonic_steps", ISOTONIC)
def isotonic_exact(spark, sf_dir):
    """Exact steps of the buying rate over unrounded scores."""
    df = scored(spark, sf_dir).select((F.col("value") / 250.0).alias("p"), "buyer_d7")
    return rounded(isotonic_steps(df, "p", "buyer_d7"), 9)


query("beta_cal")(_calibrated("beta"))
query(
    "no_calibration",
    f"""WITH {SCORED} SELECT {r('min(buyer_proba)', 'low', 4)}, {r('max(buyer_proba)', 'high', 4)},
    {r('avg(buyer_proba)', 'mean', 4)}, {r('avg(power(buyer_proba - buyer_d7, 2))', 'brier', 4)} FROM scored""",
)(_calibrated("none"))


def _revenue(spark, sf_dir, objective, **params):
    train, val = encoded_split(spark, sf_dir)
    payers, _ = splits.paying_buyers(train)
    check, _ = splits.paying_buyers(val)
    model = train_revenue(payers, check, COLUMNS, objective=objective, **params)
    out = settle(model.score(check), "revenue")
    pairs = {f"d{h}": (f"iap_revenue_d{h}", f"pred_d{h}") for h in (1, 7, 14)}
    return rounded(horizon_report(out, pairs), 4)


@query("multi_horizon_trees")
def multi_horizon_trees(spark, sf_dir):
    return _revenue(spark, sf_dir, "log_trees", **SIZE)


@query("multi_horizon_tweedie")
def multi_horizon_tweedie(spark, sf_dir):
    return _revenue(spark, sf_dir, "tweedie", rounds=30, depth=4, rate=0.15)


@query("multi_horizon_huber")
def multi_horizon_huber(spark, sf_dir):
    return _revenue(spark, sf_dir, "huber", rounds=30, depth=4, rate=1.0)


SPLIT_COLUMNS = ("hour", "weekday", "k")
SPLIT_EDGES = {"hour": list(range(1, 24)), "weekday": list(range(1, 7)), "k": list(range(5, 100, 5))}


def _first_split_sql() -> str:
    """Root sums of the Tweedie loss per bin, and the gain of every split, written out from the definitions."""
    bins = " UNION ALL ".join(
        f"SELECT {f} AS feature, (SELECT count(*) FROM unnest({SPLIT_EDGES[c]}) AS e(v) WHERE v <= {c}) AS bin, y, s FROM p, start"
        for f, c in enumerate(SPLIT_COLUMNS)
    )
    return f"""WITH {IMPRESSIONS},
    p AS (SELECT hour, weekday, k, iap_revenue_d7 AS y FROM imp WHERE buyer_d7 = 1 AND iap_revenue_d7 > 0),
    start AS (SELECT ln(greatest(avg(y), 1e-6)) AS s FROM p),
    b AS ({bins}),
    cells AS (SELECT feature, bin, sum(exp(0.9 * s) - y * exp(-0.1 * s)) AS g, sum(0.9 * exp(0.9 * s) + 0.1 * y * exp(-0.1 * s)) AS h, count(*) AS n
      FROM b GROUP BY feature, bin),
    sides AS (SELECT feature, bin, g, h, n, sum(g) OVER up AS gl, sum(h) OVER up AS hl, sum(n) OVER up AS nl,
        sum(g) OVER f AS gt, sum(h) OVER f AS ht, sum(n) OVER f AS nt
      FROM cells WINDOW up AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature)),
    gains AS (SELECT *, CASE WHEN nl >= 20 AND nt - nl >= 20 THEN
        power(greatest(abs(gl) - 0.5, 0), 2) / (hl + 0.5) + power(greatest(abs(gt - gl) - 0.5, 0), 2) / (ht - hl + 0.5)
        - power(greatest(abs(gt) - 0.5, 0), 2) / (ht + 0.5) END AS gain FROM sides)
    SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, {r('g', 'g', 4)}, {r('h', 'h', 4)}, CAST(n AS BIGINT) AS n, {r('gain', 'gain', 3)},
      coalesce(gain = max(gain) OVER (), false) AS chosen FROM gains"""


@query("boosting_first_split", _first_split_sql())
def boosting_first_split(spark, sf_dir):
    """Gradient and hessian sums of the first Tweedie split per feature and bin, its gains, and the split that boosting takes."""
    payers, _ = splits.paying_buyers(impressions(spark, sf_dir))
    loss, growth = BOOSTED["tweedie"]
    start = loss.start(payers.agg(F.avg("iap_revenue_d7")).first()[0], None)
    edges = [[float(e) for e in SPLIT_EDGES[c]] for c in SPLIT_COLUMNS]
    x, y = F.array(*[F.col(c).cast("double") for c in SPLIT_COLUMNS]), F.array(F.col("iap_revenue_d7"))
    rows = boosting.with_bins(payers.select(x.alias("x"), y.alias("y"), F.lit(1.0).alias("w")), edges)
    cells = settle(boosting.level_sums(rows, loss, [F.lit(0)], [F.lit(start)]), "cells").drop("target", "node")
    gains = boosting.split_gains(cells, growth)
    one = fit_boosted(
        with_vector(payers, SPLIT_COLUMNS), ["iap_revenue_d7"], loss, replace(growth, rounds=1, depth=1, row_share=1.0, feature_share=1.0), edges=edges
    )
    feature, bin_ = one.trees[0][0][0][:2]
    chosen = (F.col("feature") == int(feature)) & (F.col("bin") == int(bin_))
    return gains.select("feature", F.col("bin").cast("int").alias("bin"), *[(F.round(c, d) + 0.0).alias(c) for c, d in (("g", 4), ("h", 4))], "n", (F.round("gain", 3) + 0.0).alias("gain"), chosen.alias("chosen"))


@query("stacking")
def stacking(spark, sf_dir):
    df = scored(spark, sf_dir)
    model = train_stacking(df, ["buyer_proba", "whale_proba", "pred_d1", "pred_d7", "pred_d14"], folds=5, rounds=5, depth=3)
    out = model.score(df, "stacked").select("iap_revenue_d7", "stacked")
    return rounded(evaluate(out, "iap_revenue_d7", "stacked"), 4)


@query("distillation")
def distillation(spark, sf_dir):
    train, val = encoded_split(spark, sf_dir)
    train, val = (d.fillna(0.0, ["wifi_ratio", "weeks_since_first_seen"]) for d in (train, val))
    train, val = (features.add_hour_groups(d) for d in (train, val))
    numeric = ["hour", "hour_sin", "hour_cos", "weekday", "avg_act_days", "weekend_ratio", "wifi_ratio", "weeks_since_first_seen"]
    categories = ["advertiser_category", "country", "dev_os"]
    payers = splits.buyers(train, revenue="iap_revenue_d7")
    cut = features.whale_threshold(payers, "iap_revenue_d7")
    rich = settle(sampling.oversample_whales(payers, cut), "rich")
    upper = rich.agg(F.max("iap_revenue_d7")).first()[0]
    teacher = train_teacher(
        train, sampling.log_target(rich, upper), [*numeric, "country_te", "category_te"], categories, rounds=8, depth=4
    )
    taught = settle(teacher.score(train), "taught")
    student = train_student(taught, numeric, categories, rounds=8, depth=3)
    return rounded(student_report(settle(student.score(teacher.score(val)), "student")), 4)


@query("teacher_expected_value")
def teacher_expected_value(spark, sf_dir):
    train, val = encoded_split(spark, sf_dir)
    buyer = train_classifier(train, None, COLUMNS, "buyer_d7", maxIter=5, maxDepth=3)
    revenue = train_revenue(splits.paying_buyers(train)[0], None, COLUMNS, [7], "log_trees", maxIter=5, maxDepth=3)
    out = revenue.score(buyer.score(val))
    value = expected_value(F.col("buyer_proba"), F.log1p("pred_d7"))
    return rounded(evaluate(out.withColumn("p", value), "iap_revenue_d7", "p"), 4)


@query("end_to_end")
def end_to_end(spark, sf_dir):
    """Every stage on the raw nested rows, trained on the first days and scored on the last."""
    raw = wide_impressions(spark, sf_dir)
    early = settle(raw.where("datetime < '2024-01-20-00-00'"), "early")
    late = raw.where("datetime >= '2024-01-20-00-00'")
    run = train_run(early, Settings(reference="2024-01-31", rounds=5, depth=3, folds=3, oof_folds=2))
    metrics, diagnostics = evaluate_holdout(run, late)
    long = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "measure", "result"
    )
    return rounded(long(metrics).unionByName(long(diagnostics)), 4)
