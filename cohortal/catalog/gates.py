"""Prediction post-processing and gate searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortal.catalog.registry import query, r, rounded, rs
from cohortal.catalog.views_sql import SCORED
from cohortal.functions import gates
from cohortal.operators import search
from cohortal.sources.views import scored

PREDS = ["pred_d1", "pred_d7", "pred_d14"]
GATE = dict(power=1.25, cap=0.8, cutoff=0.01)
WHALE = dict(power=0.8, cap=0.95, cutoff=0.35)
GATE_SQL = "CASE WHEN least(buyer_proba, 0.8) <= 0.01 THEN 0 ELSE power(least(buyer_proba, 0.8)::DOUBLE, 1.25::DOUBLE) END"
WHALE_GATE_SQL = "CASE WHEN least(whale_proba, 0.95) <= 0.35 THEN 0 ELSE power(least(whale_proba, 0.95)::DOUBLE, 0.8::DOUBLE) END"


@query(
    "order_enforce",
    f"""WITH {SCORED} SELECT row_id, {r('pred_d1')}, {r('greatest(pred_d1, pred_d7)', 'pred_d7')},
      {r('greatest(pred_d1, pred_d7, pred_d14)', 'pred_d14')} FROM scored""",
)
def order_enforce(spark, sf_dir):
    return rounded(gates.enforce_order(scored(spark, sf_dir), PREDS).select("row_id", *PREDS))


@query(
    "horizon_clip",
    f"""WITH {SCORED}, m AS (SELECT *, least(greatest(pred_d7, pred_d1), pred_d14) AS mid FROM scored)
    SELECT row_id, {r('least(pred_d1, mid)', 'pred_d1')}, {r('mid', 'pred_d7')}, {r('greatest(pred_d14, mid)', 'pred_d14')} FROM m""",
)
def horizon_clip(spark, sf_dir):
    return rounded(gates.clip_between_horizons(scored(spark, sf_dir), *PREDS).select("row_id", *PREDS))


@query(
    "gate",
    f"WITH {SCORED} SELECT row_id, " + ", ".join(r(f"greatest(0.05, {c} * {GATE_SQL})", c) for c in PREDS) + " FROM scored",
)
def gate(spark, sf_dir):
    p = F.col("buyer_proba")
    made = [gates.gate_revenue(F.col(c), p, floor=0.05, **GATE).alias(c) for c in PREDS]
    return rounded(scored(spark, sf_dir).select("row_id", *made))


@query(
    "whale_multiplier",
    f"""WITH {SCORED}, m AS (SELECT *, least(greatest(1 + 2 * {WHALE_GATE_SQL}, 1), 2.5) AS m FROM scored)
    SELECT row_id, {r('m', 'multiplier')}, {r('pred_d7 * m', 'boosted_d7')} FROM m""",
)
def whale_multiplier(spark, sf_dir):
    m = gates.whale_multiplier(F.col("whale_proba"), boost=2.0, low=1.0, high=2.5, **WHALE)
    return rounded(
        scored(spark, sf_dir).select("row_id", m.alias("multiplier"), (F.col("pred_d7") * m).alias("boosted_d7"))
    )


@query(
    "scale_probability",
    f"""WITH {SCORED} SELECT row_id, {r('power(buyer_proba, 1.7::DOUBLE)', 'scaled')}, {r('buyer_proba', 'unchanged')},
      {r('buyer_proba', 'not_positive')} FROM scored""",
)
def scale_probability(spark, sf_dir):
    p = F.col("buyer_proba")
    return rounded(
        scored(spark, sf_dir).select(
            "row_id",
            gates.scale_probability(p, 1.7).alias("scaled"),
            gates.scale_probability(p, 1.0).alias("unchanged"),
            gates.scale_probability(p, -1.0).alias("not_positive"),
        )
    )


@query(
    "final_gate",
    f"WITH {SCORED} SELECT row_id, {r('CASE WHEN buyer_proba <= 0.12 THEN 0 ELSE pred_d7 END', 'iap_revenue_d7')} FROM scored",
)
def final_gate(spark, sf_dir):
    value = gates.final_gate(F.col("pred_d7"), F.col("buyer_proba"), 0.12)
    return rounded(scored(spark, sf_dir).select("row_id", value.alias("iap_revenue_d7")))


@query(
    "expected_value",
    f"""WITH {SCORED}, l AS (SELECT row_id, buyer_proba, hour,
      CASE WHEN hour = 0 THEN NULL WHEN hour = 1 THEN NULL ELSE ln(1 + pred_d7) - 0.5::DOUBLE END AS g FROM scored)
    SELECT row_id, round(CASE WHEN hour = 0 THEN 0 WHEN hour = 1 THEN buyer_proba * 2000
      ELSE greatest(0, buyer_proba * (exp(g) - 1)) END, 6) + 0 AS expected FROM l""",
)
def expected_value(spark, sf_dir):
    log_pred = (
        F.when(F.col("hour") == 0, F.lit(float("nan")))
        .when(F.col("hour") == 1, F.lit(float("inf")))
        .otherwise(F.log1p("pred_d7") - 0.5)
    )
    value = gates.expected_value(F.col("buyer_proba"), log_pred)
    return rounded(scored(spark, sf_dir).select("row_id", value.alias("expected")))


META = {
    "buyer_proba": "buyer_proba", "buyer_proba_clipped": "least(buyer_proba, 0.8)",
    "buyer_gate_mask": "CAST(least(buyer_proba, 0.8) > 0.01 AS INTEGER)", "buyer_gate_powered": GATE_SQL,
    "whale_proba": "whale_proba", "whale_gate_mask": "CAST(least(whale_proba, 0.95) > 0.35 AS INTEGER)",
    "whale_gate_powered": WHALE_GATE_SQL, "buyer_whale_product": "buyer_proba * whale_proba",
    "joint_gate_powered": f"({GATE_SQL}) * ({WHALE_GATE_SQL})",
    "revenue_d1": "least(pred_d1, 15)", "revenue_d7": "least(pred_d7, 15)", "revenue_d14": "least(pred_d14, 15)",
    "weighted_revenue": "least(0.3 * pred_d1 + 0.5 * pred_d7 + 0.2 * pred_d14, 15)",
    "buyer_x_revenue": "least(buyer_proba * pred_d7, 15)", "gated_revenue": f"least(({GATE_SQL}) * pred_d7, 15)",
}


@query("meta_features", f"WITH {SCORED} SELECT row_id, " + ", ".join(r(e, n, 9) for n, e in META.items()) + " FROM scored")
def meta_features(spark, sf_dir):
    df = scored(spark, sf_dir)
    made = gates.meta_features(
        df, {"d1": "pred_d1", "d7": "pred_d7", "d14": "pred_d14"}, {"d1": 0.3, "d7": 0.5, "d14": 0.2},
        GATE, WHALE, feature_cap=15.0,
    )
    return rounded(df.select("row_id", *made), 9)


ALPHAS = ", ".join(f"({float(a)!r})" for a in np.linspace(0.1, 3.0, 100))
THRESHOLDS = ", ".join(f"({float(t)!r})" for t in np.linspace(0.01, 0.99, 100))
LOSS = "power(ln(1 + iap_revenue_d7) - ln(1 + {p}), 2)"


@query(
    "alpha_search",
    f"""WITH {SCORED}, g AS (SELECT a::DOUBLE AS alpha FROM (VALUES {ALPHAS}) t(a))
    SELECT {r('alpha', 'alpha', 9)}, {r(f"sqrt(avg({LOSS.format(p='power(buyer_proba, alpha) * pred_d7')}))", 'metric')}
    FROM scored, g GROUP BY g.alpha""",
)
def alpha_search(spark, sf_dir):
    curve = search.alpha_curve(scored(spark, sf_dir), "buyer_proba", "pred_d7", "iap_revenue_d7")
    return rounded(curve.withColumn("metric", F.round("metric", 6)), 9)


@query(
    "threshold_search",
    f"""WITH {SCORED}, g AS (SELECT t::DOUBLE AS threshold FROM (VALUES {THRESHOLDS}) x(t))
    SELECT {r('threshold', 'threshold', 9)},
      {r(f"sqrt(avg({LOSS.format(p='CASE WHEN buyer_proba >= threshold THEN pred_d7 ELSE 0 END')}))", 'metric')}
    FROM scored, g GROUP BY g.threshold""",
)
def threshold_search(spark, sf_dir):
    curve = search.threshold_curve(scored(spark, sf_dir), "buyer_proba", "pred_d7", "iap_revenue_d7")
    return rounded(curve.withColumn("metric", F.round("metric", 6)), 9)


@query(
    "search_best",
    f"""WITH {SCORED}, ga AS (SELECT a::DOUBLE AS s FROM (VALUES {ALPHAS}) t(a)),
    gt AS (SELECT t::DOUBLE AS s FROM (VALUES {THRESHOLDS}) x(t)),
    ca AS (SELECT s, avg(abs(iap_revenue_d7 - power(buyer_proba, s) * pred_d7)) AS m FROM scored, ga GROUP BY s),
    ct AS (SELECT s, sqrt(avg(power(iap_revenue_d7 - CASE WHEN buyer_proba >= s THEN pred_d7 ELSE 0 END, 2))) AS m
           FROM scored, gt GROUP BY s),
    b AS (SELECT 'alpha_mae' AS search, arg_min(s, m) AS setting, min(m) AS metric, arg_min(m, abs(s - 1)) AS baseline_metric FROM ca
      UNION ALL SELECT 'threshold_rmse', (SELECT s FROM ct ORDER BY m, s LIMIT 1), min(m), (SELECT m FROM ct ORDER BY abs(s - 0.5), s LIMIT 1) FROM ct)
    SELECT search, {rs(['setting', 'metric', 'baseline_metric'])},
      {r('(baseline_metric - metric) / baseline_metric * 100', 'improvement_pct')} FROM b""",
)
def search_best(spark, sf_dir):
    df = scored(spark, sf_dir)
    args = ("buyer_proba", "pred_d7", "iap_revenue_d7")
    alpha = search.best_of(search.alpha_curve(df, *args, metric="mae"), "alpha", 1.0)
    cut = search.best_of(search.threshold_curve(df, *args, metric="rmse"), "threshold", 0.5)
    named = lambda d, name, c: d.select(
        F.lit(name).alias("search"), F.col(c).alias("setting"), "metric", "baseline_metric", "improvement_pct"
    )
    return rounded(named(alpha, "alpha_mae", "alpha").unionByName(named(cut, "threshold_rmse", "threshold")))


@query(
    "zero_rate",
    f"""WITH {SCORED}, o AS (SELECT avg(CAST(iap_revenue_d7 = 0 AS INTEGER)) AS o,
      least(greatest(quantile_cont(buyer_proba, 0.9), 0.005), 0.45) AS cut FROM scored),
    p AS (SELECT avg(CAST(buyer_proba <= cut AS INTEGER)) AS p FROM scored, o)
    SELECT {r('cut', 'probability_cutoff')}, 0.9::DOUBLE AS target_zero_rate, {r('o', 'observed_zero_rate')},
      {r('p', 'predicted_zero_rate')}, abs(p - 0.9) <= 0.002 AS within_tolerance FROM o, p""",
)
def zero_rate(spark, sf_dir):
    found = search.fit_zero_rate(
        scored(spark, sf_dir), "buyer_proba", "iap_revenue_d7", target=0.9, low=0.005, high=0.45, tolerance=0.002
    )
    return rounded(spark.createDataFrame(
        [tuple(found.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in found.items())
    ))
