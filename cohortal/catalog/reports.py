"""Metrics, diagnostics and distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import query, r, rounded, rs
from cohortal.catalog.views_sql import IMPRESSIONS, SCORED
from cohortal.operators import metrics, profiling
from cohortal.plans.scoring import submission_stats, validate_submission
from cohortal.sources.views import impressions, scored, table

NAMES = ("msle", "rmsle", "rmse", "mae", "mape", "r2")


def metrics_sql(y: str, p: str) -> str:
    msle = f"avg(power(ln(1 + {y}) - ln(1 + greatest({p}, 0)), 2))"
    return ", ".join(
        (
            r(msle, "msle"), r(f"sqrt({msle})", "rmsle"), r(f"sqrt(avg(power({y} - {p}, 2)))", "rmse"),
            r(f"avg(abs({y} - {p}))", "mae"),
            r(f"coalesce(avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END) * 100, 0)", "mape"),
            r(f"coalesce(1 - sum(power({y} - {p}, 2)) / nullif(var_pop({y}) * count({y}), 0), 0)", "r2"),
        )
    )


@query("metrics_all", f"WITH {SCORED} SELECT {metrics_sql('iap_revenue_d7', 'pred_d7')} FROM scored")
def metrics_all(spark, sf_dir):
    return rounded(metrics.evaluate(scored(spark, sf_dir), "iap_revenue_d7", "pred_d7"))


@query(
    "metrics_by_category",
    f"WITH {SCORED} SELECT advertiser_category, {metrics_sql('iap_revenue_d7', 'pred_d7')} FROM scored GROUP BY advertiser_category",
)
def metrics_by_category(spark, sf_dir):
    return rounded(metrics.evaluate(scored(spark, sf_dir), "iap_revenue_d7", "pred_d7", by=["advertiser_category"]))


@query(
    "metrics_lineitem",
    f"SELECT l_returnflag, {metrics_sql('l_extendedprice', '(l_quantity * 1500)')} FROM lineitem GROUP BY l_returnflag",
)
def metrics_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    return rounded(metrics.evaluate(df, "l_extendedprice", "guess", by=["l_returnflag"]))


@query("zero_baseline", f"WITH {SCORED} SELECT {metrics_sql('iap_revenue_d7', '0')} FROM scored")
def zero_baseline(spark, sf_dir):
    return rounded(metrics.zero_baseline(scored(spark, sf_dir), "iap_revenue_d7"))


AUC_SQL = """SELECT round((sum(CASE WHEN {y} = 1 THEN rk END) - p * (p + 1) / 2) / (p * n), 6) + 0 AS roc_auc FROM (
  SELECT *, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2 AS rk,
    count(*) FILTER (WHERE {y} = 1) OVER () AS p, count(*) FILTER (WHERE {y} = 0) OVER () AS n FROM {t}) GROUP BY p, n"""
AP_SQL = """SELECT round(sum(pos / p * cum_pos / cum_n), 6) + 0 AS average_precision FROM (
  SELECT pos, sum(pos) OVER () AS p, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(n) OVER (ORDER BY s DESC) AS cum_n
  FROM (SELECT {s} AS s, count(*) FILTER (WHERE {y} = 1) AS pos, count(*) AS n FROM {t} GROUP BY 1))"""


@query("roc_auc", f"WITH {SCORED} " + AUC_SQL.format(y="buyer_d7", s="buyer_proba", t="scored"))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), "buyer_d7", "buyer_proba"))


@query("avg_precision", f"WITH {SCORED} " + AP_SQL.format(y="buyer_d7", s="buyer_proba", t="scored"))
def avg_precision(spark, sf_dir):
    return rounded(metrics.average_precision(scored(spark, sf_dir), "buyer_d7", "buyer_proba"))


QUALITY = "q AS (SELECT l.quality, d.n_chars % 97 AS score FROM labels l JOIN documents d USING (doc_id))"


@query("roc_auc_labels", f"WITH {QUALITY} " + AUC_SQL.format(y="quality", s="score", t="q"))
def roc_auc_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score"))
    return rounded(metrics.roc_auc(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "score"))


def huber_sql(t: str, p: str) -> str:
    return f"avg(CASE WHEN abs({t} - {p}) <= 1 THEN 0.5 * power({t} - {p}, 2) ELSE abs({t} - {p}) - 0.5 END)"


HUBER = " + ".join(f"{w}::DOUBLE * {huber_sql(f'iap_revenue_d{h}', f'pred_d{h}')}" for h, w in ((1, 0.3), (7, 0.5), (14, 0.2)))
PENALTY = "avg(power(greatest(pred_d1 - pred_d7, 0), 2) + power(greatest(pred_d7 - pred_d14, 0), 2))"


@query(
    "op_huber_metric",
    f"""WITH {SCORED} SELECT {r(HUBER, 'huber_total', 4)}, {r(PENALTY, 'order_penalty', 4)},
    {r(f'({HUBER}) + 0.1::DOUBLE * {PENALTY}', 'loss', 4)} FROM scored""",
)
def op_huber_metric(spark, sf_dir):
    horizons = (1, 7, 14)
    return rounded(
        metrics.order_huber_loss(
            scored(spark, sf_dir), [f"iap_revenue_d{h}" for h in horizons], [f"pred_d{h}" for h in horizons]
        ),
        4,
    )


@query(
    "pred_diagnostics",
    f"""WITH {SCORED} SELECT count(pred_d7) AS rows, {r('avg(pred_d7)', 'mean')}, {r('stddev_pop(pred_d7)', 'std')},
      {r('min(pred_d7)', 'min')}, {r('max(pred_d7)', 'max')}, count(*) FILTER (WHERE pred_d7 = 0) AS zeros,
      {r('100.0 * count(*) FILTER (WHERE pred_d7 = 0) / count(*)', 'zeros_pct')},
      count(DISTINCT round(buyer_proba, 2)) AS unique_rounded, {r('quantile_cont(pred_d7, 0.5)', 'median')} FROM scored""",
)
def pred_diagnostics(spark, sf_dir):
    df = scored(spark, sf_dir)
    found = metrics.prediction_diagnostics(df, "pred_d7").drop("unique_rounded")
    unique = metrics.prediction_diagnostics(df, "buyer_proba").first()["unique_rounded"]
    return rounded(found.withColumn("unique_rounded", F.lit(unique).cast("bigint")))


@query(
    "horizon_stats",
    f"WITH {SCORED} "
    + " UNION ALL ".join(
        f"""SELECT 'd{h}' AS horizon, {r(f'avg(iap_revenue_d{h})', 'mean_actual', 8)}, {r(f'avg(pred_d{h})', 'mean_predicted', 8)},
        {r(f'sqrt(avg(power(ln(1 + iap_revenue_d{h}) - ln(1 + pred_d{h}), 2)))', 'rmsle', 8)},
        {r(f'sqrt(avg(power(iap_revenue_d{h} - pred_d{h}, 2)))', 'rmse', 8)}, {r(f'avg(abs(iap_revenue_d{h} - pred_d{h}))', 'mae', 8)},
        {r(f'quantile_cont(iap_revenue_d{h}, 0.5)', 'median_actual', 8)}, {r(f'quantile_cont(pred_d{h}, 0.5)', 'median_predicted', 8)}
        FROM scored"""
        for h in (1, 7, 14)
    ),
)
def horizon_stats(spark, sf_dir):
    pairs = {f"d{h}": (f"iap_revenue_d{h}", f"pred_d{h}") for h in (1, 7, 14)}
    return rounded(metrics.horizon_report(scored(spark, sf_dir), pairs), 8)


SUB_SQL = """count(*) AS rows, {mean}, {med}, {std}, {zero}""".format(
    mean=r("avg(p)", "mean"), med=r("quantile_cont(p, 0.5)", "median"), std=r("stddev_samp(p)", "std"),
    zero=r("100.0 * count(*) FILTER (WHERE p = 0) / count(*)", "zeros_pct"),
)


@query(
    "submission_check",
    f"""WITH {SCORED}, s AS (SELECT row_id, pred_d7 AS p FROM scored WHERE row_id % 7 <> 0)
    SELECT 'exact' AS kind, {SUB_SQL} FROM s UNION ALL
    SELECT 'aligned', {SUB_SQL} FROM (SELECT s.p FROM scored LEFT JOIN s USING (row_id) WHERE scored.row_id % 2 = 0)""",
)
def submission_check(spark, sf_dir):
    made = scored(spark, sf_dir).select("row_id", F.col("pred_d7").alias("iap_revenue_d7"))
    some = made.where("row_id % 7 <> 0")
    exact = validate_submission(some, some.select("row_id", F.lit(0.0).alias("iap_revenue_d7")))
    sample = made.where("row_id % 2 = 0").withColumn("iap_revenue_d7", F.lit(0.0))
    aligned = validate_submission(some, sample, align=True)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "*")
    return rounded(named(exact, "exact").unionByName(named(aligned, "aligned")))


@query(
    "label_profile",
    f"""WITH {IMPRESSIONS} SELECT count(*) AS rows, sum(buyer_d7)::BIGINT AS buyers, {r('avg(buyer_d7) * 100', 'buyer_rate_pct')},
      {r('avg(iap_revenue_d7)', 'mean_revenue')}, {r('avg(iap_revenue_d7) FILTER (WHERE buyer_d7 = 1)', 'mean_buyer_revenue')},
      max(iap_revenue_d7) AS max_revenue, {r('quantile_cont(iap_revenue_d7, 0.5)', 'median_revenue')},
      {r('quantile_cont(iap_revenue_d7, 0.5) FILTER (WHERE buyer_d7 = 1)', 'median_buyer_revenue')} FROM imp""",
)
def label_profile(spark, sf_dir):
    return rounded(profiling.label_profile(impressions(spark, sf_dir)))


def hist_sql(x: str, source: str, bins: int) -> str:
    return f"""lim AS (SELECT min({x}) AS lo, (max({x}) - min({x})) / {bins} AS w FROM {source}),
    b AS (SELECT CAST(least(greatest(floor(({x} - lo) / w), 0), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM {source}, lim GROUP BY 1)
    SELECT i AS bin, {r('lo + i * w', 'low')}, {r('lo + (i + 1) * w', 'high')}, coalesce(n, 0) AS n
    FROM range({bins}) r(i) CROSS JOIN lim LEFT JOIN b ON b.bin = i"""


@query("rev_hist", f"WITH {IMPRESSIONS}, {hist_sql('iap_revenue_d7', 'imp', 100)}")
def rev_hist(spark, sf_dir):
    return rounded(profiling.histogram(impressions(spark, sf_dir), "iap_revenue_d7", 100))


@query("log_price_hist", f"WITH {hist_sql('ln(1 + o_totalprice)', 'orders', 80)}")
def log_price_hist(spark, sf_dir):
    return rounded(profiling.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 80, log=True))


BOX = """SELECT {g}, count(*) AS n, {q1}, {q2}, {q3} FROM {t} GROUP BY {g}"""


def box_sql(g: str, x: str, t: str) -> str:
    return BOX.format(
        g=g, t=t, q1=r(f"quantile_cont(ln(1 + {x}), 0.25)", "q1"), q2=r(f"quantile_cont(ln(1 + {x}), 0.5)", "median"),
        q3=r(f"quantile_cont(ln(1 + {x}), 0.75)", "q3"),
    )


@query("box_summary", f"WITH {IMPRESSIONS} {box_sql('buyer_d7', 'iap_revenue_d14', 'imp')}")
def box_summary(spark, sf_dir):
    return rounded(profiling.box_summary(impressions(spark, sf_dir), "buyer_d7", "iap_revenue_d14"))


@query("box_summary_orders", box_sql("o_orderpriority", "o_totalprice", "orders"))
def box_summary_orders(spark, sf_dir):
    return rounded(profiling.box_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "topk_semi",
    f"""WITH {IMPRESSIONS}, top AS (SELECT country FROM imp WHERE country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country LIMIT 10)
    SELECT country, count(*) AS n, {r('avg(ln(1 + iap_revenue_d7))', 'mean_log_revenue')} FROM imp
    WHERE country IN (SELECT country FROM top) GROUP BY country""",
)
def topk_semi(spark, sf_dir):
    kept = profiling.keep_top_values(impressions(spark, sf_dir), "country", 10)
    return rounded(
        kept.groupBy("country").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.log1p("iap_revenue_d7")).alias("mean_log_revenue")
        )
    )


@query(
    "corr_matrix",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'corr', 5)} FROM imp"
        for i, a in enumerate(("value", "hour", "iap_revenue_d7", "wifi_ratio", "iap_revenue_d14"))
        for b in ("value", "hour", "iap_revenue_d7", "wifi_ratio", "iap_revenue_d14")[i + 1 :]
    ),
)
def corr_matrix(spark, sf_dir):
    cols = ("value", "hour", "iap_revenue_d7", "wifi_ratio", "iap_revenue_d14")
    return rounded(profiling.correlations(impressions(spark, sf_dir), cols), 5)


@query(
    "group_means",
    f"""WITH {IMPRESSIONS} SELECT hour, count(*) AS n, {r('avg(ln(1 + iap_revenue_d7))', 'mean_log_revenue')},
      {r('avg(buyer_d7)', 'mean_buyer_d7')} FROM imp GROUP BY hour""",
)
def group_means(spark, sf_dir):
    df = impressions(spark, sf_dir).withColumn("log_revenue", F.log1p("iap_revenue_d7"))
    return rounded(profiling.group_means(df, "hour", ["log_revenue", "buyer_d7"]))


def describe_sql(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS count, {r(f'avg({c})', 'mean', 5)}, {r(f'stddev_samp({c})', 'std', 5)},
    min({c})::DOUBLE AS min, {r(f'quantile_cont({c}, 0.25)', 'q25', 5)}, {r(f'quantile_cont({c}, 0.5)', 'q50', 5)},
    {r(f'quantile_cont({c}, 0.75)', 'q75', 5)}, max({c})::DOUBLE AS max, count(DISTINCT {c}) AS n_unique FROM {t}"""


@query(
    "describe",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(describe_sql(c, "imp") for c in ("value", "wifi_ratio", "weeks_since_first_seen", "hour")),
)
def describe(spark, sf_dir):
    cols = ("value", "wifi_ratio", "weeks_since_first_seen", "hour")
    return rounded(profiling.describe(impressions(spark, sf_dir), cols), 5)


@query(
    "describe_lineitem",
    " UNION ALL ".join(describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
def describe_lineitem(spark, sf_dir):
    return rounded(profiling.describe(table(spark, sf_dir, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount")), 5)
