"""Feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import names_table, query, r, rounded
from cohortal.catalog.views_sql import IMPRESSIONS
from cohortal.operators import neighbours, profiling, selection
from cohortal.sources.views import impressions, table

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
MODEL_COLUMNS = ("hour", "weekday", "value", "k", "avg_act_days", "weekend_ratio", "release_msrp", "wifi_ratio")


def _corr_columns(spark, sf_dir):
    """Lineitem measures, two that nearly repeat another, and two with gaps."""
    return table(spark, sf_dir, "lineitem").select(
        *LINE,
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("net_price"),
        (F.col("l_quantity") * 3.0 + F.col("l_tax")).alias("scaled_quantity"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") + 50.0).alias("gappy_tax"),
        F.when(F.col("l_linenumber") % 3 != 1, F.col("l_quantity") * 2.0).alias("gappy_quantity"),
    )


CORR_COLUMNS = (*LINE, "net_price", "scaled_quantity", "gappy_tax")
CORR_SQL = """c AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 - l_discount) AS net_price, l_quantity * 3 + l_tax AS scaled_quantity,
  CASE WHEN l_linenumber % 3 != 0 THEN l_tax + 50 END AS gappy_tax,
  CASE WHEN l_linenumber % 3 != 1 THEN l_quantity * 2 END AS gappy_quantity FROM lineitem)"""


@query(
    "low_variance",
    f"WITH {CORR_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'var_pop({c})', 'variance', 4)}, var_pop({c}) > 0.01 AS kept FROM c"
        for c in CORR_COLUMNS
    ),
)
def low_variance(spark, sf_dir):
    df = _corr_columns(spark, sf_dir)
    kept = set(selection.keep_by_variance(df, CORR_COLUMNS))
    rows = [(c, float(v), c in kept) for c, v in selection.variances(df, CORR_COLUMNS).items()]
    return rounded(spark.createDataFrame(rows, "feature string, variance double, kept boolean"), 4)


@query(
    "high_corr_pairs",
    f"WITH {CORR_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})', 'corr', 5)} FROM c"
        for i, a in enumerate(CORR_COLUMNS)
        for b in CORR_COLUMNS[i + 1 :]
    ),
)
def high_corr_pairs(spark, sf_dir):
    return rounded(profiling.correlations(_corr_columns(spark, sf_dir), CORR_COLUMNS), 5)


@query(
    "high_corr_drop",
    # net_price follows l_extendedprice and scaled_quantity follows l_quantity; the larger variance stays.
    f"""WITH {CORR_SQL}, s AS (SELECT corr(l_extendedprice, net_price) > 0.95 AS a, corr(l_quantity, scaled_quantity) > 0.95 AS b,
      corr(l_tax, gappy_tax) > 0.95 AS g, var_samp(gappy_tax) >= var_samp(l_tax) AS vg,
      var_samp(net_price) > var_samp(l_extendedprice) AS va, var_samp(scaled_quantity) > var_samp(l_quantity) AS vb FROM c)
    SELECT 'l_discount' AS feature
    UNION ALL SELECT CASE WHEN vg THEN 'gappy_tax' ELSE 'l_tax' END FROM s WHERE g
    UNION ALL SELECT CASE WHEN va THEN 'net_price' ELSE 'l_extendedprice' END FROM s WHERE a
    UNION ALL SELECT CASE WHEN vb THEN 'scaled_quantity' ELSE 'l_quantity' END FROM s WHERE b""",
)
def high_corr_drop(spark, sf_dir):
    kept = selection.keep_by_correlation(_corr_columns(spark, sf_dir), CORR_COLUMNS, 0.95)
    return names_table(spark, kept, "feature")


@query(
    "f_test_classes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r('(sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*)))', 'f_value', 4)}
        FROM (SELECT l_returnflag, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag)"""
        for c in LINE
    ),
)
def f_test_classes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *LINE)
    return rounded(selection.f_scores(df, LINE, "l_returnflag"), 4)


@query(
    "f_test_regression",
    f"WITH {CORR_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {r(f'power(corr({c}, l_tax), 2) * (count({c}) - 2) / (1 - power(corr({c}, l_tax), 2))', 'f_value', 4)} FROM c"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "net_price", "gappy_quantity")
    ),
)
def f_test_regression(spark, sf_dir):
    wanted = ("l_quantity", "l_extendedprice", "l_discount", "net_price", "gappy_quantity")
    return rounded(selection.f_scores(_corr_columns(spark, sf_dir), wanted, "l_tax", task="regression"), 4)


MI_GRID = "[" + ", ".join(repr(i / 10) for i in range(11)) + "]"


def _mi_sql(c: str) -> str:
    return f"""(WITH x AS (SELECT coalesce({c}, 0)::DOUBLE AS x, buyer_d7 AS y FROM imp),
    edges AS (SELECT DISTINCT unnest(quantile_cont(x, {MI_GRID})) AS e FROM x),
    b AS (SELECT greatest((SELECT count(*) FROM edges WHERE e < x.x) - 1, 0) AS b, y FROM x),
    j AS (SELECT b, y, count(*) AS n FROM b GROUP BY b, y),
    w AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM j)
    SELECT '{c}' AS feature, round(sum(n / t * ln(n::DOUBLE * t::DOUBLE / (nb::DOUBLE * ny::DOUBLE))), 6) + 0 AS mutual_information FROM w)"""


MI_COLUMNS = ("value", "hour", "wifi_ratio", "weeks_since_first_seen")


@query("binned_mi", f"WITH {IMPRESSIONS} " + " UNION ALL ".join(_mi_sql(c) for c in MI_COLUMNS))
def binned_mi(spark, sf_dir):
    df = impressions(spark, sf_dir)
    return rounded(selection.binned_mutual_information(df, MI_COLUMNS, "buyer_d7"))


GROUPS = {"price": ("l_extendedprice", "net_price"), "volume": ("l_quantity", "scaled_quantity"), "rates": ("l_discount", "l_tax")}


@query(
    "group_importance",
    f"WITH {CORR_SQL}, i AS ("
    + " UNION ALL ".join(
        f"SELECT '{g}' AS feature_group, '{c}' AS feature, stddev_pop({c}) AS v FROM c"
        for g, cs in GROUPS.items()
        for c in cs
    )
    + f""") SELECT feature_group, count(*) AS n_features, {r('sum(v)', 'total_importance', 4)}, {r('avg(v)', 'mean_importance', 4)},
    {r('max(v)', 'max_importance', 4)}, arg_max(feature, v) AS top_feature FROM i GROUP BY feature_group""",
)
def group_importance(spark, sf_dir):
    df = _corr_columns(spark, sf_dir)
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in CORR_COLUMNS])
    found = spread.unpivot([], list(CORR_COLUMNS), "feature", "importance")
    return rounded(selection.group_importance(found, GROUPS), 4)


@query(
    "importance_report",
    f"WITH {CORR_SQL} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'stddev_pop({c})', 'importance', 4)} FROM c" for c in CORR_COLUMNS)
    + ") ORDER BY importance DESC LIMIT 3",
)
def importance_report(spark, sf_dir):
    df = _corr_columns(spark, sf_dir)
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in CORR_COLUMNS])
    found = spread.unpivot([], list(CORR_COLUMNS), "feature", "importance")
    return rounded(profiling.top_importances(found, 3), 4)


@query("boosting_importance")
def boosting_importance(spark, sf_dir):
    return selection.importances(impressions(spark, sf_dir), MODEL_COLUMNS, "buyer_d7", "boosting", rounds=10, depth=4)


@query("forest_importance")
def forest_importance(spark, sf_dir):
    df = impressions(spark, sf_dir)
    return selection.importances(df, MODEL_COLUMNS, "iap_revenue_d7", "forest", "regression", rounds=20, depth=6)


@query("lasso_importance")
def lasso_importance(spark, sf_dir):
    return selection.importances(impressions(spark, sf_dir), MODEL_COLUMNS, "iap_revenue_d7", "lasso", "regression")


@query("rfe")
def rfe(spark, sf_dir):
    kept = selection.eliminate_recursively(
        impressions(spark, sf_dir), MODEL_COLUMNS, "buyer_d7", n_features=5, rounds=5
    )
    return names_table(spark, kept, "feature")


@query("select_features")
def select_features(spark, sf_dir):
    _, report = selection.select_features(
        impressions(spark, sf_dir).withColumn("value_again", F.col("value") * 2.0),
        (*MODEL_COLUMNS, "value_again"), "buyer_d7", rounds=5,
    )
    return report.table(spark)


NEAREST_COLUMNS = ("hour", "weekday", "k", "cents")


def _nearest_mi_sql() -> str:
    """The estimate by comparing all rows of a feature, equal values taken together."""
    psi = lambda n: "(" + "ln({0} + 6) - 1 / (2 * ({0} + 6)) - 1 / (12 * power({0} + 6, 2)) + 1 / (120 * power({0} + 6, 4)) - 1 / (252 * power({0} + 6, 6))".format(f"{n}::DOUBLE") + "".join(
        f" - 1 / ({n}::DOUBLE + {j})" for j in range(6)
    ) + ")"
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, buyer_d7 AS label, CAST({'round(value * 100)' if c == 'cents' else c} AS BIGINT) AS v FROM imp" for c in NEAREST_COLUMNS)
    return f"""WITH {IMPRESSIONS}, long AS ({long}),
    counts AS (SELECT feature, label, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, label) AS size FROM long GROUP BY feature, label, v),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY feature, label ORDER BY v) AS i, least(3, size - 1) AS k FROM counts WHERE size > 1),
    met AS (SELECT a.feature, a.label, a.v, a.k, abs(a.v - b.v) AS far, sum(b.n - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS n
      FROM ranked a JOIN ranked b ON a.feature = b.feature AND a.label = b.label AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY ALL),
    seen AS (SELECT *, sum(n) OVER (PARTITION BY feature, label, v ORDER BY far) AS upto FROM met),
    radii AS (SELECT feature, label, v, min(far) AS d FROM seen WHERE upto >= k GROUP BY ALL),
    points AS (SELECT feature, v, sum(n) AS n FROM ranked GROUP BY feature, v),
    inside AS (SELECT r.feature, r.label, r.v, sum(p.n) AS m FROM radii r JOIN points p
      ON p.feature = r.feature AND (abs(p.v - r.v) < r.d OR p.v = r.v) GROUP BY ALL)
    SELECT feature, {r(f"greatest({psi('sum(n)')} - sum(n * {psi('size')}) / sum(n) + sum(n * {psi('k')}) / sum(n) - sum(n * {psi('m')}) / sum(n), 0)", 'mi', 6)}
    FROM ranked JOIN inside USING (feature, label, v) GROUP BY feature"""


@query("nearest_mi", _nearest_mi_sql())
def nearest_mi(spark, sf_dir):
    """Few and many distinct values against the buying label."""
    df = impressions(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100))
    return rounded(neighbours.nearest_mi(df, NEAREST_COLUMNS, "buyer_d7"))
