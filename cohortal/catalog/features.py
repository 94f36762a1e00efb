"""Feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import query, r, rounded, rs
from cohortal.catalog.views_sql import CELLS, IMPRESSIONS, cell_stats, md5_code, md5_key
from cohortal.operators import features, target_stats
from cohortal.plans.prepare import engineer, flatten_nested
from cohortal.sources.views import impressions, table, wide_impressions


def behaviour(spark, sf_dir):
    """Impressions renamed to the inputs of the interaction features; some are text."""
    k = F.col("k")
    return impressions(spark, sf_dir).select(
        "row_id", "datetime", "hour", "weekday", "avg_act_days", "weeks_since_first_seen", "wifi_ratio", "release_msrp",
        F.col("value").alias("whale_users_bundle_revenue_prank_mean"),
        (k % 5).alias("avg_daily_sessions_total"),
        F.col("dev_osv").alias("num_buys_bundle_mean"),
        (k / 101.0).alias("last_buy_recency_weight"),
        (k % 3).alias("new_bundles_count"),
        (F.col("value") * 2.0).alias("iap_revenue_usd_category_mean"),
        (k % 4).alias("num_buys_category_count"),
        F.col("value").alias("iap_revenue_usd_bundle_mean"),
        F.when(k % 8 != 0, k * 1.5).alias("avg_duration_mean"),
        (k % 9).alias("region_hist_top1_freq"),
        F.when(k % 2 == 0, F.lit(9999)).otherwise(k).alias("last_buy_days_ago"),
    )


BEHAVIOUR = (
    IMPRESSIONS
    + """,
beh AS (SELECT row_id, datetime, hour, weekday, avg_act_days, weeks_since_first_seen, wifi_ratio, release_msrp,
  value AS whale, k % 5 AS sessions, coalesce(TRY_CAST(dev_osv AS DOUBLE), 0) AS buys, k / 101 AS recency,
  k % 3 AS new_bundles, value * 2 AS cat_rev, k % 4 AS cat_n, value AS rev,
  CASE WHEN k % 8 <> 0 THEN k * 1.5::DOUBLE END AS duration, k % 9 AS top1,
  CASE WHEN k % 2 = 0 THEN 9999 ELSE k END AS days_ago FROM imp)"""
)
WEEKS = "coalesce(weeks_since_first_seen, 0)"


@query(
    "interactions",
    f"""WITH {BEHAVIOUR} SELECT row_id, {r('whale * sessions', 'whale_x_freq')},
      {r('buys * recency', 'purchase_recency_score')}, {r(f'new_bundles / ({WEEKS} + 1)', 'install_velocity')},
      {r('cat_rev / (cat_n + 1)', 'category_avg_purchase_value')},
      {r('rev / (release_msrp + 1)', 'device_spending_ratio')} FROM beh""",
)
def interactions(spark, sf_dir):
    out = features.add_interactions(behaviour(spark, sf_dir))
    return rounded(
        out.select(
            "row_id", "whale_x_freq", "purchase_recency_score", "install_velocity",
            "category_avg_purchase_value", "device_spending_ratio",
        )
    )


@query(
    "activity_intensity",
    f"WITH {BEHAVIOUR} SELECT row_id, {r(f'avg_act_days / ({WEEKS} + 1)', 'activity_intensity')} FROM beh",
)
def activity_intensity(spark, sf_dir):
    out = features.add_activity_intensity(behaviour(spark, sf_dir))
    return rounded(out.select("row_id", "activity_intensity"))


@query(
    "behaviour_products",
    f"""WITH {BEHAVIOUR} SELECT row_id, {r('sessions * avg_act_days', 'session_consistency')},
      {r('sessions * coalesce(duration, 0)', 'engagement_score')},
      {r('sessions * coalesce(wifi_ratio, 0)', 'wifi_engagement')} FROM beh""",
)
def behaviour_products(spark, sf_dir):
    out = features.add_behaviour_products(behaviour(spark, sf_dir))
    return rounded(out.select("row_id", "session_consistency", "engagement_score", "wifi_engagement"))


@query(
    "zero_flags",
    f"""WITH {BEHAVIOUR} SELECT row_id, CAST(cat_n <= 0 AS INTEGER) AS no_category_buys,
      CAST(new_bundles <= 0 AS INTEGER) AS no_new_bundles, CAST(sessions <= 0 AS INTEGER) AS no_sessions_recorded,
      CAST(coalesce(duration, 0) <= 0 AS INTEGER) AS no_session_duration,
      CAST(top1 <= 0 AS INTEGER) AS region_hist_missing_hist,
      CAST(days_ago >= 9990 AS INTEGER) AS never_bought_before FROM beh""",
)
def zero_flags(spark, sf_dir):
    return features.add_zero_flags(behaviour(spark, sf_dir)).select(
        "row_id", "no_category_buys", "no_new_bundles", "no_sessions_recorded", "no_session_duration",
        "region_hist_missing_hist", "never_bought_before",
    )


PI2 = "2 * pi()"


@query(
    "cyclic_time",
    f"""WITH {IMPRESSIONS} SELECT row_id, {r(f'sin({PI2} * hour / 24)', 'hour_sin')}, {r(f'cos({PI2} * hour / 24)', 'hour_cos')},
      {r(f'sin({PI2} * weekday / 7)', 'weekday_sin')}, {r(f'cos({PI2} * weekday / 7)', 'weekday_cos')},
      CAST(hour >= 6 AND hour < 12 AS INTEGER) AS is_morning, CAST(hour >= 12 AND hour < 18 AS INTEGER) AS is_afternoon,
      CAST(hour >= 18 AND hour < 22 AS INTEGER) AS is_evening, CAST(hour >= 22 OR hour < 6 AS INTEGER) AS is_night,
      CAST(weekday IN (5, 6) AS INTEGER) AS is_weekend FROM imp""",
)
def cyclic_time(spark, sf_dir):
    out = features.add_cyclic_time(impressions(spark, sf_dir))
    return rounded(
        out.select(
            "row_id", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
            "is_morning", "is_afternoon", "is_evening", "is_night", "is_weekend",
        )
    )


@query(
    "hour_groups",
    f"""WITH {IMPRESSIONS}, h AS (SELECT row_id, CASE WHEN k % 11 = 0 THEN 0 ELSE hour END AS hour FROM imp)
    SELECT row_id, hour, {r(f'sin({PI2} * hour / 24)', 'hour_sin')}, {r(f'cos({PI2} * hour / 24)', 'hour_cos')},
      CASE WHEN hour <= 6 THEN 'night' WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon'
           ELSE 'evening' END AS hour_group,
      CAST(hour <= 6 AS INTEGER) AS is_night_6, CAST(hour >= 18 AS INTEGER) AS is_evening_18 FROM h""",
)
def hour_groups(spark, sf_dir):
    hour = F.when(F.col("k") % 11 != 0, F.col("hour")).alias("hour")
    return rounded(features.add_hour_groups(impressions(spark, sf_dir).select("row_id", hour)))


RANK_SQL = (
    "(rank() OVER (PARTITION BY {c} ORDER BY {t}) + "
    "(count(*) OVER (PARTITION BY {c}, {t}) - 1) / 2) / count(*) OVER (PARTITION BY {c})"
)


@query(
    "local_rank",
    f"""WITH {IMPRESSIONS} SELECT row_id,
      {r(RANK_SQL.format(c='country', t='iap_revenue_d7'), 'country_local_spend_rank')},
      {r(RANK_SQL.format(c='advertiser_category', t='iap_revenue_d7'), 'advertiser_category_local_spend_rank')}
    FROM imp""",
)
def local_rank(spark, sf_dir):
    out = impressions(spark, sf_dir).select("row_id", "country", "advertiser_category", "iap_revenue_d7")
    for context in ("country", "advertiser_category"):
        out = features.add_local_rank(out, context, "iap_revenue_d7")
    return rounded(out.drop("country", "advertiser_category", "iap_revenue_d7"))


@query(
    "local_rank_orders",
    f"SELECT o_orderkey, {r(RANK_SQL.format(c='o_orderpriority', t='o_totalprice'), 'o_orderpriority_local_spend_rank')} FROM orders",
)
def local_rank_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = features.add_local_rank(orders, "o_orderpriority", "o_totalprice", ident="o_orderkey")
    return rounded(out.select("o_orderkey", "o_orderpriority_local_spend_rank"))


@query(
    "local_mean_dev",
    f"""WITH {IMPRESSIONS}, m AS (SELECT *, avg(iap_revenue_d7) OVER (PARTITION BY country) AS m FROM imp)
    SELECT row_id, {r('m', 'country_local_avg_spend')}, {r('(iap_revenue_d7 - m) / (m + 1)', 'country_spend_deviation')}
    FROM m""",
)
def local_mean_dev(spark, sf_dir):
    out = features.add_local_mean(impressions(spark, sf_dir), "country", "iap_revenue_d7")
    return rounded(out.select("row_id", "country_local_avg_spend", "country_spend_deviation"))


@query(
    "target_encode",
    f"""WITH {IMPRESSIONS}, g AS (SELECT avg(buyer_d7) AS g FROM imp),
    s AS (SELECT carrier, avg(buyer_d7) AS m, 1 / (1 + exp(-(count(buyer_d7) - 1775))) AS w FROM imp
          WHERE carrier IS NOT NULL GROUP BY carrier)
    SELECT row_id, {r('coalesce(g.g * (1 - s.w) + s.m * s.w, g.g)', 'carrier_te')}
    FROM imp CROSS JOIN g LEFT JOIN s ON s.carrier = imp.carrier""",
)
def target_encode(spark, sf_dir):
    df = impressions(spark, sf_dir)
    encoding, overall = features.fit_target_encoding(df, "carrier", "buyer_d7", min_samples=1775)
    return rounded(features.map_stats(df.select("row_id", "carrier"), encoding, "carrier", overall).drop("carrier"))


WHALE_SQL = """SELECT '{label}' AS statistic, {c} AS grp, {rate} FROM imp, (
  SELECT quantile_cont(iap_revenue_d7, 0.8) AS t FROM imp {where}) GROUP BY {c}"""


@query(
    "whale_rate",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(
        WHALE_SQL.format(
            label=label, c=c, where=where,
            rate=r("avg(CASE WHEN iap_revenue_d7 >= t THEN 1 ELSE 0 END)", "rate"),
        )
        for label, c, where in (
            ("category", "advertiser_category", "WHERE iap_revenue_d7 > 0"),
            ("country", "country", "WHERE iap_revenue_d7 > 0"),
            ("category_all_rows", "advertiser_category", ""),
        )
    ),
)
def whale_rate(spark, sf_dir):
    df = impressions(spark, sf_dir)
    paying = features.whale_threshold(df, "iap_revenue_d7")
    every = features.whale_threshold(df, "iap_revenue_d7", positive_only=False)
    part = lambda label, c, t: features.whale_rate(df, c, "iap_revenue_d7", t, "rate").select(
        F.lit(label).alias("statistic"), F.col(c).alias("grp"), "rate"
    )
    out = part("category", "advertiser_category", paying).unionByName(part("country", "country", paying))
    return rounded(out.unionByName(part("category_all_rows", "advertiser_category", every)))


@query(
    "country_stats",
    f"""WITH {IMPRESSIONS} SELECT row_id, {r("a", "country_avg_rev")}, {r("f", "country_freq")} FROM imp
    JOIN (SELECT country, avg(iap_revenue_d7) AS a, count(*) / (SELECT count(*) FROM imp WHERE country IS NOT NULL) AS f
          FROM imp GROUP BY country) USING (country)""",
)
def country_stats(spark, sf_dir):
    df = impressions(spark, sf_dir)
    out = df.select("row_id", "country")
    out = features.map_stats(out, features.group_mean(df, "country", "iap_revenue_d7", "country_avg_rev"), "country", 0.0)
    out = features.map_stats(out, features.group_share(df, "country", "country_freq"), "country", 0.0)
    return rounded(out.drop("country"))


@query(
    "value_freq",
    f"""WITH {IMPRESSIONS} SELECT carrier, {r("count(*) / (SELECT count(carrier) FROM imp)", "carrier_freq")} FROM imp
    WHERE carrier IS NOT NULL GROUP BY carrier""",
)
def value_freq(spark, sf_dir):
    return rounded(features.group_share(impressions(spark, sf_dir), "carrier", "carrier_freq"))


@query(
    "map_lookup",
    f"""WITH {IMPRESSIONS}, s AS (SELECT carrier, avg(value) AS m FROM imp WHERE k < 30 AND carrier <> 'carrier2' GROUP BY carrier)
    SELECT row_id, {r("coalesce(s.m, -1)", "carrier_mean")} FROM imp LEFT JOIN s ON s.carrier = imp.carrier""",
)
def map_lookup(spark, sf_dir):
    df = impressions(spark, sf_dir)
    stats = features.group_mean(df.where("k < 30 AND carrier <> 'carrier2'"), "carrier", "value", "carrier_mean")
    return rounded(features.map_stats(df.select("row_id", "carrier"), stats, "carrier", -1.0).drop("carrier"))


QCUT = """edges AS (SELECT DISTINCT unnest(quantile_cont({x}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM {t})"""


@query(
    "qcut_bins",
    f"""WITH {IMPRESSIONS}, x AS (SELECT row_id, coalesce(weeks_since_first_seen, 0) AS x FROM imp), {QCUT.format(x='x', t='x')}
    SELECT row_id, CAST(greatest((SELECT count(*) FROM edges WHERE e < x.x) - 1, 0) AS INTEGER) AS weeks_bin FROM x""",
)
def qcut_bins(spark, sf_dir):
    df = impressions(spark, sf_dir)
    edges = features.fit_quantile_bins(df, "weeks_since_first_seen")
    return df.select("row_id", features.quantile_bin("weeks_since_first_seen", edges).alias("weeks_bin"))


@query(
    "qcut_lineitem",
    f"""WITH {QCUT.format(x='l_extendedprice', t='lineitem')}, b AS (
      SELECT greatest((SELECT count(*) FROM edges WHERE e < l_extendedprice) - 1, 0) AS price_bin, l_discount, l_quantity FROM lineitem)
    SELECT CAST(price_bin AS INTEGER) AS price_bin, count(*) AS n, {r("avg(l_discount)", "mean_l_discount")},
      {r("avg(l_quantity)", "mean_l_quantity")} FROM b GROUP BY price_bin""",
)
def qcut_lineitem(spark, sf_dir):
    from cohortal.operators.profiling import group_means

    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", "l_quantity")
    edges = features.fit_quantile_bins(df, "l_extendedprice")
    binned = df.withColumn("price_bin", features.quantile_bin("l_extendedprice", edges))
    return rounded(group_means(binned, "price_bin", ["l_discount", "l_quantity"]))


@query(
    "engineer_all",
    f"""WITH {IMPRESSIONS}, {CELLS[CELLS.index('cells AS'):]},
    per AS (SELECT user_id, {cell_stats('avg_daily_sessions', ('total',))}, {cell_stats('avg_duration', ('mean',))},
      {cell_stats('iap_revenue_usd_category', ('mean',))}, {cell_stats('num_buys_category', ('count',))} FROM cells GROUP BY user_id),
    bundles AS (SELECT user_id, count(*) FILTER (WHERE weekday >= 5) AS new_n FROM items GROUP BY user_id)
    SELECT row_id, {md5_code("coalesce(carrier, '__missing__')")} AS carrier,
      {r('new_n / (coalesce(weeks_since_first_seen, 0) + 1)', 'install_velocity')},
      {r('iap_revenue_usd_category_mean / (num_buys_category_count + 1)', 'category_avg_purchase_value', 5)},
      {r('avg_daily_sessions_total * avg_act_days', 'session_consistency')},
      {r('avg_daily_sessions_total * avg_duration_mean', 'engagement_score', 3)},
      {r(f'sin({PI2} * hour / 24)', 'hour_sin')},
      CAST(last_buy IS NULL AS INTEGER) AS never_bought_before,
      {r(RANK_SQL.format(c='country', t='iap_revenue_d7'), 'country_local_spend_rank')}
    FROM imp JOIN per USING (user_id) JOIN bundles USING (user_id)""",
)
def engineer_all(spark, sf_dir):
    flat = flatten_nested(wide_impressions(spark, sf_dir), "2024-01-31")
    out = engineer(flat, local_target="iap_revenue_d7", portable_hash=True)
    return rounded(out.withColumns({
        "category_avg_purchase_value": F.round("category_avg_purchase_value", 5),
        "engagement_score": F.round("engagement_score", 3),
    }).select(
        "row_id", "carrier", "install_velocity", "category_avg_purchase_value", "session_consistency",
        "engagement_score", "hour_sin", "never_bought_before", "country_local_spend_rank",
    ))


ORDERED = ("advertiser_category", "country", "user_id")


def _ordered_sql() -> str:
    key = md5_key()
    stat = lambda c: r(
        f"(coalesce(sum(buyer_d7) OVER (PARTITION BY {c} ORDER BY {key}, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5) "
        f"/ (count(*) OVER (PARTITION BY {c} ORDER BY {key}, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)",
        f"{c}_ts",
    )
    return f"WITH {IMPRESSIONS} SELECT row_id, {', '.join(map(stat, ORDERED))} FROM imp"


@query("ordered_target_stats", _ordered_sql())
def ordered_target_stats(spark, sf_dir):
    """Few, some and very many values of a category, all encoded by the labels of earlier rows."""
    out = target_stats.ordered_stats(impressions(spark, sf_dir), ORDERED, "buyer_d7", portable=True)
    return rounded(out.select("row_id", *[f"{c}_ts" for c in ORDERED]))


@query(
    "category_encoder",
    f"""WITH {IMPRESSIONS}, early AS (SELECT country, buyer_d7 FROM imp WHERE datetime < '2024-01-16-00-00'),
    t AS (SELECT country, sum(buyer_d7) AS total, count(*) AS n FROM early GROUP BY country)
    SELECT row_id, {r('coalesce((total + 0.5) / (n + 1), 0.5)', 'country_ts')} FROM imp LEFT JOIN t ON t.country IS NOT DISTINCT FROM imp.country
    WHERE datetime >= '2024-01-16-00-00'""",
)
def category_encoder(spark, sf_dir):
    """Totals of the first half of the month applied to the second."""
    imp = impressions(spark, sf_dir)
    encoder = target_stats.fit_encoder(imp.where("datetime < '2024-01-16-00-00'"), ["country"], "buyer_d7")
    return rounded(encoder.apply(imp.where("datetime >= '2024-01-16-00-00'").select("row_id", "country")).select("row_id", "country_ts"))
