"""Splits, filters and rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import names_table, query, r, rounded
from cohortal.catalog.views_sql import EVENTS, IMPRESSIONS, md5_key
from cohortal.operators import sampling, splits
from cohortal.sources.views import impressions, profiles, table

TRAIN = ("2024-01-01-00-00", "2024-01-10-23-00")
VAL = ("2024-01-11-00-00", "2024-01-14-23-00")
GRID30 = "[" + ", ".join(repr(i / 30) for i in range(31)) + "]"


@query(
    "hash_sample",
    f"WITH {EVENTS} SELECT row_id, value FROM ev WHERE {md5_key()} < {int(0.35 * (1 << 60))}",
)
def hash_sample(spark, sf_dir):
    return splits.hash_sample(impressions(spark, sf_dir).select("row_id", "value"), 0.35, portable=True)


@query(
    "temporal_split",
    f"""WITH {IMPRESSIONS} SELECT CASE WHEN datetime <= '{TRAIN[1]}' THEN 'train' ELSE 'val' END AS split, row_id,
      iap_revenue_d7, iap_revenue_d14 FROM imp WHERE datetime BETWEEN '{TRAIN[0]}' AND '{VAL[1]}'""",
)
def temporal_split(spark, sf_dir):
    train, val = splits.temporal_split(impressions(spark, sf_dir), TRAIN, VAL)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    return both.select("split", "row_id", "iap_revenue_d7", "iap_revenue_d14")


@query(
    "val_fallback",
    f"WITH {EVENTS} SELECT row_id, value FROM ev ORDER BY {md5_key()}, row_id LIMIT 512",
)
def val_fallback(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "value")
    return splits.validation_or_fallback(df, df.where("row_id < 0"), 512, portable=True)


@query(
    "stratified_split",
    f"""WITH {IMPRESSIONS}, s AS (SELECT row_id, carrier, row_number() OVER (PARTITION BY carrier ORDER BY {md5_key()}, row_id) AS rn,
      count(*) OVER (PARTITION BY carrier) AS n FROM imp)
    SELECT row_id, CASE WHEN rn <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'val' END AS split FROM s""",
)
def stratified_split(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "carrier")
    return splits.stratified_split(df, 0.8, "carrier", portable=True).select("row_id", "split")


@query(
    "time_split",
    f"""WITH {EVENTS}, s AS (SELECT row_id, row_number() OVER (ORDER BY datetime, row_id) AS rn, count(*) OVER () AS n FROM ev)
    SELECT row_id, CASE WHEN rn <= floor(n * 0.85) THEN 'train' ELSE 'val' END AS split FROM s""",
)
def time_split(spark, sf_dir):
    return splits.time_split(impressions(spark, sf_dir).select("row_id", "datetime")).select("row_id", "split")


@query(
    "buyer_filter",
    f"WITH {IMPRESSIONS} SELECT row_id, iap_revenue_d1 FROM imp WHERE buyer_d7 = 1 AND iap_revenue_d1 >= 0",
)
def buyer_filter(spark, sf_dir):
    return splits.buyers(impressions(spark, sf_dir), "buyer_d7", "iap_revenue_d1").select("row_id", "iap_revenue_d1")


@query(
    "zero_buyer_removal",
    f"""WITH {IMPRESSIONS} SELECT count(*) AS n_buyers, count(*) FILTER (WHERE iap_revenue_d1 = 0) AS n_removed,
      {r("100.0 * count(*) FILTER (WHERE iap_revenue_d1 = 0) / count(*)", 'pct_removed')},
      count(*) FILTER (WHERE iap_revenue_d1 > 0) AS n_kept FROM imp WHERE buyer_d7 = 1""",
)
def zero_buyer_removal(spark, sf_dir):
    kept, report = splits.paying_buyers(impressions(spark, sf_dir), "buyer_d7", "iap_revenue_d1")
    return rounded(report.withColumn("n_kept", F.lit(kept.count()).cast("bigint")))


@query(
    "whale_filter",
    f"""WITH {IMPRESSIONS}, b AS (SELECT * FROM imp WHERE iap_revenue_d7 > 0)
    SELECT row_id, iap_revenue_d7 FROM b
    WHERE iap_revenue_d7 <= (SELECT least(400, quantile_cont(iap_revenue_d7, 0.9)) FROM b)""",
)
def whale_filter(spark, sf_dir):
    paying, _ = splits.paying_buyers(impressions(spark, sf_dir))
    return splits.drop_whales(paying, max_revenue=400.0, percentile=90.0).select("row_id", "iap_revenue_d7")


REVENUES = ("iap_revenue_d1", "iap_revenue_d7", "iap_revenue_d14")


@query(
    "revenue_cap",
    f"WITH {IMPRESSIONS} SELECT row_id, "
    + ", ".join(f"least(greatest({c}, 0), 300) AS {c}" for c in REVENUES)
    + " FROM imp",
)
def revenue_cap(spark, sf_dir):
    return sampling.cap_revenue(impressions(spark, sf_dir), 300.0, REVENUES).select("row_id", *REVENUES)


@query(
    "revenue_cap_report",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS target, {r(f'avg({c})', 'mean_before')}, {r(f'avg(least({c}, 300))', 'mean_after')},
        max({c}) AS max_before, count(*) FILTER (WHERE {c} > 300) AS n_capped,
        {r(f'100.0 * count(*) FILTER (WHERE {c} > 300) / count(*)', 'pct_capped')} FROM imp"""
        for c in REVENUES
    ),
)
def revenue_cap_report(spark, sf_dir):
    return rounded(sampling.cap_report(impressions(spark, sf_dir), 300.0, REVENUES))


@query(
    "log_target_clip",
    f"""WITH {IMPRESSIONS}, q AS (SELECT quantile_cont(iap_revenue_d7, 0.999) AS q FROM imp)
    SELECT row_id, {r('ln(1 + least(greatest(iap_revenue_d7, 0), q))', 'iap_revenue_d7_log')},
      {r('least(greatest(iap_revenue_d7, 0), q)', 'back')} FROM imp, q""",
)
def log_target_clip(spark, sf_dir):
    from cohortal.core.ranks import quantiles

    df = impressions(spark, sf_dir).select("row_id", "iap_revenue_d7")
    upper = quantiles(df, "iap_revenue_d7", [0.999])[0]
    out = sampling.log_target(df, upper).withColumn("back", F.expm1("iap_revenue_d7_log"))
    return rounded(out.select("row_id", "iap_revenue_d7_log", "back"))


@query(
    "constant_columns",
    f"""WITH {IMPRESSIONS}, c AS (SELECT count(DISTINCT one) + max(CAST(one IS NULL AS INTEGER)) AS one,
        count(DISTINCT gap) + max(CAST(gap IS NULL AS INTEGER)) AS gap,
        count(DISTINCT country) + max(CAST(country IS NULL AS INTEGER)) AS country
      FROM (SELECT country, 'x' AS one, CASE WHEN k < 50 THEN 7 END AS gap FROM imp))
    SELECT 'one' AS column_name FROM c WHERE one <= 1 UNION ALL SELECT 'gap' FROM c WHERE gap <= 1
    UNION ALL SELECT 'country' FROM c WHERE country <= 1""",
)
def constant_columns(spark, sf_dir):
    df = impressions(spark, sf_dir).select(
        "row_id", "buyer_d7", "country", F.lit("x").alias("one"), F.when(F.col("k") < 50, F.lit(7)).alias("gap")
    )
    return names_table(spark, splits.constant_columns(df), "column_name")


BINS_SQL = """{base}, edges AS (SELECT DISTINCT unnest(quantile_cont({y}, {grid})) AS e FROM {t}),
ne AS (SELECT count(*) AS ne FROM edges),
binned AS (SELECT {t}.*, {cap} AS bin FROM {t}, ne),
hist AS (SELECT i, (SELECT count(*) FROM binned WHERE bin = i) AS n FROM range(1, (SELECT ne FROM ne)) x(i))"""
OPEN = "(SELECT count(*) FROM edges WHERE e <= {y})"


@query(
    "histos",
    f"""WITH {BINS_SQL.format(base=IMPRESSIONS, t='imp', y='iap_revenue_d7', grid=GRID30, cap=OPEN.format(y='iap_revenue_d7'))},
    goal AS (SELECT quantile_cont(n, 0.75) AS g FROM hist)
    SELECT row_id, CAST(coalesce(greatest(1, floor(g / hist.n)), 1) AS BIGINT) AS copies
    FROM binned CROSS JOIN goal LEFT JOIN hist ON hist.i = binned.bin""",
)
def histos(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "iap_revenue_d7")
    bins = sampling.fit_bins(df, "iap_revenue_d7", 30, numpy_compat=True)
    out = sampling.oversample_bins(df, bins, 75.0)
    return out.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "histos_width",
    f"""WITH {EVENTS}, y AS (SELECT row_id, ln(1 + value) AS y FROM ev),
    lim AS (SELECT min(y) AS lo, (max(y) - min(y)) / 12 AS w FROM y),
    binned AS (SELECT row_id, least(12, 1 + floor((y - lo) / w)) AS bin FROM y, lim),
    hist AS (SELECT i, (SELECT count(*) FROM binned WHERE bin = i) AS n FROM range(1, 13) x(i)),
    goal AS (SELECT quantile_cont(n, 0.75) AS g FROM hist)
    SELECT row_id, CAST(greatest(1, floor(g / hist.n)) AS BIGINT) AS copies
    FROM binned CROSS JOIN goal JOIN hist ON hist.i = binned.bin""",
)
def histos_width(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "value")
    bins = sampling.fit_bins(df, "value", 12, binning="width", log=True)
    out = sampling.oversample_bins(df, bins, 75.0)
    return out.groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"))


def _histus_sql(base: str, t: str, y: str, ident: str, last_closed: bool, percentile: float) -> str:
    cap = OPEN.format(y=y)
    cap = f"least({cap}, ne - 1)" if last_closed else cap
    return f"""WITH {BINS_SQL.format(base=base, t=t, y=y, grid=GRID30, cap=cap)},
    goal AS (SELECT quantile_cont(n, {percentile}) AS g FROM hist),
    ranked AS (SELECT {ident}, bin, row_number() OVER (PARTITION BY bin ORDER BY {md5_key(ident)}, {ident}) AS rn FROM binned)
    SELECT {ident}, bin::INTEGER AS bin FROM ranked JOIN hist ON hist.i = bin CROSS JOIN goal
    WHERE hist.n <= g OR rn <= greatest(1, floor(g))"""


@query("histus", _histus_sql(EVENTS, "ev", "value", "row_id", True, 0.25))
def histus(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "value")
    bins = sampling.fit_bins(df, "value", 30)
    out = sampling.undersample_bins(df, bins, 25.0, portable=True)
    return out.select("row_id", bins.bin_of().cast("int").alias("bin"))


@query("histus_open_bin", _histus_sql(EVENTS, "ev", "value", "row_id", False, 0.02))
def histus_open_bin(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "value")
    bins = sampling.fit_bins(df, "value", 30, numpy_compat=True)
    out = sampling.undersample_bins(df, bins, 2.0, portable=True)
    return out.select("row_id", bins.bin_of().cast("int").alias("bin"))


STEP = "floor(o_totalprice * o_totalprice / 1e10)"
ORDERS_BASE = f"o AS (SELECT o_orderkey, {STEP} AS price_step FROM orders)"


@query("histus_orders", _histus_sql(ORDERS_BASE, "o", "price_step", "o_orderkey", True, 0.10))
def histus_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(STEP).cast("double").alias("price_step"))
    bins = sampling.fit_bins(df, "price_step", 30)
    out = sampling.undersample_bins(df, bins, 10.0, ident="o_orderkey", portable=True)
    return out.select("o_orderkey", bins.bin_of().cast("int").alias("bin"))


@query(
    "zero_anchors",
    f"""WITH {IMPRESSIONS}, z AS (
      SELECT *, CAST(iap_revenue_d14 = 0 AND k % 3 = 0 AS INTEGER) AS zero FROM imp),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY zero DESC, {md5_key()}, row_id) AS rn FROM z),
    firsts AS (SELECT * FROM ranked WHERE rn <= 4),
    hours AS (SELECT datetime, max(zero) AS any_zero, CASE WHEN max(zero) = 1 THEN sum(zero) ELSE count(*) END AS usable
      FROM firsts GROUP BY datetime),
    added AS (SELECT f.*, s.slot, h.any_zero FROM firsts f JOIN hours h USING (datetime), range(1, 5) s(slot)
      WHERE (h.any_zero = 0 OR f.zero = 1) AND (s.slot - 1) % h.usable = f.rn - 1)
    SELECT CAST(row_id AS VARCHAR) AS row_id, datetime, carrier, value,
      CASE WHEN iap_revenue_d14 = 0 AND k % 3 = 0 THEN 0 ELSE iap_revenue_d14 + 1 END AS iap_revenue_d7, buyer_d7 FROM imp
    UNION ALL SELECT CAST(row_id AS VARCHAR) || '_za' || CAST(slot AS VARCHAR), datetime, carrier,
      CASE WHEN any_zero = 1 THEN value ELSE 0 END, 0, CASE WHEN any_zero = 1 THEN buyer_d7 ELSE 0 END FROM added""",
)
def zero_anchors(spark, sf_dir):
    scarce = (F.col("iap_revenue_d14") == 0) & (F.col("k") % 3 == 0)
    df = impressions(spark, sf_dir).select(
        "row_id", "datetime", "carrier", "value",
        F.when(scarce, F.lit(0.0)).otherwise(F.col("iap_revenue_d14") + 1.0).alias("iap_revenue_d7"), "buyer_d7",
    )
    return sampling.zero_anchors(df, 4, portable=True)


@query(
    "whale_oversample",
    f"""WITH {IMPRESSIONS}, t AS (SELECT quantile_cont(iap_revenue_d7, 0.8) AS t FROM imp WHERE buyer_d7 = 1)
    SELECT row_id, CAST(iap_revenue_d7 >= t AS INTEGER) AS is_whale, c.c::INTEGER AS copy_no FROM imp, t, range(1, 5) c(c)
    WHERE buyer_d7 = 1 AND (c.c = 1 OR iap_revenue_d7 >= t)""",
)
def whale_oversample(spark, sf_dir):
    from cohortal.operators.features import whale_threshold

    base = splits.buyers(impressions(spark, sf_dir)).select("row_id", "iap_revenue_d7")
    cut = whale_threshold(base, "iap_revenue_d7")
    return sampling.oversample_whales(base, cut).select("row_id", "is_whale", "copy_no")


NUMERIC = (
    "user_id", "hour", "weekday", "value", "k", "wifi_ratio", "avg_act_days", "weeks_since_first_seen",
    "weekend_ratio", "release_msrp",
)


@query(
    "numeric_features",
    f"WITH {IMPRESSIONS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg({c})', 'mean')} FROM imp" for c in NUMERIC),
)
def numeric_features(spark, sf_dir):
    df = impressions(spark, sf_dir).withColumns(
        {"country_local_spend_rank": F.lit(0.5), "retention_d1_to_d7": F.lit(1.0), "buy_d7": F.lit(1)}
    )
    names = splits.numeric_features(df)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    return rounded(means.unpivot([], names, "feature", "mean"))


@query(
    "class_ratio",
    f"""WITH {IMPRESSIONS} SELECT count(*) FILTER (WHERE buyer_d7 = 1) AS n_positive,
      count(*) FILTER (WHERE buyer_d7 = 0) AS n_negative,
      {r("count(*) FILTER (WHERE buyer_d7 = 0) / count(*) FILTER (WHERE buyer_d7 = 1)", "scale_pos_weight")} FROM imp""",
)
def class_ratio(spark, sf_dir):
    return rounded(sampling.class_ratio(impressions(spark, sf_dir)))


@query(
    "high_value_label",
    f"""WITH {IMPRESSIONS}, t AS (SELECT greatest(quantile_cont(iap_revenue_d7, 0.995), 75) AS t FROM imp)
    SELECT row_id, CAST(iap_revenue_d7 >= t AS INTEGER) AS high_value FROM imp, t""",
)
def high_value_label(spark, sf_dir):
    df = impressions(spark, sf_dir)
    cut = sampling.high_value_threshold(df, min_revenue=75.0)
    return sampling.add_high_value_label(df, cut).select("row_id", "high_value")


@query("drop_nested", "SELECT user_id, count(DISTINCT event_type) AS n_types FROM events GROUP BY user_id")
def drop_nested(spark, sf_dir):
    sized = profiles(spark, sf_dir).withColumn("n_types", F.size("num_buys_category").cast("bigint"))
    return splits.drop_nested(sized)


@query(
    "student_columns",
    f"""WITH {IMPRESSIONS} SELECT row_id, hour, weekday, avg_act_days, weekend_ratio, wifi_ratio,
      weeks_since_first_seen, release_msrp, country, dev_os, advertiser_category FROM imp""",
)
def student_columns(spark, sf_dir):
    df = impressions(spark, sf_dir)
    return df.select("row_id", *splits.student_columns(df))
