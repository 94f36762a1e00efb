"""Flattening of nested, string and date columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import query, r, rounded
from cohortal.catalog.views_sql import CELLS, IMPRESSIONS, cell_stats, md5_code
from cohortal.functions import nested, scalars
from cohortal.operators import features
from cohortal.plans.prepare import flatten_nested
from cohortal.sources.views import impressions, profiles, table, wide_impressions

MAPS = ("iap_revenue_usd_category", "num_buys_category", "hour_ratio")
REF = "2024-01-31"


@query(
    "map_aggregates",
    f"""WITH {CELLS} SELECT user_id, {", ".join(cell_stats(c, nested.MAP_AGGREGATES) for c in MAPS)}
    FROM cells GROUP BY user_id""",
)
def map_aggregates(spark, sf_dir):
    return rounded(nested.flatten_maps(profiles(spark, sf_dir).select("user_id", *MAPS), MAPS))


@query(
    "list_counts",
    f"""WITH {CELLS} SELECT user_id, count(*) AS user_bundles_count, count(DISTINCT item) AS user_bundles_unique,
      count(*) FILTER (WHERE weekday >= 5) AS new_bundles_count,
      count(DISTINCT item) FILTER (WHERE weekday >= 5) AS new_bundles_unique
    FROM items GROUP BY user_id""",
)
def list_counts(spark, sf_dir):
    lists = ("user_bundles", "new_bundles")
    return nested.flatten_lists(profiles(spark, sf_dir).select("user_id", *lists), lists)


SESSION_STATS = ("total", "mean", "max", "count")


@query(
    "session_stats",
    f"""WITH {CELLS} SELECT user_id,
      {cell_stats('avg_daily_sessions', SESSION_STATS)}, {cell_stats('avg_duration', SESSION_STATS)}
    FROM cells GROUP BY user_id""",
)
def session_stats(spark, sf_dir):
    cols = ("avg_daily_sessions", "avg_duration")
    return rounded(nested.flatten_sessions(profiles(spark, sf_dir).select("user_id", *cols), cols))


def _hist_sql(c: str) -> str:
    tops = ", ".join(
        f"coalesce(list(v ORDER BY v DESC) FILTER (WHERE col = '{c}')[{i}], 0)::DOUBLE AS {c}_top{i}_freq"
        for i in range(1, 6)
    )
    p = "v / tot"
    return f"{tops}, round(coalesce(sum(-({p}) * ln({p} + 1e-10)) FILTER (WHERE col = '{c}'), 0), 6) + 0 AS {c}_entropy"


@query(
    "hist_topk_entropy",
    f"""WITH {CELLS}, shared AS (SELECT *, sum(v) OVER (PARTITION BY user_id, col) AS tot FROM cells)
    SELECT user_id, {_hist_sql('region_hist')}, {_hist_sql('dev_osv_hist')} FROM shared GROUP BY user_id""",
)
def hist_topk_entropy(spark, sf_dir):
    cols = ("region_hist", "dev_osv_hist")
    return rounded(nested.flatten_histograms(profiles(spark, sf_dir).select("user_id", *cols), cols))


DAYS_AGO = f"coalesce(floor((epoch_us(TIMESTAMP '{REF}') - epoch_us(last_buy)) / 86400000000), 9999)"


@query(
    "recency_days",
    f"""WITH {IMPRESSIONS} SELECT row_id, CAST({DAYS_AGO} AS BIGINT) AS last_buy_days_ago,
      {r(f"exp(-{DAYS_AGO} / 30)", 'last_buy_recency_weight')} FROM imp""",
)
def recency_days(spark, sf_dir):
    days = scalars.days_ago(F.col("last_buy"), F.lit(REF).cast("timestamp_ntz"))
    out = impressions(spark, sf_dir).select("row_id", days.alias("last_buy_days_ago"))
    return rounded(
        out.withColumn("last_buy_recency_weight", scalars.recency_weight(F.col("last_buy_days_ago")))
    )


@query(
    "list_freq_entropy",
    """WITH words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
    freq AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w),
    total AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS tot FROM freq)
    SELECT doc_id, sum(n)::BIGINT AS words_len, round(avg(n), 6) AS words_mean,
      round(sum(-(n / tot) * ln(n / tot + 1e-9)), 6) + 0 AS words_entropy FROM total GROUP BY doc_id""",
)
def list_freq_entropy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return rounded(nested.compress_lists(docs, ["words"]))


FLAT_COLUMNS = (
    "num_buys_category_mean", "num_buys_category_std", "iap_revenue_usd_category_max",
    "avg_daily_sessions_total", "avg_duration_mean", "region_hist_entropy", "last_buy_recency_weight",
)


@query(
    "flatten_all",
    f"""WITH {IMPRESSIONS}, {CELLS[CELLS.index('cells AS'):]},
    shared AS (SELECT *, sum(v) OVER (PARTITION BY user_id, col) AS tot FROM cells),
    per AS (SELECT user_id, {cell_stats('num_buys_category', ('mean', 'std'))},
      {cell_stats('iap_revenue_usd_category', ('max',))}, {cell_stats('avg_daily_sessions', ('total',))},
      {cell_stats('avg_duration', ('mean',))},
      round(coalesce(sum(-(v / tot) * ln(v / tot + 1e-10)) FILTER (WHERE col = 'region_hist'), 0), 6) + 0
        AS region_hist_entropy
      FROM shared GROUP BY user_id),
    bundles AS (SELECT user_id, count(*) AS user_bundles_count FROM items GROUP BY user_id)
    SELECT row_id, user_bundles_count, CAST({DAYS_AGO} AS BIGINT) AS last_buy_days_ago,
      {", ".join(c for c in FLAT_COLUMNS if c != 'last_buy_recency_weight')},
      {r(f"exp(-{DAYS_AGO} / 30)", 'last_buy_recency_weight')}
    FROM imp JOIN per USING (user_id) JOIN bundles USING (user_id)""",
)
def flatten_all(spark, sf_dir):
    flat = flatten_nested(wide_impressions(spark, sf_dir), REF)
    return rounded(flat.select("row_id", "user_bundles_count", "last_buy_days_ago", *FLAT_COLUMNS))


@query(
    "safe_numeric",
    f"""WITH {IMPRESSIONS} SELECT row_id, coalesce(TRY_CAST(dev_osv AS DOUBLE), 0) AS osv_number,
      TRY_CAST(dev_osv AS DOUBLE) AS osv_or_null FROM imp""",
)
def safe_numeric(spark, sf_dir):
    return impressions(spark, sf_dir).select(
        "row_id",
        scalars.to_number("dev_osv").alias("osv_number"),
        scalars.to_number("dev_osv", fill=None).alias("osv_or_null"),
    )


@query(
    "os_major",
    f"""WITH {IMPRESSIONS} SELECT row_id,
      coalesce(TRY_CAST(string_split(dev_osv, '.')[1] AS INTEGER), -1) AS dev_osv_major FROM imp""",
)
def os_major(spark, sf_dir):
    return features.add_os_major(impressions(spark, sf_dir)).select("row_id", "dev_osv_major")


@query(
    "recency_row_clock",
    f"""WITH {IMPRESSIONS}, clocks AS (SELECT row_id, row_id * 60 AS now,
      CASE WHEN k % 9 <> 0 THEN row_id * 60 - (k - 20) * 3600 END AS bought FROM imp)
    SELECT row_id, CASE WHEN bought > now THEN 0 ELSE now - bought END AS recency_last_buy,
      0::BIGINT AS recency_last_install, 0::BIGINT AS recency_first_request FROM clocks""",
)
def recency_row_clock(spark, sf_dir):
    now = F.col("row_id") * 60
    clocks = impressions(spark, sf_dir).select(
        "row_id",
        now.alias("debug_ts"),
        F.when(F.col("k") % 9 != 0, now - (F.col("k") - 20) * 3600).alias("last_buy_ts_bundle"),
    )
    return features.add_clock_recency(clocks).drop("debug_ts", "last_buy_ts_bundle")


FRACTION = "coalesce((epoch_us(ts) - epoch_us({0})) / 86400000000, 999)"


@query(
    "recency_fractional",
    f"""WITH {IMPRESSIONS} SELECT row_id, {r(FRACTION.format('last_buy'), 'recency_buy')},
      {r(FRACTION.format('last_ins'), 'recency_install')} FROM imp""",
)
def recency_fractional(spark, sf_dir):
    pairs = {"recency_buy": "last_buy", "recency_install": "last_ins"}
    out = features.add_day_recency(impressions(spark, sf_dir), F.col("ts"), pairs)
    return rounded(out.select("row_id", *pairs))


@query(
    "hash_encode_md5",
    f"""WITH {IMPRESSIONS} SELECT row_id, datetime,
      {", ".join(f"{md5_code(f"coalesce({c}, '__missing__')")} AS {c}" for c in ('carrier', 'dev_os', 'country'))}
    FROM imp""",
)
def hash_encode(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "datetime", "carrier", "dev_os", "country")
    return features.hash_categories(df, portable=True)


@query(
    "align_categories",
    f"""WITH {IMPRESSIONS}, known AS (
      SELECT DISTINCT coalesce(carrier, '__MISSING__') AS c FROM imp WHERE k < 25 AND k % 5 <> 3)
    SELECT row_id, CASE WHEN coalesce(carrier, '__MISSING__') IN (SELECT c FROM known)
      THEN coalesce(carrier, '__MISSING__') END AS carrier FROM imp""",
)
def align_categories(spark, sf_dir):
    df = impressions(spark, sf_dir)
    fitted = features.fit_categories(df.where("k < 25 AND k % 5 <> 3"), ["carrier"])
    return features.align_categories(df.select("row_id", "carrier"), fitted)
