"""The test views in SQL, for the oracles."""

from __future__ import annotations

EVENTS = r"""ev AS (
  SELECT event_id AS row_id, ts, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d-%H-00') AS datetime,
         user_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
         event_type AS advertiser_category, value,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k
  FROM events)"""

IMPRESSIONS = (
    EVENTS
    + """,
daily AS (
  SELECT user_id, day,
         sum(CASE WHEN advertiser_category = 'purchase' AND value >= 150 THEN value ELSE 0 END) AS paid,
         max(CASE WHEN advertiser_category = 'purchase' THEN ts END) AS buy_ts,
         max(CASE WHEN advertiser_category = 'signup' THEN ts END) AS ins_ts
  FROM ev GROUP BY user_id, day),
days AS (
  SELECT user_id, day,
    round(coalesce(sum(paid) OVER (PARTITION BY user_id ORDER BY day
      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 1 DAY FOLLOWING), 0), 2) AS iap_revenue_d1,
    round(coalesce(sum(paid) OVER (PARTITION BY user_id ORDER BY day
      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 7 DAY FOLLOWING), 0), 2) AS iap_revenue_d7,
    round(coalesce(sum(paid) OVER (PARTITION BY user_id ORDER BY day
      RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 14 DAY FOLLOWING), 0), 2) AS iap_revenue_d14,
    max(buy_ts) OVER (PARTITION BY user_id ORDER BY day
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_buy,
    max(ins_ts) OVER (PARTITION BY user_id ORDER BY day
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ins
  FROM daily),
imp AS (
  SELECT ev.row_id, ev.datetime, ev.ts, ev.user_id, ev.hour, ev.weekday, ev.advertiser_category,
    n.n_name AS country, ev.value, ev.k,
    CASE WHEN k % 50 = 0 THEN 'None' WHEN k % 3 = 0 THEN 'ios' ELSE 'android' END AS dev_os,
    CASE WHEN k % 10 = 0 THEN 'unknown'
         ELSE CAST(k % 12 AS VARCHAR) || '.' || CAST(k % 5 AS VARCHAR) END AS dev_osv,
    CASE WHEN k % 9 <> 0 THEN 'carrier' || CAST(k % 5 AS VARCHAR) END AS carrier,
    CASE WHEN row_id % 10 <> 0 THEN (row_id % 10) / 10 END AS wifi_ratio,
    CAST(k % 7 + 0.5 AS DOUBLE) AS avg_act_days,
    CASE WHEN k % 6 <> 0 THEN CAST(k % 20 AS DOUBLE) END AS weeks_since_first_seen,
    (k % 8) / 8 AS weekend_ratio,
    CAST(100 + k * 7 AS DOUBLE) AS release_msrp,
    d.last_buy, d.last_ins, d.iap_revenue_d1, d.iap_revenue_d7, d.iap_revenue_d14,
    CAST(d.iap_revenue_d1 > 0 AS INTEGER) AS buyer_d1,
    CAST(d.iap_revenue_d7 > 0 AS INTEGER) AS buyer_d7,
    CAST(d.iap_revenue_d14 > 0 AS INTEGER) AS buyer_d14
  FROM ev JOIN days d ON d.user_id = ev.user_id AND d.day = ev.day
          LEFT JOIN nation n ON n.n_nationkey = ev.user_id % 25)"""
)

SCORED = (
    IMPRESSIONS
    + """,
scored AS (
  SELECT row_id, datetime, user_id, country, advertiser_category, hour, value,
    iap_revenue_d1, iap_revenue_d7, iap_revenue_d14, buyer_d1, buyer_d7, buyer_d14,
    round(least(value / 250, 1), 4) AS buyer_proba,
    round((k + 1) / 101, 4) AS whale_proba,
    value * 0.3::DOUBLE AS pred_d1, value * (k % 5) / 4 AS pred_d7, value * 0.8::DOUBLE AS pred_d14
  FROM imp)"""
)

# One row per (user, nested column, entry).
CELLS = (
    EVENTS
    + """,
cells AS (
  SELECT user_id, 'iap_revenue_usd_category' AS col, advertiser_category AS key, round(sum(value), 2) AS v
    FROM ev GROUP BY user_id, advertiser_category
  UNION ALL SELECT user_id, 'num_buys_category', advertiser_category, count(*) FROM ev GROUP BY user_id, advertiser_category
  UNION ALL SELECT user_id, 'hour_ratio', CAST(hour AS VARCHAR), count(*) FROM ev GROUP BY user_id, hour
  UNION ALL SELECT user_id, 'avg_daily_sessions', CAST(weekday AS VARCHAR), count(*) / 4 FROM ev GROUP BY user_id, weekday
  UNION ALL SELECT user_id, 'avg_duration', advertiser_category, round(sum(value), 2) / count(*)
    FROM ev GROUP BY user_id, advertiser_category
  UNION ALL SELECT user_id, 'region_hist', CAST(weekday AS VARCHAR), count(*) FROM ev GROUP BY user_id, weekday
  UNION ALL SELECT user_id, 'dev_osv_hist', CAST(k % 4 AS VARCHAR), count(*) FROM ev GROUP BY user_id, k % 4),
items AS (
  SELECT DISTINCT user_id, advertiser_category AS item, weekday FROM ev)"""
)


def md5_key(column: str = "row_id", seed: int = 42) -> str:
    """60-bit order key of a row identifier."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({column} AS VARCHAR)), 1, 15) AS BIGINT)"


def md5_code(text: str) -> str:
    """64-bit category code."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def cell_stats(column: str, wanted: tuple[str, ...]) -> str:
    """Aggregates of one nested column over ``cells``."""
    fns = {"mean": "avg(v)", "std": "stddev_pop(v)", "max": "max(v)", "min": "min(v)", "total": "sum(v)"}
    parts = []
    for w in wanted:
        if w == "count":
            parts.append(f"count(v) FILTER (WHERE col = '{column}') AS {column}_count")
        else:
            parts.append(
                f"round(coalesce({fns[w]} FILTER (WHERE col = '{column}'), 0), 6) + 0 AS {column}_{w}"
            )
    return ", ".join(parts)
