"""Impression and user-history tables derived from the event log.

Labels come from a (user, day) aggregate, so windows run over at most one row
per user and day. Histories come from a (user, event type, weekday) aggregate, so a
map or list has one entry per type or per type and weekday, not per event.
Both are written once per session and folder and scanned afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortal.core.lookup import lookup
from cohortal.core.settle import settle

PAID_FROM = 150.0
_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = settle(make(), name)
    return _BUILT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        "ts",
        F.to_date("ts").alias("day"),
        F.date_format("ts", "yyyy-MM-dd-HH-'00'").alias("datetime"),
        "user_id",
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        F.col("event_type").alias("advertiser_category"),
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("advertiser_category")
    paid = F.when((kind == "purchase") & (F.col("value") >= PAID_FROM), F.col("value")).otherwise(0.0)
    daily = (
        _events(spark, sf_dir)
        .groupBy("user_id", "day")
        .agg(
            F.sum(paid).alias("paid"),
            F.max(F.when(kind == "purchase", F.col("ts"))).alias("buy_ts"),
            F.max(F.when(kind == "signup", F.col("ts"))).alias("ins_ts"),
        )
        .withColumn("_n", F.unix_date("day"))
    )
    days = Window.partitionBy("user_id").orderBy("_n")
    ahead = lambda n: F.round(F.coalesce(F.sum("paid").over(days.rangeBetween(1, n)), F.lit(0.0)), 2)
    past = days.rangeBetween(Window.unboundedPreceding, -1)
    return daily.select(
        "user_id",
        "day",
        *[ahead(n).alias(f"iap_revenue_d{n}") for n in (1, 7, 14)],
        F.max("buy_ts").over(past).alias("last_buy"),
        F.max("ins_ts").over(past).alias("last_ins"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per event with device, network, time and recency columns."""

    def make() -> DataFrame:
        days = settle(_user_days(spark, sf_dir), "user-days")
        nations = table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").cast("bigint").alias("_nation"), F.col("n_name").alias("country")
        )
        k = F.col("k")
        rows = lookup(_events(spark, sf_dir), days, ["user_id", "day"], spread="row_id")
        rows = rows.withColumn("_nation", F.pmod("user_id", F.lit(25)))
        rows = lookup(rows, nations, "_nation", spread="row_id")
        absent_if = lambda when, value: F.when(~when, value)
        return rows.select(
            "row_id", "datetime", "ts", "user_id", "hour", "weekday", "advertiser_category", "country", "value", "k",
            F.when(k % 50 == 0, "None").when(k % 3 == 0, "ios").otherwise("android").alias("dev_os"),
            F.when(k % 10 == 0, "unknown")
            .otherwise(F.concat((k % 12).cast("string"), F.lit("."), (k % 5).cast("string")))
            .alias("dev_osv"),
            absent_if(k % 9 == 0, F.concat(F.lit("carrier"), (k % 5).cast("string"))).alias("carrier"),
            absent_if(F.col("row_id") % 10 == 0, (F.col("row_id") % 10) / 10.0).alias("wifi_ratio"),
            ((k % 7) + 0.5).alias("avg_act_days"),
            absent_if(k % 6 == 0, (k % 20).cast("double")).alias("weeks_since_first_seen"),
            ((k % 8) / 8.0).alias("weekend_ratio"),
            (F.lit(100.0) + k * 7).alias("release_msrp"),
            "last_buy", "last_ins",
            *[F.col(f"iap_revenue_d{n}") for n in (1, 7, 14)],
            *[(F.col(f"iap_revenue_d{n}") > 0).cast("int").alias(f"buyer_d{n}") for n in (1, 7, 14)],
        )

    return _once(spark, sf_dir, "impressions", make)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user with map, list, session and histogram columns."""

    def make() -> DataFrame:
        # One row per user, event type and weekday; types are whatever the log holds.
        cells = _events(spark, sf_dir).groupBy("user_id", F.col("advertiser_category").alias("t"), F.col("weekday").alias("d")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("value").alias("s"),
            *[F.count_if(F.col("hour") == h).alias(f"h_{h}") for h in range(24)],
            *[F.count_if(F.col("k") % 4 == m).alias(f"v_{m}") for m in range(4)],
        )
        types = cells.groupBy("user_id", "t").agg(
            F.sum("n").cast("double").alias("n"), F.round(F.sum("s"), 2).alias("s"), F.array_sort(F.collect_list("d")).alias("days"),
            *[F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(f"d_{d}") for d in range(7)],
            *[F.sum(f"h_{h}").alias(f"h_{h}") for h in range(24)],
            *[F.sum(f"v_{m}").alias(f"v_{m}") for m in range(4)],
        )
        summed = [*[f"d_{d}" for d in range(7)], *[f"h_{h}" for h in range(24)], *[f"v_{m}" for m in range(4)]]
        agg = types.groupBy("user_id").agg(
            F.array_sort(F.collect_list(F.struct("t", "n", "s", "days"))).alias("types"), *[F.sum(c).cast("double").alias(c) for c in summed]
        )
        positive = lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & (v > 0))
        as_map = lambda pairs: positive(F.create_map(*[x for name, c in pairs for x in (F.lit(name), c)]))
        per_type = lambda make: F.transform("types", lambda x: F.struct(x["t"].alias("key"), make(x).alias("value")))
        filled = lambda pairs: F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] > 0))
        type_map = lambda make: F.map_from_entries(filled(per_type(make)))
        listed = lambda from_day: F.flatten(
            F.transform("types", lambda x: F.transform(F.filter(x["days"], lambda d: d >= from_day), lambda _: x["t"]))
        )
        days = F.array(*[F.struct(F.lit(f"d{d}").alias("key"), (F.col(f"d_{d}") / 4.0).alias("value")) for d in range(7)])
        return agg.select(
            "user_id",
            type_map(lambda x: x["s"]).alias("iap_revenue_usd_category"),
            type_map(lambda x: x["n"]).alias("num_buys_category"),
            as_map([(f"{h:02d}", F.col(f"h_{h}")) for h in range(24)]).alias("hour_ratio"),
            listed(0).alias("user_bundles"),
            listed(5).alias("new_bundles"),
            filled(days).alias("avg_daily_sessions"),
            filled(per_type(lambda x: x["s"] / x["n"])).alias("avg_duration"),
            as_map([(f"d{d}", F.col(f"d_{d}")) for d in range(7)]).alias("region_hist"),
            as_map([(f"v{m}", F.col(f"v_{m}")) for m in range(4)]).alias("dev_osv_hist"),
        )

    return _once(spark, sf_dir, "profiles", make)


def wide_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with the user's nested history on each row: the raw model input."""
    rows = impressions(spark, sf_dir).drop("ts", "k")
    return lookup(rows, profiles(spark, sf_dir), "user_id", spread="row_id").drop("user_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with stand-in stage outputs: probabilities and per-horizon predictions."""
    v, k = F.col("value"), F.col("k")
    return impressions(spark, sf_dir).select(
        "row_id", "datetime", "user_id", "country", "advertiser_category", "hour", "value",
        *[f"{stem}_d{n}" for stem in ("iap_revenue", "buyer") for n in (1, 7, 14)],
        F.round(F.least(v / 250.0, F.lit(1.0)), 4).alias("buyer_proba"),
        F.round((k + 1) / 101.0, 4).alias("whale_proba"),
        (v * 0.3).alias("pred_d1"),
        (v * (k % 5) / 4.0).alias("pred_d7"),
        (v * 0.8).alias("pred_d14"),
    )
