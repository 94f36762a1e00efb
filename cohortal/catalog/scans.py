"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortal.catalog.registry import query, rounded
from cohortal.catalog.views_sql import EVENTS, IMPRESSIONS, md5_key
from cohortal.core.settle import scratch_dir
from cohortal.sources import files, hourly
from cohortal.sources.views import impressions
from cohortal.streaming.scoring import score_chunks

TRAIN = ("2024-01-03-00-00", "2024-01-12-23-00")
VAL = ("2024-01-13-00-00", "2024-01-15-23-00")


@query(
    "window_scan",
    f"""WITH {IMPRESSIONS} SELECT row_id, datetime, country, value FROM imp
    WHERE datetime BETWEEN '{TRAIN[0]}' AND '{TRAIN[1]}'""",
)
def window_scan(spark, sf_dir):
    return hourly.scan_window(impressions(spark, sf_dir), *TRAIN).select("row_id", "datetime", "country", "value")


@query(
    "partition_cap",
    f"""WITH {EVENTS}, firsts AS (SELECT DISTINCT datetime FROM ev ORDER BY datetime LIMIT 48)
    SELECT datetime, count(*) AS n, round(sum(value), 4) AS value FROM ev
    WHERE datetime IN (SELECT datetime FROM firsts) GROUP BY datetime""",
)
def partition_cap(spark, sf_dir):
    capped = hourly.cap_partitions(impressions(spark, sf_dir), 48)
    return capped.groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(
    "temporal_load",
    f"""WITH {IMPRESSIONS}, parts AS (
      SELECT 'train' AS split, * FROM imp WHERE datetime BETWEEN '{TRAIN[0]}' AND '{TRAIN[1]}'
      UNION ALL SELECT 'val', * FROM imp WHERE datetime BETWEEN '{VAL[0]}' AND '{VAL[1]}')
    SELECT split, count(*) AS n, count(DISTINCT datetime) AS hours, sum(buyer_d7)::BIGINT AS buyers,
      round(sum(iap_revenue_d7), 4) AS revenue FROM parts GROUP BY split""",
)
def temporal_load(spark, sf_dir):
    train, val = hourly.load_split(impressions(spark, sf_dir), TRAIN, VAL)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("datetime").alias("hours"),
        F.sum("buyer_d7").alias("buyers"),
        F.round(F.sum("iap_revenue_d7"), 4).alias("revenue"),
    )


@query(
    "combined_load",
    f"""WITH {IMPRESSIONS} SELECT 'window' AS which, count(*) AS n FROM imp
      WHERE datetime BETWEEN '{TRAIN[0]}' AND '{VAL[1]}'
    UNION ALL SELECT 'empty_window', count(*) FROM imp""",
)
def combined_load(spark, sf_dir):
    df = impressions(spark, sf_dir)
    count = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("which"), "n")
    window = hourly.load_combined(df, TRAIN[0], VAL[1])
    fallback = hourly.load_combined(df, "2031-01-01-00-00", "2031-01-02-00-00")
    return count("window", window).unionByName(count("empty_window", fallback))


@query(
    "test_scan",
    f"""WITH {EVENTS} SELECT row_id, datetime, hour, weekday, value FROM ev WHERE datetime >= '{VAL[0]}'""",
)
def test_scan(spark, sf_dir):
    later = hourly.scan_window(impressions(spark, sf_dir), VAL[0], None)
    return later.select("row_id", "datetime", "hour", "weekday", "value")


@query(
    "head_sample",
    f"WITH {EVENTS} SELECT row_id, datetime, value FROM ev ORDER BY datetime, row_id LIMIT 500",
)
def head_sample(spark, sf_dir):
    return hourly.head_sample(impressions(spark, sf_dir).select("row_id", "datetime", "value"), 500)


@query(
    "path_datetime",
    f"""WITH {EVENTS} SELECT row_id, CASE WHEN k % 10 <> 0 THEN substr(datetime, 1, 10) || ' '
      || substr(datetime, 12, 2) || ':' || substr(datetime, 15, 2) || ':00' END AS path_datetime FROM ev""",
)
def path_datetime(spark, sf_dir):
    folder = F.when(F.col("k") % 10 != 0, F.concat(F.lit("datetime="), "datetime")).otherwise("undated")
    path = F.concat(F.lit("/data/train/"), folder, F.lit("/part-0.parquet"))
    stamp = F.date_format(hourly.datetime_from_path(path), "yyyy-MM-dd HH:mm:ss")
    return impressions(spark, sf_dir).select("row_id", stamp.alias("path_datetime"))


@query(
    "readable_files",
    """SELECT 'events.parquet' AS file_name, count(*) AS rows, count(value) AS labelled FROM events""",
)
def readable_files(spark, sf_dir):
    return hourly.readable_files(spark, f"{sf_dir}/events.parquet", "value")


@query(
    "random_partition_pick",
    f"""WITH {EVENTS}, drawn AS (
      SELECT datetime FROM (SELECT DISTINCT datetime FROM ev) ORDER BY {md5_key('datetime')}, datetime LIMIT 15)
    SELECT row_id, datetime, value FROM ev WHERE datetime IN (SELECT datetime FROM drawn)""",
)
def random_partition_pick(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "datetime", "value")
    return hourly.pick_groups(df, "datetime", 15, portable=True)


def _folder(spark, kind: str) -> str:
    return f"{scratch_dir(spark)}/sources/{kind}-{uuid.uuid4().hex}"


RAW = "row_id bigint, user_id bigint, value double, datetime string"


_HOURLY: dict[tuple[str, str], str] = {}


def _hourly_folder(spark, sf_dir) -> str:
    """All events as ``datetime=<hour>`` folders, three of them replaced afterwards; written once per application."""
    made = spark.sparkContext.applicationId, sf_dir
    if made in _HOURLY:
        return _HOURLY[made]
    path = _HOURLY[made] = _folder(spark, "hourly")
    rows = impressions(spark, sf_dir).select("row_id", "user_id", "value", "datetime")
    hourly.write_hourly(rows, path)
    again = hourly.scan_window(rows, "2024-01-05-03-00", "2024-01-05-05-00")
    hourly.write_hourly(again.withColumn("value", F.col("value") + 1000.0), path)
    return path


REPLACED = "CASE WHEN datetime BETWEEN '2024-01-05-03-00' AND '2024-01-05-05-00' THEN value + 1000.0::DOUBLE ELSE value END"


@query(
    "hourly_folders",
    f"""WITH {EVENTS} SELECT datetime, count(*) AS n, round(sum({REPLACED}), 4) AS value FROM ev
    WHERE datetime BETWEEN '{TRAIN[0]}' AND '{TRAIN[1]}' GROUP BY datetime""",
)
def hourly_folders(spark, sf_dir):
    """A window of real hour folders, read by their names only."""
    df = hourly.read_hourly(spark, _hourly_folder(spark, sf_dir), RAW)
    return hourly.scan_window(df, *TRAIN).groupBy("datetime").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(
    "folder_datetime",
    f"""WITH {EVENTS} SELECT row_id, substr(datetime, 1, 10) || ' ' || substr(datetime, 12, 2) || ':' || substr(datetime, 15, 2) || ':00' AS path_datetime FROM ev""",
)
def folder_datetime(spark, sf_dir):
    """The hour of every row from the path of the file it was read from."""
    out = hourly.with_path_datetime(hourly.read_hourly(spark, _hourly_folder(spark, sf_dir), RAW))
    return out.select("row_id", F.date_format("path_datetime", "yyyy-MM-dd HH:mm:ss").alias("path_datetime"))


@query(
    "folder_draw",
    f"""WITH {EVENTS}, drawn AS (
      SELECT f FROM (SELECT DISTINCT 'datetime=' || datetime AS f FROM ev) ORDER BY {md5_key('f')}, f LIMIT 12)
    SELECT row_id, datetime, {REPLACED} AS value FROM ev WHERE 'datetime=' || datetime IN (SELECT f FROM drawn)""",
)
def folder_draw(spark, sf_dir):
    """Whole folders drawn by the path of their files."""
    df = hourly.read_hourly(spark, _hourly_folder(spark, sf_dir), RAW)
    named = df.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"(datetime=[^/]+)/", 1))
    return hourly.pick_groups(named, "folder", 12, portable=True).select("row_id", "datetime", "value")


@query(
    "mixed_files",
    """SELECT 'bare' AS folder, 'no values' AS status, count(*) AS rows, 0::BIGINT AS labelled FROM events
    UNION ALL SELECT 'broken', 'skipped', 0, 0 UNION ALL SELECT 'cut', 'skipped', 0, 0
    UNION ALL SELECT 'good', 'read', count(*), count(value) FROM events""",
)
def mixed_files(spark, sf_dir):
    """A folder with one sound file, one without the column, one cut in half and one that is no table at all."""
    path = _folder(spark, "mixed")
    rows = impressions(spark, sf_dir).select("row_id", "value")
    rows.coalesce(1).write.parquet(f"{path}/good")
    rows.select("row_id").coalesce(1).write.parquet(f"{path}/bare")
    whole = spark.read.format("binaryFile").load(f"{path}/good").select("content", (F.col("length") / 2).cast("int").alias("n"))
    whole.select(F.expr("CAST(substring(content, 1, n) AS STRING)")).write.text(f"{path}/cut")
    rows.select(F.col("row_id").cast("string")).coalesce(1).write.text(f"{path}/broken")
    found = hourly.file_report(spark, path, "value", "double")
    return found.select(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("folder"), "status", "rows", "labelled")


@query("limit_rows", f"WITH {EVENTS} SELECT row_id, value FROM ev ORDER BY row_id LIMIT 1000")
def limit_rows(spark, sf_dir):
    return hourly.limit_rows(impressions(spark, sf_dir).select("row_id", "value"), 1000)


@query(
    "key_purge",
    f"WITH {IMPRESSIONS} SELECT row_id, carrier, value FROM imp WHERE row_id IS NOT NULL AND carrier IS NOT NULL",
)
def key_purge(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "carrier", "value")
    return hourly.drop_missing_keys(df, ("row_id", "carrier"))


@query(
    "feature_parquet",
    f"""WITH {IMPRESSIONS} SELECT row_id, weekday, value, wifi_ratio FROM imp WHERE weekday >= 5""",
)
def feature_parquet(spark, sf_dir):
    path = f"{scratch_dir(spark)}/sinks/features-{uuid.uuid4().hex}"
    kept = impressions(spark, sf_dir).select("row_id", "weekday", "value", "wifi_ratio")
    files.write_features(kept, path, by="weekday")
    return spark.read.parquet(path).where("weekday >= 5").select("row_id", "weekday", "value", "wifi_ratio")


@query(
    "prediction_csv",
    f"WITH {IMPRESSIONS} SELECT CAST(row_id AS VARCHAR) AS row_id, round(value * 0.5::DOUBLE, 6) AS iap_revenue_d7 FROM imp",
)
def prediction_csv(spark, sf_dir):
    path = f"{scratch_dir(spark)}/sinks/predictions-{uuid.uuid4().hex}"
    made = impressions(spark, sf_dir).select("row_id", (F.col("value") * 0.5).alias("p"))
    files.write_predictions(made, path, "p")
    return rounded(files.read_predictions(spark, path))


@query(
    "chunked_scoring",
    f"""WITH {EVENTS} SELECT CAST(row_id AS VARCHAR) AS row_id, round(value * 0.25::DOUBLE, 6) AS iap_revenue_d7 FROM ev""",
)
def chunked_scoring(spark, sf_dir):
    """All rows scored in chunks; the first run breaks off after writing its second chunk, the next one goes on."""
    folder = _folder(spark, "chunks")
    impressions(spark, sf_dir).select("row_id", "value").repartition(6).write.parquet(f"{folder}/in")
    broken = []

    def score(chunk):
        out = chunk.select(F.col("row_id").cast("string").alias("row_id"), (F.col("value") * 0.25).alias("iap_revenue_d7"))
        if len(broken) == 1:
            out.write.mode("overwrite").option("header", "true").csv(f"{folder}/out/batch=1")
            broken.append(1)
            raise RuntimeError("stopped after a write")
        broken.append(0)
        return out

    for _ in range(2):
        run = score_chunks(spark, score, f"{folder}/in", "row_id bigint, value double", f"{folder}/out", f"{folder}/checkpoint", files_per_chunk=2)
        try:
            run.awaitTermination()
        except StreamingQueryException:
            continue
    return rounded(files.read_predictions(spark, f"{folder}/out").select("row_id", "iap_revenue_d7"))
