import pytest
from pyspark.sql import functions as F

from cohortal.sources import files, hourly
from cohortal.sources.views import impressions


@pytest.fixture(scope="module")
def hourly_path(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hourly") / "train")
    rows = impressions(spark, sf_dir).where("datetime < '2024-01-02-12-00'").select("row_id", "datetime", "value", "buyer_d7")
    rows.repartition("datetime").write.partitionBy("datetime").parquet(path)
    return path


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_windows_prune_partitions(spark, hourly_path):
    df = hourly.read_hourly(spark, hourly_path)
    assert dict(df.dtypes)["datetime"] == "string"
    part = hourly.scan_window(df, "2024-01-01-03-00", "2024-01-01-05-00")
    assert "PartitionFilters: [isnotnull(datetime" in plan_of(part)
    assert part.agg(F.min("datetime"), F.max("datetime")).first()[1] <= "2024-01-01-05-00"
    files_read = part.select(F.col("_metadata.file_path")).distinct().count()
    assert files_read <= 3


def test_window_is_inclusive_and_open(spark, hourly_path):
    df = hourly.read_hourly(spark, hourly_path)
    hours = [r[0] for r in df.select("datetime").distinct().orderBy("datetime").collect()]
    assert hourly.scan_window(df, hours[1], hours[2]).select("datetime").distinct().count() == 2
    assert hourly.scan_window(df).count() == df.count()


def test_cap_and_load(spark, hourly_path):
    df = hourly.read_hourly(spark, hourly_path)
    capped = hourly.cap_partitions(df, 4)
    assert capped.select("datetime").distinct().count() == 4
    train, val = hourly.load_split(df, (None, "2024-01-01-11-00"), ("2024-01-01-12-00", None), max_partitions=2)
    assert train.select("datetime").distinct().count() == val.select("datetime").distinct().count() == 2
    assert hourly.load_combined(df, "2030", "2031").count() == df.count()


def test_datetime_comes_from_the_path(spark, hourly_path):
    df = hourly.with_path_datetime(spark.read.parquet(hourly_path))
    wrong = df.where(F.date_format("path_datetime", "yyyy-MM-dd-HH-mm") != F.col("datetime").cast("string"))
    assert wrong.count() == 0 and df.where("path_datetime IS NULL").count() == 0


def test_readable_files_skip_broken_and_unlabelled(spark, tmp_path):
    good, bare = tmp_path / "datetime=a", tmp_path / "datetime=b"
    spark.range(5).withColumn("buyer_d7", F.lit(1)).coalesce(1).write.parquet(str(good))
    spark.range(5).coalesce(1).write.parquet(str(bare))
    (tmp_path / "datetime=a" / "part-broken.parquet").write_bytes(b"no parquet")
    found = hourly.readable_files(spark, str(tmp_path), "buyer_d7").collect()
    assert len(found) == 1 and found[0]["labelled"] == 5


def test_report_names_every_file(spark, tmp_path):
    spark.range(5).withColumn("y", F.lit(1.5)).coalesce(1).write.parquet(str(tmp_path / "good"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "bare"))
    spark.range(3).withColumn("y", F.lit(None).cast("double")).coalesce(1).write.parquet(str(tmp_path / "nulls"))
    whole = next((tmp_path / "good").glob("*.parquet")).read_bytes()
    (tmp_path / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "no.parquet").write_bytes(b"no parquet")
    found = {r.file_path.split("/")[-2] + "/" + r.file_path.split("/")[-1][:3]: (r.status, r.rows, r.labelled) for r in hourly.file_report(spark, str(tmp_path), "y", "double").collect()}
    assert sorted(found.values()) == [("no values", 3, 0), ("no values", 7, 0), ("read", 5, 5), ("skipped", 0, 0), ("skipped", 0, 0)]


def test_hours_are_replaced_one_by_one(spark, tmp_path):
    """Writing some hours again leaves the others; a large hour may take several files, a small one takes one."""
    path = str(tmp_path / "h")
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "2024-01-01-00-00").otherwise("2024-01-01-01-00").alias("datetime"), F.lit(1).alias("v"))
    hourly.write_hourly(df, path)
    hourly.write_hourly(df.where("id >= 900 AND id < 950").withColumn("v", F.lit(2)), path)
    back = hourly.read_hourly(spark, path, "id bigint, v int, datetime string")
    assert {(r.datetime, r.v): r["count"] for r in back.groupBy("datetime", "v").count().collect()} == {("2024-01-01-00-00", 1): 900, ("2024-01-01-01-00", 2): 50}
    small = hourly.scan_window(back, "2024-01-01-01-00")
    assert small.select(F.col("_metadata.file_path")).distinct().count() == 1
    assert "PartitionFilters: [isnotnull(datetime" in plan_of(small)


def test_random_file_pick_is_seeded(spark, hourly_path):
    df = spark.read.parquet(hourly_path).withColumn("file", F.col("_metadata.file_path"))
    one = hourly.pick_groups(df, "file", 5, seed=1)
    assert one.select("file").distinct().count() == 5
    two = hourly.pick_groups(df.repartition(3), "file", 5, seed=1)
    assert one.exceptAll(two).count() == 0


def test_samples_and_limits(spark, hourly_path):
    df = hourly.read_hourly(spark, hourly_path)
    head = [r["row_id"] for r in hourly.head_sample(df, 7).collect()]
    assert head == [r["row_id"] for r in df.orderBy("datetime", "row_id").limit(7).collect()]
    assert hourly.limit_rows(df, None).count() == df.count() and hourly.limit_rows(df, 3).count() == 3


def test_prediction_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 1e-12)], "row_id long, p double")
    files.write_predictions(df, str(tmp_path / "p"), "p")
    assert sorted(files.read_predictions(spark, str(tmp_path / "p")).collect()) == [("1", 0.5), ("2", 1e-12)]
    files.write_predictions(df.where("row_id < 0"), str(tmp_path / "e"), "p")
    with pytest.raises(ValueError):
        files.read_predictions(spark, str(tmp_path / "e"))


def test_params_round_trip(spark, tmp_path):
    files.write_params(spark, {"a": 1.5, "b": ["x"]}, str(tmp_path / "params"))
    assert files.read_params(spark, str(tmp_path / "params")) == {"a": 1.5, "b": ["x"]}
    assert files.read_params(spark, str(tmp_path / "none"), {"a": 1}) == {"a": 1}
