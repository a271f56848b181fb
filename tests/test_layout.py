"""Bucketed tables without exchanges, and reads of a range that open its files only."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.operators import resample as rs
from plantspark.sources import layout

T0 = datetime(2024, 1, 1)
SCHEMA = "site_id string, sensor string, ts timestamp_ntz, row_no long, value double"


@pytest.fixture(scope="module")
def readings(spark):
    rows = [("s", f"c{i % 7}_KW", T0 + timedelta(minutes=20 * (i // 7)), i, float(i % 50)) for i in range(7 * 72 * 28)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    df.collect()
    return len(re.findall(r"Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_windows_resampling_and_joins_without_an_exchange(spark, readings, tmp_path, rows, no_broadcast):
    path = str(tmp_path / "bucketed")
    spark.sql("DROP TABLE IF EXISTS series_buckets")
    layout.write_bucketed(readings, "series_buckets", path, 5)
    t = spark.table("series_buckets")
    w = Window.partitionBy("site_id", "sensor").orderBy("ts", "row_no")
    lagged = t.withColumn("prev", F.lag("value").over(w))
    assert exchanges(lagged) == 0 and rows(lagged) == rows(readings.withColumn("prev", F.lag("value").over(w)).select(lagged.columns))
    hourly = rs.resample(t, "1 hour")
    assert exchanges(hourly) == 0 and rows(hourly) == rows(rs.resample(readings, "1 hour").select(hourly.columns))
    means = t.groupBy("site_id", "sensor").agg(F.avg("value").alias("mean"))
    assert exchanges(t.join(means, ["site_id", "sensor"])) == 0
    spark.sql("DROP TABLE series_buckets")
    again = layout.open_bucketed(spark, "series_again", path)
    assert rows(again.select(readings.columns)) == rows(readings) and exchanges(rs.resample(again, "1 hour")) == 0
    assert rows(layout.open_bucketed(spark, "series_again", path)) == rows(again)
    spark.sql("DROP TABLE series_again")


def test_a_hot_series_is_dealt_by_day(spark, readings, tmp_path, rows):
    hot = readings.withColumns({"sensor": F.lit("hot_KW"), "day": F.to_date("ts")})
    spark.sql("DROP TABLE IF EXISTS day_buckets")
    layout.write_bucketed(hot, "day_buckets", str(tmp_path / "days"), 8, ["site_id", "sensor", "day"])
    t = spark.table("day_buckets")
    sizes = [r["count"] for r in t.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)
    hourly = rs.resample(t, "1 hour", keys=["site_id", "sensor", "day"])
    assert exchanges(hourly) == 0 and rows(hourly.drop("day")) == rows(rs.resample(hot, "1 hour").select(hourly.drop("day").columns))
    spark.sql("DROP TABLE day_buckets")


def test_a_week_opens_its_files_only(spark, readings, tmp_path, rows):
    path = str(tmp_path / "ranged")
    extra = spark.createDataFrame([("s", "c1_KW", None, -1, 1.0)], SCHEMA)
    layout.write_ranged(readings.unionByName(extra), path, files=12)
    listed = spark.read.parquet(f"{path}/files")
    assert listed.agg(F.sum("rows"), F.sum("no_time")).first()[0:] == (readings.count() + 1, 1)
    first, last = T0 + timedelta(days=7), T0 + timedelta(days=14) - timedelta(microseconds=1)
    week = layout.read_between(spark, path, first, last)
    names = layout.files_between(spark, path, first, last)
    assert 0 < len(names) <= 5 < listed.count() and {f.rsplit("/", 1)[1] for f in week.inputFiles()} == set(names)
    assert rows(week) == rows(readings.where(F.col("ts").between(F.lit(first), F.lit(last))))
    one = layout.read_between(spark, path, first, last, sensor="c3_KW")
    assert rows(one) == rows(week.where("sensor = 'c3_KW'")) and one.count() == 72 * 7
    assert layout.read_between(spark, path, T0 - timedelta(days=9), T0 - timedelta(days=8)).count() == 0
    assert layout.read_between(spark, path, first, last, sensor="zzz").count() == 0
