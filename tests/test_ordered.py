"""Sliced ordered operators against plain windows, with one series holding most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.functions.timefx import epoch_micros, time_chunk
from plantspark.plans.ordered import first_per_key, fit_slice_seconds, prefix, segments, windowed
from plantspark.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(7)
    out, t0 = [], datetime(2024, 1, 1)
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}"
        t = t0 + timedelta(seconds=rnd.choice([0, 1, 30, 3600]) * rnd.randrange(100), microseconds=rnd.randrange(3))
        v = None if rnd.random() < 0.05 else float(rnd.choice([0, 0, 0, 1, 2, rnd.random() * 9]))
        out.append((key, t, i, v))
    return spark.createDataFrame(out, "k string, ts timestamp_ntz, n long, v double").cache()


@pytest.mark.parametrize("seconds", [1, 60, 86_400])
def test_windowed_equals_plain_window(series, rows, seconds):
    exprs = {
        "lag2": lambda w: F.lag("v", 2).over(w),
        "mx": lambda w: F.max("v").over(w.rowsBetween(-4, 0)),
        "c": lambda w: F.count("v").over(w.rowsBetween(-5, -1)),
    }
    got = windowed(series, ["k"], ["ts", "n"], 5, exprs, time_chunk("ts", seconds))
    want = windowed(series, ["k"], ["ts", "n"], 5, exprs, None)
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("seconds", [1, 60, 86_400])
@pytest.mark.parametrize("include", [True, False])
def test_prefix_equals_running_window(series, rows, seconds, include):
    spec = {"s": ("n", "sum"), "lo": ("v", "min"), "hi": ("v", "max"), "last": ("v", "last")}
    got = prefix(series, ["k"], ["ts", "n"], spec, time_chunk("ts", seconds), include)
    w = Window.partitionBy("k").orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    want = series.select(
        "k", "ts", "n", "v",
        F.sum("n").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"),
        F.last("v", True).over(w).alias("last"),
    )
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("seconds", [1, 60, 86_400])
def test_segments_equal_islands(series, rows, seconds):
    s = series.withColumn("state", F.when(F.col("v") > 0, "ON").when(F.col("v") == 0, "OFF"))
    got = segments(s, ["k"], ["ts", "n"], "state", time_chunk("ts", seconds))
    w = Window.partitionBy("k").orderBy("ts", "n")
    first = F.row_number().over(w) == 1
    chg = F.when(first, 1).when(F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1)
    want = (
        s.withColumn("c", chg)
        .withColumn("i", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("k", "i")
        .agg(F.first("state").alias("state"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
        .drop("i")
    )
    assert rows(got) == rows(want)
    assert got.agg(F.sum("n_rows")).first()[0] == 3000


@pytest.mark.parametrize("resolution", [1, 10_000])
def test_exact_quantiles(series, resolution):
    probs = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "p0": 0.0, "p100": 1.0}
    got = exact_quantiles(series, ["k"], "v", probs, resolution)
    want = series.groupBy("k").agg(F.percentile("v", list(probs.values())).alias("p"))
    for r in got.join(want, "k").collect():
        assert [r[n] for n in probs] == pytest.approx(list(r["p"]), abs=1e-12)
    assert got.count() == want.count()


def test_quantiles_of_mostly_equal_values(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"m": 0.5, "h": 0.95}).first()
    assert got["m"] == 7.0
    assert got["h"] == pytest.approx(4749.05)


def test_quantiles_of_signed_and_extreme_values(spark):
    vals = [-1e300, -5.5, -5.4, -1e-300, 0.0, 0.0, 1e-310, 0.1, 0.1000001, 7.0, 1e308, float("inf"), float("nan"), None]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, v double")
    real = [v for v in vals if v is not None and v == v]
    probs = {f"q{i}": i / (len(real) - 1) for i in range(len(real))}
    got = exact_quantiles(df, ["k"], "v", probs).first()
    assert [got[n] for n in probs] == pytest.approx(sorted(real), rel=1e-9)


def test_first_per_key_is_idempotent(series, rows):
    once = first_per_key(series, ["k", "ts"], ["n"])
    assert rows(first_per_key(once, ["k", "ts"], ["n"])) == rows(once)
    assert once.count() == series.select("k", "ts").distinct().count()


def test_ties_and_copies_lose_no_row(spark, rows):
    """Many rows share their order columns, some are full copies."""
    t0 = datetime(2024, 1, 1)
    data = [("hot", t0 + timedelta(seconds=60 * (i % 7)), i % 3, float(i % 5)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, n long, v double").repartition(8)
    exprs = {"first": lambda w: F.min("ts").over(w.rowsBetween(-3, 0)), "c": lambda w: F.count("v").over(w.rowsBetween(-3, 0))}
    want = rows(windowed(df, ["k"], ["ts"], 3, exprs, None), "ts", "first", "c")
    for seconds in (1, 60, 3600):
        got = windowed(df, ["k"], ["ts"], 3, exprs, time_chunk("ts", seconds))
        assert rows(got, "ts", "first", "c") == want
        assert rows(got, *df.columns) == rows(df)
    s = df.withColumn("state", F.when(F.col("v") > 2, "ON").otherwise("OFF"))
    for seconds in (1, 60, 3600):
        assert segments(s, ["k"], ["ts"], "state", time_chunk("ts", seconds)).agg(F.sum("n_rows")).first()[0] == 900


def test_fit_slice_seconds(series):
    assert fit_slice_seconds(series, ["k"], "ts", 10**6) == 86_400 * 30
    assert fit_slice_seconds(series, ["k"], "ts", 5) == 60
    dense = series.where("k = 'hot'").groupBy(F.window("ts", "1 day")).count().agg(F.max("count")).first()[0]
    assert fit_slice_seconds(series.where("k = 'hot'"), ["k"], "ts", dense) >= 86_400


def test_epoch_micros(spark):
    r = spark.sql("select timestamp_ntz'2024-02-29 23:59:59.123456' t").select(epoch_micros("t")).first()[0]
    assert r == 1709251199123456
    assert spark.sql("select timestamp_ntz'1969-12-31 23:59:59' t").select(epoch_micros("t")).first()[0] == -1_000_000


def test_no_series_is_sorted_in_one_task(series):
    """The full-size window partitions by the slice as well; only edges use the bare key."""
    df = windowed(series, ["k"], ["ts", "n"], 2, {"x": lambda w: F.lag("v").over(w)}, time_chunk("ts", 60))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Union" in plan
