"""Measured slices and block-wise rolling windows against plain windows, with most rows in one hour of one series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.operators import equipment, features, quality
from plantspark.plans.ordered import prefix, segments, windowed
from plantspark.plans.rolling import numbered, rolling_blocks
from plantspark.plans.slices import fit_slices

LIMIT = 60


@pytest.fixture(scope="module")
def hot(spark):
    """60 % of the rows of one series within an hour, many of them at one moment; null times, keys and values."""
    rnd, t0, out = random.Random(11), datetime(2024, 3, 1), []
    for i in range(2500):
        if i < 1500:
            k, t = "hot", t0 + timedelta(hours=5, microseconds=rnd.choice([0, rnd.randrange(10), rnd.randrange(3_600_000_000)]))
        else:
            k = rnd.choice(["hot", "hot", "a", "b", None])
            t = rnd.choice([None, t0 + timedelta(seconds=rnd.randrange(40 * 86_400))])
        v = None if rnd.random() < 0.1 else float(rnd.choice([0, 0, 1, 2, rnd.random() * 9]))
        out.append((k, t, i, v))
    rnd.shuffle(out)
    return spark.createDataFrame(out, "k string, ts timestamp_ntz, n long, v double").repartition(6).cache()


@pytest.fixture(scope="module")
def cut(hot):
    return fit_slices(hot, ["k"], ["ts", "n"], LIMIT)


def test_no_slice_is_above_the_limit(hot, cut):
    placed = cut.add(hot)
    assert placed.count() == 2500 and placed.columns == [*hot.columns, "_slice"]
    sizes = {(r.k, r._slice): r["count"] for r in placed.groupBy("k", "_slice").count().collect()}
    long = [k for k in sizes if sum(n for (s, _), n in sizes.items() if s == k[0]) > LIMIT]
    assert max(sizes[k] for k in long) <= LIMIT and len(sizes) > 25
    told = {(r.k, r._slice): r._rows for r in cut.table.collect()}
    assert told == {k: n for k, n in sizes.items() if k in told} and set(long) == set(told)


def test_slices_follow_the_order(hot, cut):
    w = Window.partitionBy("k").orderBy("ts", "n")
    steps = cut.add(hot).select((F.col("_slice") - F.lag("_slice").over(w)).alias("d")).groupBy("d").count().collect()
    assert {r.d for r in steps} <= {None, 0, 1}


def test_two_neighbours_hold_half_the_limit(cut):
    rows = {}
    for r in cut.table.collect():
        rows.setdefault(r.k, {})[r._slice] = (r._rows, r._before)
    for sizes in rows.values():
        each = [sizes[i] for i in range(len(sizes))]
        assert [b for _, b in each] == [sum(n for n, _ in each[:i]) for i in range(len(each))]
        assert all(a[0] + b[0] >= cut.reach for a, b in zip(each, each[1:-1], strict=False))


def test_short_series_and_empty_tables_need_no_slices(spark, hot):
    assert fit_slices(hot, ["k"], ["ts", "n"], 5000).is_single
    assert fit_slices(hot.where("k = 'none'"), ["k"], ["ts", "n"], 5).is_single
    named = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, at string")
    assert fit_slices(named, ["k"], ["at"], 1).is_single


def test_rows_that_agree_in_all_numbers_stay_together(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1, str(i)) for i in range(50)] + [("a", t, i, "z") for i in range(2, 30)], "k string, ts timestamp_ntz, n long, s string")
    got = fit_slices(df, ["k"], ["ts", "n", "s"], 10)
    sizes = sorted(r["count"] for r in got.add(df).groupBy("_slice").count().collect())
    assert sizes[-1] in (50, 51, 52, 53, 54, 55) and all(n <= 10 for n in sizes[:-1])


EXPRS = {
    "lag2": lambda w: F.lag("v", 2).over(w),
    "mx": lambda w: F.max("v").over(w.rowsBetween(-4, 0)),
    "c": lambda w: F.count("v").over(w.rowsBetween(-5, -1)),
}


@pytest.mark.parametrize("limit", [4, 60])
def test_windowed(hot, rows, limit):
    got = windowed(hot, ["k"], ["ts", "n"], 5, EXPRS, fit_slices(hot, ["k"], ["ts", "n"], limit))
    want = windowed(hot, ["k"], ["ts", "n"], 5, EXPRS, None)
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("include", [False])
def test_prefix(hot, cut, rows, include):
    spec = {"s": ("n", "sum"), "lo": ("v", "min"), "hi": ("v", "max"), "last": ("v", "last")}
    got = prefix(hot, ["k"], ["ts", "n"], spec, cut, include)
    w = Window.partitionBy("k").orderBy("ts", "n").rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    want = hot.select(
        "k", "ts", "n", "v", F.sum("n").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.last("v", True).over(w).alias("last")
    )
    assert rows(got.select(want.columns)) == rows(want)


def test_segments(hot, cut, rows):
    s = hot.withColumn("state", F.when(F.col("v") > 0, "ON").when(F.col("v") == 0, "OFF"))
    got = segments(s, ["k"], ["ts", "n"], "state", cut)
    want = segments(s, ["k"], ["ts", "n"], "state", F.lit(0))
    assert rows(got) == rows(want) and got.agg(F.sum("n_rows")).first()[0] == 2500


def test_operators_measure_their_slices(spark, hot, rows, monkeypatch):
    from plantspark.plans import ordered

    named = hot.select(F.lit("s").alias("site_id"), F.coalesce("k", F.lit("-")).alias("sensor"), "ts", F.col("n").alias("row_no"), "v").withColumn("value", F.coalesce("v", F.lit(0.5)))
    states = named.withColumn("state", F.when(F.col("value") > 0.7, "ON").otherwise("OFF"))
    devices = states.withColumn("device", F.when(F.col("row_no") % 3 == 0, "pump").otherwise("chiller"))

    def everything():
        return [
            rows(equipment.state_segments(states)),
            rows(equipment.start_events(states)),
            rows(quality.meter_drops(named)),
            rows(quality.long_gaps(named)),
            rows(quality.low_power_factor_spans(named)),
            rows(equipment.startup_sequence(devices, "pump", "chiller")),
        ]

    plain = everything()
    seen = []

    def small(df, keys, order):
        seen.append(fit_slices(df, keys, order, LIMIT))
        return seen[-1]

    monkeypatch.setattr(ordered, "fit_slices", small)
    assert everything() == plain
    assert len(seen) == 7 and not any(s.is_single for s in seen)
    assert max(s.table.agg(F.max("_rows")).first()[0] for s in seen) <= LIMIT


# ------------------------------------------------------------------ rolling windows of any width


def plain_rolling(df, n, need):
    w = Window.partitionBy("k").orderBy("ts", "n").rowsBetween(-n, -1)
    full = F.count("v").over(w) >= need
    cols = {"mean": F.avg("v"), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")}
    return df.withColumns({a: F.when(full, c.over(w)) for a, c in cols.items()})


def compared(got, want):
    def listed(df):
        return sorted(((r.k or "", r.n, *[None if x is None else round(x, 9) for x in (r["mean"], r["std"], r["min"], r["max"])]) for r in df.collect()), key=str)

    a, b = listed(got), listed(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-7), (x, y)


@pytest.mark.parametrize(("n", "block", "need"), [(1, 10, 1), (50, 50, 20), (90, 30, 1), (31, 30, 20), (400, 7, 1)])
def test_rolling_blocks(hot, cut, n, block, need):
    wanted = {n: {a: ("v", a, need) for a in ("mean", "std", "min", "max")}}
    compared(rolling_blocks(hot, ["k"], ["ts", "n"], wanted, cut, block), plain_rolling(hot, n, need))


def test_rolling_without_slices_and_with_time_slices(hot):
    from plantspark.functions.timefx import time_chunk

    wanted = {40: {a: ("v", a, 3) for a in ("mean", "std", "min", "max")}}
    want = plain_rolling(hot, 40, 3)
    compared(rolling_blocks(hot, ["k"], ["ts", "n"], wanted, None), want)
    compared(rolling_blocks(hot, ["k"], ["ts", "n"], wanted, time_chunk("ts", 3600), 16), want)


def test_no_block_is_larger_than_asked(hot, cut):
    """The tasks of a wide window: rows of a slice while numbering, rows of a block while aggregating."""
    placed = numbered(hot, ["k"], ["ts", "n"], ["v"], cut)
    n, low, high = placed.groupBy("k").agg(F.count("*").alias("n"), F.min("_pos").alias("a"), F.max("_pos").alias("b")).where("k = 'hot'").first()[1:]
    assert (low, high) == (0, n - 1) and placed.select("k", "_pos").distinct().count() == 2500
    assert placed.groupBy("k", F.floor(F.col("_pos") / 64)).count().agg(F.max("count")).first()[0] == 64


def test_large_values_keep_their_deviation(spark):
    data = [("a", datetime(2024, 1, 1) + timedelta(seconds=i), i, 1e9 + (i % 7) * 0.001) for i in range(300)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, n long, v double")
    got = rolling_blocks(df, ["k"], ["ts", "n"], {70: {"std": ("v", "std", 70)}}, None, 16)
    want = plain_rolling(df, 70, 70)
    for a, b in zip(got.orderBy("n").collect(), want.orderBy("n").collect(), strict=True):
        assert (a["std"] is None) == (b["std"] is None) and (a["std"] is None or a["std"] == pytest.approx(b["std"], rel=1e-3))


def test_features_mix_narrow_and_wide_windows(hot):
    rules = {"v": features.StatsRule((1, 3), (5, 64, 90), ("mean", "std", "min", "max"), min_periods=2)}
    key = ["k"]
    got = features.lag_rolling(hot, rules, fit_slices(hot, key, ["ts", "n"], 200), key, ["ts", "n"], wide_from=64)
    want = features.lag_rolling(hot, rules, None, key, ["ts", "n"], wide_from=10**9)
    assert set(got.columns) == set(want.columns)
    a, b = ([tuple(r) for r in df.select(sorted(want.columns)).orderBy("n").collect()] for df in (got, want))
    assert all(x == pytest.approx(y, abs=1e-7) if isinstance(x, float) else x == y for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
