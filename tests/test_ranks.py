"""Quantiles by refinement against the built-in ones, down to single values."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.operators import model
from plantspark.plans.ranks import refined_quantiles

PROBS = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "q99": 0.99, "q100": 1.0}


def wanted(values, p):
    v = sorted(values)
    pos = (len(v) - 1) * p
    lo = v[int(pos)]
    hi = v[min(int(pos) + 1, len(v) - 1)] if pos % 1 else lo
    return lo if lo == hi else lo + (hi - lo) * (pos % 1)


@pytest.mark.parametrize("limit", [1, 30, 10**6])
def test_every_key_and_distribution(spark, limit):
    r = random.Random(5)
    data = {
        "normal": [r.gauss(0, 1) for _ in range(700)],
        "epoch": [1.7e15 + r.randrange(86_400_000_000) for _ in range(700)],
        "equal": [7.0] * 400 + [7.5, 6.5],
        "one": [3.25],
        None: [r.choice([0.0, -0.0, 1.0, 2.0]) for _ in range(300)],
        "wide": [-1.7e308, 1.7e308, 1e-300, -1e-300, 0.0, 5.0, 1e300] * 20,
        "skew": [10.0 ** r.uniform(-20, 20) for _ in range(500)],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("nothing", None), ("nothing", float("nan")), ("normal", None), ("one", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x for x in refined_quantiles(df, ["k"], "v", PROBS, limit).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert got[k].n == len(values)
        assert [got[k][n] for n in PROBS] == pytest.approx([wanted(values, p) for p in PROBS.values()], rel=1e-12, abs=1e-12), k


def test_no_key_and_no_row(spark):
    df = spark.range(1001).select((F.col("id") * 3).alias("v"))
    assert refined_quantiles(df, [], "v", {"m": 0.5, "h": 0.9}, 5).first()[0:] == (1001, 1500.0, 2700.0)
    assert refined_quantiles(df.where("v < 0"), [], "v", {"m": 0.5}).count() == 0
    assert refined_quantiles(df.where("v < 0"), ["v"], "v", {"m": 0.5}).count() == 0


def test_time_split_at_the_exact_row(spark, monkeypatch):
    from plantspark.plans import ranks

    monkeypatch.setattr(ranks, "MAX_VALUES", 10)
    t0, r = datetime(2024, 5, 1), random.Random(2)
    times = [t0 + timedelta(microseconds=r.choice([0, r.randrange(50), r.randrange(86_400_000_000)])) for _ in range(997)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)] + [(-1, None)], "i int, ts timestamp_ntz").repartition(4)
    for share in (0.2, 0.5, 0.9):
        train, test = model.time_split(df, "ts", share)
        cut = sorted(times)[int((len(times) - 1) * (1 - share))]
        assert train.count() == sum(t <= cut for t in times) and train.count() + test.count() == 997
        assert model.split_moment(df, "ts", share) == int((cut - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    empty = df.where("i > 5000")
    assert model.split_moment(empty, "ts") is None and [x.count() for x in model.time_split(empty, "ts")] == [0, 0]


def test_only_a_few_rows_are_sorted(spark):
    """Windows are over a range of a key, never over a bare key."""
    df = spark.range(5000).select(F.lit("a").alias("k"), (F.col("id") * F.col("id")).alias("v"))
    q = refined_quantiles(df, ["k"], "v", {"m": 0.5}, 16)
    assert q.first().m == (2499.0**2 + 2500.0**2) / 2
    windows = re.findall(r"\nWindow \[.*?\], \[(.*?)\]", "\n" + q._jdf.queryExecution().optimizedPlan().toString().replace("+- ", "\n").replace(":- ", "\n"))
    assert windows and all("_lo" in w for w in windows)
