"""The cheapest set of units against full listings and a table over capacities; sketches against ranks."""

import random
from datetime import date, datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from plantspark.operators import quality
from plantspark.operators.units import cheapest_units
from plantspark.plans import sketches

UNITS = "plant string, unit int, cap double, kw double, now int, bound string"


def listed(units, target, penalty, groups):
    """Least cost by trying every set."""
    best = None
    for on in product((0, 1), repeat=len(units)):
        names = [u[5] for u, x in zip(units, on, strict=True) if x and u[5] and groups]
        if len(names) != len(set(names)) or sum((u[2] or 0) * x for u, x in zip(units, on, strict=True)) < target:
            continue
        cost = sum((u[3] or 0) * x + penalty * (x != (u[4] or 0)) for u, x in zip(units, on, strict=True))
        best = cost if best is None else min(best, cost)
    return best


def test_small_plants_as_listed(spark):
    r = random.Random(8)
    rows = [(f"p{p}", i, float(r.randrange(20, 90)), float(r.randrange(10, 60)), r.randrange(2), r.choice([None, "x", "y"])) for p in range(5) for i in range(9)]
    rows += [("one", 0, 50.0, 9.0, 0, None), ("bound", 1, 10.0, 3.0, 1, "g"), ("bound", 2, 20.0, 4.0, 0, "g"), (None, 1, 10.0, 1.0, 0, None), ("nulls", 1, None, None, None, None), ("nulls", 2, 5.0, 2.0, 1, None)]
    plants = {p: [x for x in rows if x[0] == p] for p in dict.fromkeys(x[0] for x in rows)}
    goals = [(p, t) for p, us in plants.items() for t in (0.0, 0.3 * sum(u[2] or 0 for u in us), 0.8 * sum(u[2] or 0 for u in us), 1e6)] + [("p0", None), ("gone", 5.0)]
    df, targets = spark.createDataFrame(rows, UNITS), spark.createDataFrame(goals, "plant string, target_rt double")
    for current, group in ((None, None), ("now", "bound")):
        got = {(g["plant"], g.target_rt): g for g in cheapest_units(df, "plant", "unit", "cap", "kw", targets, current, group, 5.0).collect()}
        want = {(p, t): listed([(*u[:4], u[4] if current else 0, u[5]) for u in plants[p]], t, 5.0 if current else 0.0, group) for p, t in goals if t is not None and p in plants}
        assert {k: g.objective_kw for k, g in got.items()} == pytest.approx({k: v for k, v in want.items() if v is not None})
        for (p, t), g in got.items():
            on = [u for u in plants[p] if str(u[1]) in g.units]
            assert sum(u[2] or 0 for u in on) == pytest.approx(g.total_capacity) and g.total_capacity >= t - 1e-6 and g.n_on == len(on)
            assert sum(u[3] or 0 for u in on) == pytest.approx(g.total_kw)
            assert g.switches == (sum((u in on) != bool(u[4]) for u in plants[p]) if current else 0)


def test_thirty_and_forty_units(spark):
    """Whole capacities: a table of the least cost for each capacity gives the truth."""
    r, rows = random.Random(9), []
    for p, n in (("thirty", 30), ("forty", 40)):
        rows += [(p, i, float(r.randrange(50, 400)), float(r.randrange(30, 300)), 0, None) for i in range(n)]
    goals = [(p, float(int(sum(x[2] for x in rows if x[0] == p) * share))) for p in ("thirty", "forty") for share in (0.35, 0.7)]
    df = spark.createDataFrame(rows, UNITS)
    got = {(g["plant"], g.target_rt): g.objective_kw for g in cheapest_units(df, "plant", "unit", "cap", "kw", spark.createDataFrame(goals, "plant string, target_rt double")).collect()}
    for p, t in goals:
        least = [0.0] + [float("inf")] * int(t)
        for _, _, cap, kw, *_ in (x for x in rows if x[0] == p):
            for have in range(int(t), 0, -1):
                least[have] = min(least[have], least[max(0, have - int(cap))] + kw)
        assert got[p, t] == least[int(t)]


def test_too_many_units_is_an_error(spark):
    df = spark.createDataFrame([("p", i, 1.0, 1.0, 0, None) for i in range(60)], UNITS)
    with pytest.raises(Exception, match="use greedy_order"):
        cheapest_units(df, "plant", "unit", "cap", "kw", spark.createDataFrame([("p", 5.0)], "plant string, target_rt double")).collect()


def test_no_units(spark):
    none = spark.createDataFrame([], UNITS)
    assert cheapest_units(none, "plant", "unit", "cap", "kw", spark.createDataFrame([("p", 5.0)], "plant string, target_rt double")).count() == 0


# ------------------------------------------------------------------ sketches


@pytest.fixture(scope="module")
def month(spark):
    r, t0 = random.Random(1), datetime(2024, 2, 1)
    rows = [(r.choice(["hot"] * 8 + ["a", None]), t0 + timedelta(minutes=r.randrange(30 * 1440)), r.choice([5.0, r.gauss(0, 9), None])) for _ in range(20_000)]
    return spark.createDataFrame([*rows, ("none", t0, None), ("none", None, float("nan")), ("a", None, 1.0)], "k string, ts timestamp_ntz, v double").cache()


PROBS = {"p01": 0.01, "p50": 0.5, "p90": 0.9}


def test_any_range_of_stored_days(spark, month, tmp_path):
    path = str(tmp_path / "days")
    early = F.col("ts") < F.lit(datetime(2024, 2, 10, 12))
    sketches.append_days(sketches.day_sketches(month.where(early), ["k"], "v"), path)
    sketches.append_days(sketches.day_sketches(month.where(~early), ["k"], "v"), path)
    stored = spark.read.parquet(path)
    for first, last in ((date(2024, 2, 3), date(2024, 2, 4)), (date(2024, 2, 5), date(2024, 2, 20)), (None, None)):
        m = sketches.merged(stored, ["k"], first, last)
        found = sketches.quantiles_of(m, ["k"], PROBS)
        rows = month if first is None else month.where(F.col("ts").cast("date").between(F.lit(first), F.lit(last)))
        rows = rows if first is not None else rows.where("ts IS NOT NULL")
        counts = {r.k: r["count"] for r in rows.where("v IS NOT NULL").groupBy("k").count().collect()}
        assert {r.k: r.n for r in found.collect()} == counts
        for e in sketches.rank_errors(rows, ["k"], "v", found.drop("n"), PROBS).collect():
            assert max(e[p] for p in PROBS) <= 3 * sketches.rank_error() + 1 / counts[e.k]


def test_a_range_reads_its_days_only(spark, month, tmp_path):
    path = str(tmp_path / "days")
    sketches.append_days(sketches.day_sketches(month, ["k"], "v"), path)
    m = sketches.merged(spark.read.parquet(path), ["k"], date(2024, 2, 3), date(2024, 2, 4))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-02-03" in plan


def test_checks_with_sketches(month):
    exact, approx = quality.iqr_outliers(month, ["k"], "v"), quality.iqr_outliers(month, ["k"], "v", approx_k=800)
    n, m = (df.agg(F.count_if("is_outlier")).first()[0] for df in (exact, approx))
    assert n > 50 and abs(n - m) <= 0.1 * n and approx.count() == month.count()
    a = month.withColumns({"hz": F.lit(50.0), "kw": F.abs("v")})
    n, m = (quality.affinity_check(a, "hz", "kw", ["k"], approx_k=k).agg(F.count_if("affinity_law_invalid")).first()[0] for k in (None, 800))
    assert n > 50 and abs(n - m) <= 0.1 * n


def test_larger_sketches_are_more_exact():
    assert sketches.rank_error(200) > sketches.rank_error(800) > sketches.rank_error(4000)
