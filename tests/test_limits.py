"""Nothing is cut short: null keys, wide windows, long preambles, plants of many units."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.functions.timefx import time_chunk
from plantspark.operators import features, model, quality, sensors
from plantspark.operators import setpoints as sp
from plantspark.plans.joins import key_join
from plantspark.plans.ordered import prefix
from plantspark.plans.quantiles import exact_quantiles
from plantspark.sources import reports

T0 = datetime(2024, 1, 1)


def test_null_keys_are_keys(spark, rows):
    df = spark.createDataFrame([(k, T0 + timedelta(days=i), float(i)) for k in ("a", None) for i in range(6)], "k string, ts timestamp_ntz, v double")
    run = prefix(df, ["k"], ["ts"], {"total": ("v", "sum")}, time_chunk("ts", 2 * 86_400))
    assert sorted(r.total for r in run.where("k IS NULL").collect()) == [0, 1, 3, 6, 10, 15]
    assert rows(exact_quantiles(df, ["k"], "v", {"mid": 0.5})) == [(None, 2.5), ("a", 2.5)]
    small = spark.createDataFrame([(None, "n"), ("a", "x")], "k string, name string")
    assert key_join(df, small, ["k"]).where("name IS NULL").count() == 0
    assert key_join(df, small.where("k IS NULL"), ["k"], "left_anti").count() == 6


def test_a_hot_key_meets_its_row(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    out = key_join(left, right, ["k"])
    assert out.count() == 20_000 and out.where("twice <> 2 * k OR twice IS NULL").count() == 0


@pytest.mark.parametrize("units", [8, 12])
def test_plants_of_many_units(spark, units):
    u = spark.createDataFrame([("p", i, 10.0, 1.0) for i in range(units)], "plant string, unit int, cap double, kw double")
    target = spark.createDataFrame([("p", 0.0)], "plant string, target_rt double")
    out = sp.unit_combinations(u, "plant", "unit", "cap", "kw", target)
    assert out.count() == out.select("mask").distinct().count() == 2**units
    assert out.where(F.col("total_capacity") != 10 * F.col("n_on")).count() == 0


def test_wide_windows_are_computed(spark):
    df = spark.range(1300).select(F.lit("s").alias("site_id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), F.col("id").cast("double").alias("v"))
    out = features.lag_rolling(df, {"v": features.StatsRule((), (1200,))}, 3600, keys=["site_id"])
    assert out.where("v_rollmean_1200 IS NOT NULL").count() == 100


def test_backup_limits_are_the_policys(spark):
    rule = features.StatsRule((1, 2, 3), (60,))
    notes = [{"sensor": "a", "physical_type": "kw", "device_role": "backup"}]
    free = features.resolve_policies(notes, [features.Policy("P", ["kw"], rule)])["a"]
    assert free.windows == (120,) and free.lags == (1, 2, 3)


def test_late_headers_and_indented_points(spark, tmp_path):
    pre = "".join(f"note {i}\n" for i in range(700))
    (tmp_path / "a.csv").write_text(f'{pre}{" " * 60}"Point_1:","A_KW","",""\n"<>Date","Time","Point_1"\n2024/01/01,00:00:00,5\n')
    r, failed = reports.read_reports(spark, str(tmp_path))
    assert [(x.sensor, x.value) for x in r.collect()] == [("A_KW", 5.0)] and failed.count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text(f"{pre}Date,Time,a,b\n2024/01/01,00:00:00,1,2\n")
    h = reports.find_headers_by_words(reports.read_lines(spark, str(tmp_path / "b")))
    assert [x.header for x in h.collect()] == ["Date,Time,a,b"]


def test_all_unknown_sensors_are_listed(spark):
    readings = spark.createDataFrame([(f"s{i % 9}", i) for i in range(90)], "sensor string, v int")
    dim = spark.createDataFrame([("s0",)], "sensor string")
    assert sensors.without_annotation(readings, dim).count() == 8
    with pytest.raises(ValueError, match="8 sensors"):
        sensors.enforce_annotation(readings, dim)


def test_late_rows_are_counted(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=i),) for i in range(9)], "ts timestamp_ntz")
    with pytest.raises(quality.FutureDataError, match="7 rows"):
        quality.require_no_leakage(df, T0 + timedelta(days=1))


@pytest.fixture(scope="module")
def plant(spark):
    return spark.range(400).select(
        F.col("id"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 50 + 0.0).alias("load"), (F.col("id") % 50 * 2.0 + 10).alias("kw"),
    )


def test_intervals_for_all_rows_of_imputed_models(plant):
    cfg = model.ModelConfig(features=("load",), target="kw", ts="ts", kind="random_forest", trees=4, depth=3, use_time_features=False, impute="mean")
    fitted = model.train(plant, cfg)
    assert model.predict_interval(fitted, plant).count() == fitted.score(plant).count() == 400
    with pytest.raises(TypeError):
        model.predict_interval(model.train(plant, model.ModelConfig(features=("load",), target="kw", ts="ts", trees=2, depth=2, impute="mean")), plant)


def test_split_follows_the_rows_alone(plant):
    a, b = model.hash_split(plant, ["id"])
    c, d = model.hash_split(plant.repartition(7), ["id"])
    assert {r.id for r in b.collect()} == {r.id for r in d.collect()} and a.count() + b.count() == 400
    assert 40 < b.count() < 120 and c.join(d, "id").count() == 0


def test_exact_time_cut(plant):
    early, late = model.time_split(plant, "ts", 0.25)
    assert (early.count(), late.count()) == (300, 100)


def test_model_setpoints_keep_every_context(spark, plant):
    cfg = model.ModelConfig(features=("load", "hz"), target="kw", ts="ts", kind="random_forest", trees=3, depth=3, use_time_features=False)
    fitted = model.train(plant.withColumn("hz", F.col("id") % 7 + 40.0), cfg)
    contexts = spark.createDataFrame([(1, 20.0, "x"), (2, None, "y"), (3, 5.0, "z")], "cid int, load double, note string")
    out = sp.best_setpoints_by_model(contexts, "cid", fitted, lambda s: {"hz": s["hz"]}, {"hz": [40.0, 43.0, 46.0]}, feasible=lambda s: F.col("cid") != 3)
    got = {r.cid: r for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[1].note == "x" and got[1].best_kw is not None
    assert got[2].best_kw is None and got[3].best_kw is None and got[3].baseline_kw is not None


def test_lines_of_thousands_of_quoted_fields(spark):
    wide = ",".join(f'"{i},5"' for i in range(3000))
    df = spark.createDataFrame([(wide,), ('a,"b,c",,d"e",',), ("",), (',x,"y',)], "line string")
    got = [r[0] for r in df.select(reports.split_fields(F.col("line"))).collect()]
    assert got[0] == [f"{i},5" for i in range(3000)]
    assert got[1] == ["a", "b,c", "", 'd"e', ""] and got[2] == [""] and got[3] == ["", "x", "y"]


def test_long_holes_are_filled_in_blocks(spark, monkeypatch):
    from plantspark.operators import resample

    monkeypatch.setattr(resample, "HOLE_BLOCK", 7)
    rows = [("a", T0), ("a", T0 + timedelta(minutes=100)), ("a", T0 + timedelta(minutes=101)), ("b", T0), ("b", T0 + timedelta(minutes=14))]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "k string, ts timestamp_ntz, value double")
    got = resample.gap_fill(df, "1 minute", 86_400, keys=["k"]).collect()
    assert sorted((r.k, r.ts) for r in got) == [("a", T0 + timedelta(minutes=i)) for i in range(102)] + [("b", T0 + timedelta(minutes=i)) for i in range(15)]
    assert sum(r.value is not None for r in got) == 5
