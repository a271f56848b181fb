"""Cleaning without a map, model set-points in two stages, run records, configuration from a mapping, contracts on reading."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.operators import model, sensors
from plantspark.operators import setpoints as sp
from plantspark.plans import cleaning
from plantspark.sources import tables as tb

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def reports(tmp_path):
    """Two overlapping reports of five points, one of a pump's frequency, one of its power."""
    for f, start in (("a", 0), ("b", 50)):
        lines = ['"Key Name:Suffix","Trend Definitions Used"', '"Point_1:","CHWP_HZ"', '"Point_2:","CHWP_KW"', '"Point_3:","CH-0.RT"', '"Point_4:","temp_db_out"', '"Point_5:","rh_out"', '"<>Date","Time","Point_1","Point_2","Point_3","Point_4","Point_5"']
        for i in range(start, start + 60):
            t = T0 + timedelta(minutes=5 * i)
            kw = 50.0 if i != 55 else 150.0
            lines.append(f"{t:%Y/%m/%d},{t:%H:%M:%S},{50 + i % 2 * 0.0},{kw},{100 + i},{25 + i % 3},{60}")
        (tmp_path / f"{f}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_a_folder_without_a_map_keeps_every_point(spark, reports):
    opt = cleaning.CleanOptions(load="CH_0_RT", affinity="auto")
    df, errors = cleaning.process_directory(spark, reports, opt=opt)
    assert errors.count() == 0 and df.count() == 110
    assert {"CHWP_HZ", "CHWP_KW", "CH_0_RT", "temp_db_out", "rh_out", "temp_wb_out", "CHWP_KW_frozen", "is_steady_state", "affinity_law_invalid"} <= set(df.columns)
    assert [r.ts for r in df.where("affinity_law_invalid").collect()] == [T0 + timedelta(minutes=275)]
    mapped, _ = cleaning.process_directory(spark, reports, {"CH_0_RT": "load"}, cleaning.CleanOptions(load="load"))
    assert "CHWP_KW" not in mapped.columns and "load" in mapped.columns
    both, _ = cleaning.process_directory(spark, reports, {"CH_0_RT": "load"}, cleaning.CleanOptions(load="load"), keep_rest=True)
    assert {"load", "CHWP_KW", "rh_out"} <= set(both.columns) and "CH_0_RT" not in both.columns


def test_columns_of_sensors_without_clashes(spark):
    df = spark.createDataFrame([(x,) for x in ("a.b", "a-b", "A_B", "ts", "x y", None)], "sensor string")
    got = cleaning.sensor_columns(df, {"x y": "a_b_2", "gone": "g"})
    assert got["x y"] == "a_b_2" and got["gone"] == "g" and len({c.lower() for c in got.values()} | {"ts", "site_id"}) == len(got) + 2
    assert sensors.pump_columns_of(["site_id", "CHWP_HZ", "other_hz", "chwp_kw"]) == ("CHWP_HZ", "chwp_kw")
    assert sensors.pump_columns_of(["load", "fan_hz"]) is None


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(i, float(i % 20), float(30 + i % 31), (i % 20) * 2.0 + abs(30 + i % 31 - 43.0)) for i in range(620)]
    plant = spark.createDataFrame(rows, "id int, load double, hz double, kw double")
    cfg = model.ModelConfig(features=("load", "hz"), target="kw", kind="gbt", trees=30, depth=5, use_time_features=False, row_keys=("id",))
    return model.train(plant, cfg)


def test_model_setpoints_in_two_stages(spark, fitted):
    contexts = spark.createDataFrame([(1, 4.0, 55.0, "x"), (2, None, 40.0, "y"), (3, 15.0, None, "z")], "cid int, load double, now double, note string")
    axes = {"hz": [30.0, 40.0, 50.0, 60.0]}

    def search(**more):
        out = sp.best_setpoints_by_model(contexts, "cid", fitted, lambda s: {"hz": s["hz"]}, axes, ["now"], **more)
        return {r.cid: r for r in out.collect()}

    coarse, fine = search(), search(refine=1.5)
    assert coarse[1].best_hz == 40.0 and fine[1].best_hz == 43.0 and fine[1].best_kw < coarse[1].best_kw
    assert fine[3].baseline_kw == coarse[3].baseline_kw and fine[1].savings_kw == pytest.approx(fine[1].baseline_kw - fine[1].best_kw)
    assert fine[1].success and fine[1].violations == [] and fine[1].note == "x"
    assert fine[2].best_kw is None and not fine[2].success
    narrow = search(bounds=(45.0, 60.0))
    assert narrow[1].best_hz == 40.0 and not narrow[1].success and len(narrow[1].violations) == 1


def test_runs_from_a_search(spark, fitted, tmp_path):
    contexts = spark.createDataFrame([(1, 4.0, 55.0, 31.0), (2, None, 40.0, 30.0)], "cid int, load double, now double, outdoor double")
    found = sp.best_setpoints_by_model(contexts, "cid", fitted, lambda s: {"hz": s["ct_fan_hz"]}, {"ct_fan_hz": [30.0, 43.0]}, ["now"])
    runs = tb.runs_from_search(found, "m1", "grid", T0, "load", "outdoor", {"ct_fan_hz": "now"})
    history = tb.RunHistory(spark, str(tmp_path / "runs"))
    history.append(runs)
    r = history.all().collect()
    assert len(r) == 1 and (r[0].optimal_tower_fan_hz, r[0].current_tower_fan_hz, r[0].optimal_chw_pump_hz) == (43.0, 55.0, 0.0)
    assert (r[0].model_name, r[0].method, r[0].timestamp, r[0].outdoor_temp) == ("m1", "grid", T0, 31.0)
    assert r[0].savings_percent == pytest.approx(100 * r[0].savings_kw / r[0].current_power_kw)


def test_configuration_from_a_mapping(spark):
    mapping = sensors.mapping_frame(spark, {"environment": ["OAT"], "chiller": ["CH_1", "CH_0"], "mine": ["X"], "cw_pump": ["P", "CH_0"]}, target="KW")
    cfg = model.config_from_mapping(mapping, trees=7)
    assert (cfg.features, cfg.target, cfg.trees) == (("CH_0", "CH_1", "P", "OAT", "X"), "KW", 7)
    assert model.config_from_mapping(mapping, target="other").target == "other"
    two = mapping.unionByName(sensors.mapping_frame(spark, {}, target="KW2"))
    with pytest.raises(ValueError, match="several targets"):
        model.config_from_mapping(two)


def test_contracts_are_checked_on_reading(spark, tmp_path):
    path = str(tmp_path / "batch")
    df = spark.createDataFrame([("s", "k", T0, 1, 2.0)], "site_id string, sensor string, ts timestamp_ntz, row_no long, value double")
    tb.write_batch(df, path, "s", T0)
    assert tb.read_batch(spark, path)[0].count() == 1
    with pytest.raises(tb.ContractError, match="column when is missing"):
        tb.read_batch(spark, path, ts="when")
    row = spark.read.json(f"{path}/manifest").first()
    body = json.loads(row.manifest) | {"timestamp_schema": {"unit": "nanoseconds", "timezone": "UTC"}}
    text = json.dumps(body, sort_keys=True)
    spark.createDataFrame([(text,)], "manifest string").withColumn("checksum", F.sha2("manifest", 256)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(tb.ContractError, match="times in nanoseconds"):
        tb.read_batch(spark, path)
