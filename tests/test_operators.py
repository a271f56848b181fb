"""Operators on hand-made fixtures with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.functions import physics
from plantspark.operators import consistency as co
from plantspark.operators import equipment as eq
from plantspark.operators import features, flags, quality, sensors
from plantspark.operators import resample as rs
from plantspark.operators import setpoints as sp
from plantspark.plans.cleaning import CleanOptions, clean, clean_wide, frozen_candidates

T0 = datetime(2024, 1, 1)
DAY = 86_400


def series(spark, values, minutes=5, sensor="s", site="a"):
    rows = [(site, "f", i, T0 + timedelta(minutes=minutes * i), sensor, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site_id string, source_file string, row_no long, ts timestamp_ntz, sensor string, value double")


# ------------------------------------------------------------------ resampling


def test_resample_31_minutes_gives_7_windows(spark):
    r = rs.resample(series(spark, range(31), 1), "5 minutes").orderBy("ts").collect()
    assert [x.ts for x in r] == [T0 + timedelta(minutes=5 * i) for i in range(7)]
    assert r[0].value == 2.0 and r[6].value == 30.0
    assert rs.resample(series(spark, range(61), 1), "5 minutes").count() == 13


def test_resample_kinds(spark):
    df = series(spark, range(10), 1, "CH_1_KWH").unionByName(series(spark, [0, 1, 0, 0, 0, 0, 0, 0, 0, 2], 1, "CH_1_S")).unionByName(
        series(spark, range(10), 1, "CH_1_KW")
    )
    got = {(r.sensor, r.ts.minute): r.value for r in rs.resample(df, "5 minutes").collect()}
    assert got == {("CH_1_KWH", 0): 4, ("CH_1_KWH", 5): 9, ("CH_1_S", 0): 1, ("CH_1_S", 5): 2, ("CH_1_KW", 0): 2, ("CH_1_KW", 5): 7}


def test_last_reading_keeps_null_and_breaks_ties_by_row(spark):
    df = spark.createDataFrame(
        [("a", 1, T0, "X_KWH", 1.0), ("a", 3, T0, "X_KWH", None), ("a", 2, T0, "X_KWH", 2.0), ("a", 1, T0, "Y_KWH", 5.0), ("a", 2, T0, "Y_KWH", 6.0)],
        "site_id string, row_no long, ts timestamp_ntz, sensor string, value double",
    )
    assert {r.sensor: r.value for r in rs.resample(df, "5 minutes").collect()} == {"X_KWH": None, "Y_KWH": 6.0}


def test_gap_is_filled_and_flagged(spark):
    df = series(spark, [1, 2, 3, 4]).where("row_no <> 2")
    r = rs.gap_fill(df, "5 MINUTES", DAY).orderBy("ts").collect()
    assert [x.value for x in r] == [1, 2, None, 4]
    assert [x.quality_flags for x in r] == [[], [], ["INSUFFICIENT_DATA"], []]


def test_wide_long_and_union(spark, rows):
    df = series(spark, [1, 2], sensor="p").unionByName(series(spark, [3, None], sensor="q"))
    wide = rs.to_wide(df, {"p": "a", "q": "b", "absent": "c"})
    assert rows(wide, "a", "b", "c") == [(1.0, 3.0, None), (2.0, None, None)]
    long = rs.to_long(wide, ["a", "b"])
    assert long.count() == 4
    x = spark.createDataFrame([(1, "7")], "id int, v string")
    y = spark.createDataFrame([(2, 3.5), (3, 4.5)], "id int, v double")
    z = spark.createDataFrame([(4, "n")], "id int, w string")
    assert rows(rs.union_tables(x, y, z)) == [(1, 7.0, None), (2, 3.5, None), (3, 4.5, None), (4, None, "n")]


def test_keep_first(spark, rows):
    df = spark.createDataFrame(
        [("a", "f2", 1, T0, "s", 1.0), ("a", "f1", 9, T0, "s", 2.0), ("a", "f1", 3, T0, "s", 3.0)],
        "site_id string, source_file string, row_no long, ts timestamp_ntz, sensor string, value double",
    )
    assert rows(rs.keep_first(df), "source_file", "row_no", "value") == [("f1", 3, 3.0)]


# ------------------------------------------------------------------ quality


def test_frozen_13(spark):
    f = quality.frozen_flags(series(spark, [100.0] * 10 + [110, 120, 130]), DAY).orderBy("ts").collect()
    assert [r.is_frozen for r in f] == [False] * 5 + [True] * 5 + [False] * 3


def test_frozen_by_role(spark):
    base = series(spark, [5.0] * 7)
    for role, first in (("primary", 2), ("seasonal", 5), ("backup", None)):
        f = quality.frozen_by_role(base.withColumn("device_role", F.lit(role)), DAY).orderBy("ts").collect()
        want = [first is not None and i >= first for i in range(7)]
        assert [r.is_frozen for r in f] == want


def test_steady_state(spark):
    df = series(spark, [100, 101, 102, 150, 150, None, 150]).withColumnRenamed("value", "load")
    s = quality.steady_state(df, "load", DAY).orderBy("ts").collect()
    assert [r.is_steady_state for r in s] == [True, True, True, False, False, True, True]
    assert quality.steady_state(df, "absent", DAY).where("is_steady_state").count() == 7


def test_wet_bulb_values(spark):
    df = spark.createDataFrame([(25.0, 60.0), (85.0, 60.0)], "t double, h double")
    got = [r[0] for r in df.select(physics.wet_bulb("t", "h")).collect()]
    assert got == pytest.approx([19.5027, 73.4138], abs=1e-4)
    assert [r[0] is None for r in df.select(physics.wet_bulb_guarded("t", "h")).collect()] == [False, True]
    pair = spark.createDataFrame([(25.0, 60.0)], "roof_temp double, roof_rh double")
    assert features.paired_wet_bulb(pair).first()["roof_wet_bulb_physics"] == pytest.approx(19.5027, abs=1e-4)


def test_units(spark):
    df = spark.createDataFrame([(100.0, "GPM"), (55.0, "F"), (45.0, "F"), (7.0, "kW")], "v double, u string")
    assert [r[0] for r in df.select(physics.to_si("v", "u")).collect()] == pytest.approx([378.541, 12.7778, 7.2222, 7.0], abs=1e-3)


def test_heat_balance_edge(spark):
    df = spark.createDataFrame([(24.0, 12.0, 7.0, 5.0), (24.0, 12.0, 7.0, 0.0), (24.0, None, 7.0, 5.0), (24.0, 12.0, 7.0, 9.0)], "f double, a double, b double, rt double")
    assert [r[0] for r in df.select(physics.heat_balance_invalid("f", "a", "b", "rt")).collect()] == [False, True, None, True]


def test_affinity_ignores_standstill(spark):
    df = spark.createDataFrame([("a", 50.0, 12.5), ("a", 40.0, 6.4), ("a", 50.0, 25.0), ("a", 0.0, 1.0)], "k string, hz double, kw double")
    r = {x.kw: x.affinity_law_invalid for x in quality.affinity_check(df, "hz", "kw", ["k"]).collect()}
    assert r == {12.5: False, 6.4: False, 25.0: True, 1.0: None}
    assert quality.drop_invalid(quality.affinity_check(df, "hz", "kw", ["k"])).count() == 3
    idle = spark.createDataFrame([("a", 50.0, 0.0), ("a", 50.0, 0.0), ("a", 50.0, 9.0)], "k string, hz double, kw double")
    assert quality.affinity_check(idle, "hz", "kw", ["k"]).where("affinity_law_invalid").count() == 3


def test_circuit_breaker(spark):
    df = series(spark, range(100))
    with pytest.raises(quality.CircuitBreakerOpen):
        quality.circuit_breaker(df, F.lit(True))
    assert "batch_tag" in quality.circuit_breaker(df, F.lit(True), on_trip="tag").columns
    assert quality.circuit_breaker(df, F.col("value") < 10).count() == 100


def test_guards(spark):
    df = series(spark, range(3), 10)
    ok, bad = quality.split_future(df, T0)
    assert ok.count() == 0 and bad.first().n_future == 2
    assert quality.split_future(df, T0 + timedelta(minutes=15))[0].count() == 3
    with pytest.raises(quality.FutureDataError):
        quality.require_no_leakage(df, T0)
    assert quality.require_no_leakage(df, T0 + timedelta(days=1)).count() == 3
    with pytest.raises(ValueError, match="3 complete rows"):
        quality.require_samples(df, ["value"], "row_no")


def test_clean_chain(spark):
    n = 12
    long = series(spark, [100.0] * n, sensor="CH_0_RT")
    for name, vals in {"PUMP_KW": [12.5] * n, "PUMP_HZ": [50.0] * n, "temp_db_out": [25.0] * n, "rh_out": [60.0] * n}.items():
        long = long.unionByName(series(spark, vals, sensor=name))
    names = {s: s for s in ("CH_0_RT", "PUMP_KW", "PUMP_HZ", "temp_db_out", "rh_out")}
    opt = CleanOptions(load="CH_0_RT", affinity=("PUMP_HZ", "PUMP_KW"), drop_invalid=True)
    out = clean(long, names, opt).orderBy("ts").collect()
    assert len(out) == n
    assert out[0].temp_wb_out == pytest.approx(19.5027, abs=1e-4)
    assert [r.PUMP_KW_frozen for r in out] == [False] * 5 + [True] * 7
    assert frozen_candidates(["A_KWH", "x_temp", "rh"]) == ["A_KWH", "x_temp"]
    assert clean_wide(rs.to_wide(long, names), CleanOptions(frozen_columns=())).count() == n


def test_process_directory(spark, tmp_path):
    from plantspark.plans.cleaning import process_directory

    head = '"Point_1","P-1.KW"\n"<>Date","Time","Point_1"\n'
    (tmp_path / "a.csv").write_text(head + "2024/01/01,00:00:00,1\n2024/01/01,00:02:00,3\n")
    (tmp_path / "b.csv").write_text(head + "2024/01/01,00:01:00,100\n2024/01/01,00:05:00,7\n")
    (tmp_path / "c.csv").write_text("nothing\n")
    out, errors = process_directory(spark, str(tmp_path), {"P_1_KW": "kw"}, CleanOptions())
    assert [(r.ts.minute, r.kw, r.kw_frozen) for r in out.orderBy("ts").collect()] == [(0, 2.0, False), (5, 7.0, False)]
    assert errors.count() == 1


# ------------------------------------------------------------------ flags


def test_flags(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    f = flags.with_flags(df, {"OUTLIER": F.col("v") > 3, "FROZEN": F.col("v") > 0})
    assert [r.quality_flags for r in f.collect()] == [["FROZEN"], ["OUTLIER", "FROZEN"], []]
    again = flags.with_flags(f, {"FROZEN": F.col("v") > 0})
    assert [r.quality_flags for r in again.collect()] == [r.quality_flags for r in f.collect()]
    assert flags.drop_flagged(f).count() == 1
    assert flags.one_hot(f, ["OUTLIER"]).agg(F.sum("flag_outlier")).first()[0] == 1
    assert flags.flags_from_json(flags.flags_to_json(f)).collect() == f.collect()
    d = flags.vocabulary_diff(F.array(F.lit("A"), F.lit("B")), ["B", "C"])
    assert spark.range(1).select(d["unknown"], d["unused"]).first()[:] == (["A"], ["C"])
    m = spark.sql("select map('unit', 'kW', 'device_role', 'backup') m").select(flags.sanitise_metadata(F.col("m"))).first()[0]
    assert m == {"unit": "kW"}


# ------------------------------------------------------------------ equipment


def test_states(spark):
    df = spark.createDataFrame([(5.0,), (None,), (11.0,), (1.0,)], "kw double")
    assert [r[0] for r in df.select(eq.equipment_state("kw", "chiller")).collect()] == ["TRANSITION", "UNKNOWN", "ON", "OFF"]
    assert df.select(eq.equipment_state("kw", "valve")).first()[0] == "UNKNOWN"


def test_rules(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (None, 0, 0)], "ch1 int, pump int, ch2 int")
    rules = [eq.Rule("r", "requires", ["ch1"], ["pump"]), eq.Rule("m", "mutex", ["ch1", "ch2"])]
    got = [r.quality_flags for r in eq.apply_rules(df, rules).collect()]
    assert got == [[], ["REQUIRES_VIOLATION"], ["MUTEX_VIOLATION"], []]
    audit = {r.rule_id: (r.violations, r.severity) for r in eq.audit_rules(df, rules).collect()}
    assert audit == {"r": (1, "HIGH"), "m": (1, "HIGH")}
    rec = eq.audit_record(df, rules).first()
    assert rec.constraints_applied == ["m", "r"] and rec.violations_detected == 2 and rec.violation_details == {"r": 1, "m": 1}
    valve = spark.createDataFrame([(6.0, 0), (4.0, 0), (6.0, 1)], "valve double, fan int")
    lock = eq.Rule("v", "requires", ["valve"], ["fan"], on_above=5.0)
    assert [r[0] for r in valve.select(lock.violated()).collect()] == [True, False, False]
    assert eq.Rule("x", "mutex").is_hard is False and eq.Rule("x", "range").is_hard and not eq.Rule("x", "range", soft=True).is_hard
    assert eq.Rule("x", "threshold", high=10.0).relaxed().high == pytest.approx(11.0)


def test_rule_conflicts(spark, rows):
    t = eq.RuleTable([eq.Rule("r", "requires", ["a"], ["b", "c"]), eq.Rule("m", "mutex", ["x", "b", "a"]), eq.Rule("k", "mutex", ["c", "d"])])
    assert rows(eq.rule_conflicts(t.frame(spark))) == [("a", "b", "r", "m")]


def test_run_times(spark, rows):
    on, off = "ON", "OFF"
    states = [on] * 5 + [off] * 3 + [on] * 8 + [off] * 10 + [on] * 1
    df = series(spark, range(len(states))).withColumn("state", F.element_at(F.array(*[F.lit(s) for s in states]), (F.col("row_no") + 1).cast("int")))
    seg = eq.state_segments(df, 1800)
    assert rows(seg, "n_rows", "state", "minutes") == rows(spark.createDataFrame([(5, on, 20.0), (3, off, 10.0), (8, on, 35.0), (10, off, 45.0), (1, on, 0.0)], "a long, b string, c double"))
    v = eq.runtime_violations(seg, 30, 15)
    assert sorted((r.violation, r.minutes) for r in v.collect()) == [("MIN_DOWNTIME_VIOLATION", 10.0), ("MIN_RUNTIME_VIOLATION", 0.0), ("MIN_RUNTIME_VIOLATION", 20.0)]
    assert eq.start_events(df, 1800).count() == 3


def test_startup_sequence(spark):
    rows_ = [("a", T0 + timedelta(minutes=m), i, d, s) for i, (m, d, s) in enumerate([
        (0, "ct", "OFF"), (0, "ch", "OFF"), (5, "ch", "ON"), (10, "ct", "ON"), (20, "ch", "OFF"), (30, "ch", "ON"), (40, "ch", "OFF"), (50, "ct", "OFF"), (50, "ch", "ON")])]
    df = spark.createDataFrame(rows_, "site_id string, ts timestamp_ntz, row_no long, device string, state string")
    for s in (600, 86_400):
        r = eq.startup_sequence(df, "ct", "ch", s).orderBy("ts").collect()
        assert [(x.prior_state, x.violated) for x in r] == [("OFF", True), ("ON", False), ("OFF", True)]


# ------------------------------------------------------------------ sensors


def test_classify(spark):
    names = ["CH_0_RT", "CHP_01_VFD_OUT", "CWP_01_VFD_OUT", "CT_01_VFD_OUT", "CT_SYS_OAT", "CH_SYS_TOTAL_KW", "CH_1_ALARM"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "sensor string, position int")
    got = {}
    for r in sensors.classify_by_parts(df).collect():
        got.setdefault(r.sensor, set()).add(r.category)
    assert got["CH_0_RT"] == {"chiller"} and "CH_1_ALARM" not in got
    assert got["CH_SYS_TOTAL_KW"] == {"system_level"} and got["CT_SYS_OAT"] == {"cooling_tower", "environment"}
    assert sensors.pick_target(df).first()[:] == ("CH_SYS_TOTAL_KW", "power")
    assert sensors.pick_target_by_glob(df).first()[0] == "CH_SYS_TOTAL_KW"
    g = sensors.classify_by_glob(df, {"load": "*_RT", "chw_pump": ["CHP*VFD_OUT"]}).collect()
    assert sorted((r.sensor, r.category, r.is_custom) for r in g) == [("CHP_01_VFD_OUT", "chw_pump", False), ("CH_0_RT", "load", True)]


def test_mapping_table(spark, tmp_path, rows):
    m = sensors.mapping_frame(spark, {"load_cols": ["CH_0_RT"], "chw_pump": ["CHP_1"]}, "KW")
    m = sensors.add_category(m, "pressure", ["P1"])
    assert rows(sensors.category_sensors(m, "load")) == [("CH_0_RT",)]
    sensors.save_mapping(m, str(tmp_path / "m"))
    back = sensors.load_mapping(spark, str(tmp_path / "m"))
    assert rows(back) == rows(m)
    assert sensors.remove_category(back, "pressure").count() == 3
    (tmp_path / "site.json").write_text('{"_comment": "x", "load_cols": ["A"], "target_col": "T", "custom_features": {"z": ["Z1"]}, "odd": 3}')
    f = sensors.read_mapping_file(spark, str(tmp_path / "site.json"))
    assert rows(f, "sensor", "category") == [("A", "chiller"), ("T", "target"), ("Z1", "z")]


def test_annotations(spark, rows):
    base = spark.createDataFrame([("a", "temp", "primary"), ("b", "kw", "backup")], "sensor string, physical_type string, device_role string")
    site = spark.createDataFrame([("a", None, "seasonal"), ("c", "hz", "primary")], "sensor string, physical_type string, device_role string")
    merged = sensors.inherit_annotations(base, site)
    assert rows(merged) == [("a", "temp", "seasonal"), ("b", "kw", "backup"), ("c", "hz", "primary")]
    r = series(spark, [1], sensor="a").unionByName(series(spark, [2], sensor="zz"))
    with pytest.raises(ValueError, match="zz"):
        sensors.enforce_annotation(r, merged)
    assert sensors.enforce_annotation(r, merged, "skip").count() == 1
    assert sensors.enforce_annotation(r, merged, "warn").count() == 2
    lab = sensors.label_features(spark.createDataFrame([("a",), ("a_lag_1",)], "sensor string"), merged)
    assert rows(lab) == [("a", "temp"), ("a_lag_1", "derived")]
    eqd = merged.withColumn("equipment_id", F.lit("ch_1"))
    assert sensors.equipment_groups(eqd)["by_role"]("backup").count() == 1
    assert sensors.equipment_groups(eqd)["by_type"]("ch").count() == 3


def test_unique_names(spark):
    assert sensors.require_unique_names(spark.createDataFrame([("timestamp",), ("A b",)], "name string")).count() == 2
    with pytest.raises(ValueError, match="a b|A b"):
        sensors.require_unique_names(spark.createDataFrame([("A b",), ("a_b",)], "name string"))


# ------------------------------------------------------------------ features


def test_no_leakage(spark):
    rule = {"value": features.StatsRule((1,), (3,), ("mean", "std", "min", "max"))}
    base = features.lag_rolling(series(spark, range(25), 60), rule, DAY).orderBy("ts").collect()
    changed = features.lag_rolling(series(spark, [*range(20), 999, *range(21, 25)], 60), rule, DAY).orderBy("ts").collect()
    assert base[20].value_rollmean_3 == changed[20].value_rollmean_3 == 18.0
    assert base[21].value_rollmean_3 != changed[21].value_rollmean_3
    assert [r.value_rollmean_3 for r in base[:4]] == [None, None, None, 1.0]
    part = features.lag_rolling(series(spark, range(5), 60), {"value": features.StatsRule((), (3,), min_periods=1)}, DAY).orderBy("ts").collect()
    assert [r.value_rollmean_3 for r in part] == [None, 0.0, 0.5, 1.0, 2.0]


def test_policies():
    notes = [
        {"sensor": "a", "physical_type": "kw", "device_role": "backup"},
        {"sensor": "b", "physical_type": "kw"},
        {"sensor": "t", "physical_type": "kw", "is_target": True},
    ]
    rule = features.StatsRule((1, 2, 3), (60, 10))
    got = features.resolve_policies(notes, [features.Policy("P", ["kw"], rule, backup_max_window=96, backup_max_lags=2)])
    assert set(got) == {"a", "b"} and got["b"] == rule
    assert got["a"].windows == (96, 20) and got["a"].lags == (1, 2)
    assert set(features.resolve_policies(notes, [features.Policy("High_Freq", ["kw"], rule)])) == {"b"}
    own = features.StatsRule((9,))
    assert features.resolve_policies(notes, [features.Policy("P", ["kw"], rule)], {"b": own})["b"] == own
    used, left = features.usable_windows(rule, 40)
    assert used.windows == (10,) and left.windows


def test_alignment():
    features.check_alignment(["a", "b"], ["a", "b"], features.feature_hash(["a", "b"]))
    for bad in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(features.FeatureOrderError):
            features.check_alignment(["a", "b"], bad)
    assert features.available_features(["x", "y"], ["y", "y", "z", "x"]) == ["y", "x"]


def test_set_overlap(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    assert spark.range(1).select(features.set_overlap(a, b)).first()[0] == 0.5
    names = F.array(F.lit("a"), F.lit("b"))
    assert spark.range(1).select(features.feature_hash_column(names)).first()[0] == features.feature_hash(["a", "b"])


# ------------------------------------------------------------------ consistency


def test_tolerance(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(co.dynamic_tolerance(F.lit(20.0), F.lit(2))) == pytest.approx(8.0)
    assert get(co.dynamic_tolerance(F.lit(80.0), F.lit(3))) == pytest.approx(4.9)
    assert get(co.dynamic_tolerance(F.lit(80.0), F.lit(3), beta_table={1: 0.9, 2: 1.0, 3: 1.2})) == pytest.approx(5.3)
    assert get(co.dynamic_tolerance(F.lit(20.0), F.lit(30))) == 15.0
    assert get(co.availability_level(F.lit(4), F.lit(2), F.lit(0))) == "L3"
    assert get(co.availability_level(F.lit(2), F.lit(2), F.lit(1))) == "L2"
    assert get(co.availability_level(F.lit(1), F.lit(1), F.lit(3))) == "L1"


def pair_table(spark, factor, spike=0.0):
    rows_ = [(float(i % 100), 100.0 + i, (100.0 + i) * factor + (spike if i == 7 else 0.0)) for i in range(300)]
    return spark.createDataFrame(rows_, "load double, s double, c double")


@pytest.mark.parametrize(
    "factor,spike,verdict,code",
    [(1.0, 0.0, "FULL_CONSISTENCY", ""), (1.06, 0.0, "FAIL", "SYSTEMATIC_BIAS_DETECTED"), (1.0, 60.0, "FAIL", "OUTLIER_VIOLATION"), (1.04, 0.0, "WARNING", "COUPLING_EFFECT_DETECTED")],
)
def test_verdict(spark, factor, spike, verdict, code):
    t = pair_table(spark, factor, spike)
    bins = co.binned_metrics(t, "s", "c", {"load": co.load_bin(F.col("load"))}, co.dynamic_tolerance(F.col("load"), F.lit(2)))
    v = co.verdict(bins, co.overall_stats(t, "s", "c")).first()
    assert v.verdict == verdict
    assert code in ",".join(v.failures + v.warnings)


def test_bins_under_ten_rows_are_skipped(spark):
    t = spark.createDataFrame([(10.0, 1.0, 1.0)] * 9 + [(50.0, 1.0, 1.0)] * 50 + [(90.0, 1.0, 1.0)] * 20, "load double, s double, c double")
    assert {r.bin for r in co.binned_metrics(t, "s", "c", {"load": co.load_bin(F.col("load"))}).collect()} == {"medium", "heavy"}


def test_comparison_rows(spark):
    def make(test, val):
        return spark.createDataFrame([("test",)] * test + [("val",)] * val + [("train",)] * 5, "split string")

    assert co.comparison_rows(make(150, 10))[1] == "test"
    assert co.comparison_rows(make(50, 120))[1] == "val"
    df, tag = co.comparison_rows(make(50, 80))
    assert (tag, df.count()) == ("combined", 130)
    with pytest.raises(co.ConsistencyError):
        co.comparison_rows(make(5, 5))


# ------------------------------------------------------------------ set-points


def test_combinations_need_both(spark):
    u = spark.createDataFrame([("p", 1, 300.0, 200.0), ("p", 2, 300.0, 210.0)], "plant string, unit int, cap double, kw double")
    t = spark.createDataFrame([("p", 500.0)], "plant string, target_rt double")
    r = sp.unit_combinations(u, "plant", "unit", "cap", "kw", t).collect()
    assert [(x.mask, x.total_kw) for x in r] == [(3, 410.0)]
    low = spark.createDataFrame([("p", 250.0)], "plant string, target_rt double")
    best = sp.unit_combinations(u, "plant", "unit", "cap", "kw", low).orderBy("objective_kw").first()
    assert best["mask"] == 1
    many = spark.range(12).select(F.lit("p").alias("plant"), F.col("id").alias("unit"), F.lit(1.0).alias("cap"), F.lit(1.0).alias("kw"))
    assert sp.unit_combinations(many, "plant", "unit", "cap", "kw", low).count() == 0


def test_grid_matches_brute_force(spark):
    ctx = spark.createDataFrame([(1, 300.0), (2, 900.0)], "id int, load_rt double")
    axes = {n: sp.hz_steps(step=10.0) for n in sp.SETPOINTS}
    score = lambda s: sp.analytic_power(s, F.col("load_rt"))
    got = {r.id: r for r in sp.best_setpoints(ctx, score, axes).collect()}

    def kw(c, w, f, load):
        lack = sum((50 / x - 1) ** 2 for x in (c, w, f))
        return 0.7 * load + 10 * ((c + w) / 2 / 50) ** 3 + 5 * (f / 50) ** 3 + load * lack

    steps = sp.hz_steps(step=10.0)
    for i, load in ((1, 300.0), (2, 900.0)):
        want = min((kw(c, w, f, load), c, w, f) for c in steps for w in steps for f in steps)
        assert got[i].best_kw == pytest.approx(want[0])
        assert (got[i].best_chw_pump_hz, got[i].best_cw_pump_hz, got[i].best_ct_fan_hz) == want[1:]
        assert got[i].savings_kw == pytest.approx(kw(45, 45, 45, load) - want[0])


def test_empty_savings(spark):
    empty = spark.createDataFrame([], "savings_kw double, savings_percent double")
    assert tuple(sp.savings_summary(empty).first()) == (0, 0.0, 0.0, 0.0)


def test_scoring_row():
    ctx = {"load_rt": F.lit(400.0)}
    s = {n: F.lit(40.0) for n in sp.SETPOINTS}
    row = sp.scoring_row(s, ctx, ["CH_0_RT", "CH_1_RT"], ["CHP_1"], ["CWP_1"], ["CT_1"], ["CH_0_SWT", "CH_0_RWT", "X"])
    assert list(row) == ["CH_0_RT", "CH_1_RT", "CHP_1", "CWP_1", "CT_1", "CH_0_SWT", "CH_0_RWT", "X"]
