"""Queries for data-quality checks, guards, reports and flags."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from plantspark.functions import physics
from plantspark.functions.text import scrub_number
from plantspark.functions.timefx import to_utc
from plantspark.operators import flags, quality
from plantspark.plans import sketches
from plantspark.plans.stored import shared_folder
from plantspark.queries.registry import (
    HOURLY,
    HOURLY_SLICE,
    METERS,
    PLANT,
    READINGS,
    hourly,
    meters,
    plant,
    query,
    r6,
    readings,
    table,
)
from plantspark.sources import guarded


@query(
    "zero_share",
    f"""
WITH {READINGS}, z AS (
  SELECT site_id, sensor, floor(value / 20) AS value,
         CASE WHEN right(sensor, 1) IN ('0', '1') THEN 'primary' WHEN right(sensor, 1) IN ('2', '3') THEN 'backup'
              ELSE 'seasonal' END AS device_role
  FROM readings),
a AS (SELECT site_id, sensor, device_role, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS share,
        CASE device_role WHEN 'primary' THEN 0.1 WHEN 'backup' THEN 0.8 ELSE 0.5 END AS lim FROM z GROUP BY 1, 2, 3)
SELECT site_id, sensor, device_role, round(share, 6) AS zero_share, CAST(lim AS DOUBLE) AS zero_limit,
       share > lim AS high_zero_ratio
FROM a""",
)
def zero_share(spark, sf):
    last = F.substring("sensor", -1, 1)
    role = F.when(last.isin("0", "1"), "primary").when(last.isin("2", "3"), "backup").otherwise("seasonal")
    r = readings(spark, sf).withColumn("device_role", role).withColumn("value", F.floor(F.col("value") / 20))
    return quality.zero_share(r, role="device_role").withColumn("zero_share", r6("zero_share"))


@query(
    "mean_limits",
    f"""
WITH {READINGS}, a AS (
  SELECT site_id, sensor, avg(value) AS mean, stddev_samp(value) AS std FROM readings GROUP BY 1, 2),
l AS (SELECT DISTINCT sensor, CASE WHEN sensor LIKE 'click%' THEN 45.0 ELSE 10.0 END AS mean_lo, 60.0 AS mean_hi FROM readings)
SELECT site_id, sensor, round(mean, 6) AS mean, round(std, 6) AS std, CAST(mean_lo AS DOUBLE) AS mean_lo,
       CAST(mean_hi AS DOUBLE) AS mean_hi, NOT (mean BETWEEN mean_lo AND mean_hi) AS mean_out_of_range,
       std < 0.001 AS low_variance
FROM a LEFT JOIN l USING (sensor)""",
)
def mean_limits(spark, sf):
    r = readings(spark, sf)
    limits = r.select("sensor").distinct().select(
        "sensor",
        F.when(F.col("sensor").startswith("click"), 45.0).otherwise(10.0).alias("mean_lo"),
        F.lit(60.0).alias("mean_hi"),
    )
    return quality.distribution_warnings(r, limits).withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query(
    "iqr_outliers",
    f"""
WITH {READINGS}, q AS (
  SELECT site_id, sensor, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY 1, 2)
SELECT r.site_id, r.sensor, r.row_no, r.value, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper,
       r.value < q1 - 1.5 * (q3 - q1) OR r.value > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM readings r JOIN q USING (site_id, sensor)""",
)
def iqr_outliers(spark, sf):
    r = readings(spark, sf).select("site_id", "sensor", "row_no", "value")
    return quality.iqr_outliers(r).withColumn("lower", r6("lower")).withColumn("upper", r6("upper"))


@query(
    "sketched_quantiles",
    f"""
WITH {READINGS}
SELECT site_id, sensor, count(value) AS n, true AS p05, true AS p50, true AS p95
FROM readings WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2""",
)
def sketched_quantiles(spark, sf):
    """Quantiles of two weeks from sketches per series and day, and whether their ranks, counted over all rows, keep to the bound."""
    r = readings(spark, sf).select("site_id", "sensor", "ts", "value")
    keys, probs = ["site_id", "sensor"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    first, last = date(2024, 1, 8), date(2024, 1, 21)
    found = sketches.quantiles_of(sketches.merged(sketches.day_sketches(r, keys, "value"), keys, first, last), keys, probs)
    window = r.where(F.col("ts").cast("date").between(F.lit(first), F.lit(last)))
    errors = sketches.rank_errors(window, keys, "value", found.drop("n"), probs)
    # A bound at 99 % confidence for one quantile; three times as wide holds for all of a table.
    most = 3 * sketches.rank_error() + 1 / F.col("n")
    return errors.join(found.select(*keys, "n"), keys).select(*keys, "n", *[(F.col(p) <= most).alias(p) for p in probs])


@query(
    "leakage_excluded",
    """
SELECT o_orderpriority, count(*) AS n_excluded, min(o_orderdate) AS first_excluded, max(o_orderdate) AS last_excluded
FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30' GROUP BY 1""",
)
def leakage_excluded(spark, sf):
    return guarded.split_leakage(table(spark, sf, "orders"), datetime(1996, 6, 30), ["o_orderpriority"], "o_orderdate")[1]


@query(
    "guarded_write",
    f"""
WITH {READINGS}
SELECT count(*) AS rows_in, count(*) FILTER (WHERE value > 180) AS invalid_rows, count(value) AS complete_rows,
       count(*) FILTER (WHERE value IS NULL) AS lacking_value, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS rows_after_cutoff,
       count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20' OR ts IS NULL) AS rows_committed
FROM readings""",
)
def guarded_write(spark, sf):
    """A batch written once under three guards, its measures, and the rows that readers then see."""
    path = f"{shared_folder(spark)}/guarded-{uuid.uuid4().hex}"
    guards = [
        guarded.invalid_share(F.col("value") > 180, 0.9),
        guarded.minimum_samples([], "value", 1),
        guarded.no_leakage(datetime(2024, 1, 20), exclude=True),
    ]
    done = guarded.write_guarded(readings(spark, sf).select("site_id", "sensor", "ts", "value"), path, guards)
    names = ["rows_in", "invalid_rows", "complete_rows", "lacking_value", "rows_after_cutoff"]
    committed = guarded.read_committed(spark, path).agg(F.count("*").alias("rows_committed"))
    return committed.select(*[F.lit(done.metrics[n]).cast("bigint").alias(n) for n in names], "rows_committed")


@query(
    "affinity_check",
    f"""
WITH {METERS}, r AS (SELECT *, CASE WHEN hz > 0 THEN kw / pow(hz, 3) END AS ratio FROM meters),
m AS (SELECT asset, median(ratio) AS med FROM r GROUP BY 1)
SELECT asset, run, line, round(ratio, 6) AS affinity_ratio, round(med, 6) AS median_ratio,
       abs(ratio - med) / med > 0.20 AS affinity_law_invalid
FROM r JOIN m USING (asset)""",
)
def affinity_check(spark, sf):
    m = meters(spark, sf).select("asset", "run", "line", "hz", "kw")
    out = quality.affinity_check(m, "hz", "kw", ["asset"])
    return out.select("asset", "run", "line", r6("affinity_ratio"), r6("median_ratio"), "affinity_law_invalid")


_WB = """temp * atan(0.151977 * sqrt(rh + 8.313659)) + atan(temp + rh) - atan(rh - 1.676331)
       + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035"""


@query("wet_bulb", f"WITH {METERS} SELECT run, line, round({_WB}, 6) AS wet_bulb FROM meters")
def wet_bulb(spark, sf):
    return meters(spark, sf).select("run", "line", r6(physics.wet_bulb("temp", "rh"), "wet_bulb"))


@query(
    "wet_bulb_guarded",
    f"""
WITH {METERS}, w AS (SELECT run, line, rh, hz * 1.5 AS temp FROM meters)
SELECT run, line, CASE WHEN temp BETWEEN -40 AND 60 AND rh BETWEEN 0 AND 100 THEN round({_WB}, 6) END AS wet_bulb FROM w""",
)
def wet_bulb_guarded(spark, sf):
    w = meters(spark, sf).withColumn("temp", F.col("hz") * 1.5)
    return w.select("run", "line", r6(physics.wet_bulb_guarded("temp", "rh"), "wet_bulb"))


@query(
    "enthalpy",
    f"""
WITH {METERS} SELECT run, line, round(1.006 * temp + (rh / 5000.0) * (2501.0 + 1.86 * temp), 6) AS enthalpy FROM meters""",
)
def enthalpy(spark, sf):
    return meters(spark, sf).select("run", "line", r6(physics.enthalpy("temp", F.col("rh") / 5000.0), "enthalpy"))


_HEAT = """CASE WHEN {calc} IS NULL OR {meas} IS NULL THEN NULL WHEN {meas} = 0 THEN true
            ELSE abs({calc} - {meas}) / {meas} > 0.15 END"""


@query(
    "heat_balance",
    f"""
WITH {PLANT}, h AS (SELECT *, pump_hz * (temp - fan_hz) / 24.0 AS calc FROM plant)
SELECT site_id, ts, round(calc, 6) AS rt_calculated, {_HEAT.format(calc='calc', meas='load_rt')} AS heat_balance_invalid
FROM h""",
)
def heat_balance(spark, sf):
    return plant(spark, sf).select(
        "site_id",
        "ts",
        r6(physics.cooling_tons("pump_hz", "temp", "fan_hz"), "rt_calculated"),
        physics.heat_balance_invalid("pump_hz", "temp", "fan_hz", "load_rt").alias("heat_balance_invalid"),
    )


@query(
    "heat_balance_si",
    f"""
WITH {PLANT}, c AS (
  SELECT site_id, ts, pump_hz * 3.78541 AS flow, (temp - 32.0) * 5.0 / 9.0 AS t_in, (fan_hz - 32.0) * 5.0 / 9.0 AS t_out, power_kw
  FROM plant),
h AS (SELECT *, flow * (t_in - t_out) * (4.2174 + ((t_in + t_out) / 2.0) * (-0.0037 + ((t_in + t_out) / 2.0) * 0.00009)) / 60.0 AS q FROM c)
SELECT site_id, ts, round(q, 6) AS cooling_kw, {_HEAT.format(calc='q', meas='power_kw')} AS heat_balance_invalid FROM h""",
)
def heat_balance_si(spark, sf):
    p = plant(spark, sf).select(
        "site_id",
        "ts",
        physics.gpm_to_lpm("pump_hz").alias("flow"),
        physics.fahrenheit_to_celsius("temp").alias("t_in"),
        physics.fahrenheit_to_celsius("fan_hz").alias("t_out"),
        "power_kw",
    )
    return p.select(
        "site_id",
        "ts",
        r6(physics.cooling_kw("flow", "t_in", "t_out"), "cooling_kw"),
        physics.heat_balance_invalid_si("flow", "t_in", "t_out", "power_kw").alias("heat_balance_invalid"),
    )


@query(
    "clean_readings",
    f"""
WITH {PLANT}, w AS (
  SELECT *, count(power_kw) OVER f6 = 6 AND stddev_samp(power_kw) OVER f6 < 20 AS kw_frozen,
         count(temp) OVER f6 = 6 AND stddev_samp(temp) OVER f6 < 20 AS temp_frozen,
         CASE WHEN count(load_rt) OVER f3 = 3 THEN
           (max(load_rt) OVER f3 - min(load_rt) OVER f3) / ((max(load_rt) OVER f3 + min(load_rt) OVER f3) / 2.0 + 1e-6) * 100.0 END AS chg,
         pump_hz * (temp - fan_hz) / 24.0 AS calc, CASE WHEN pump_hz > 0 THEN power_kw / pow(pump_hz, 3) END AS ratio
  FROM plant WINDOW f6 AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
    f3 AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
m AS (SELECT site_id, median(ratio) AS med FROM w GROUP BY 1)
SELECT w.site_id, ts, round(load_rt, 6) AS load_rt, round(power_kw, 6) AS power_kw,
       coalesce(kw_frozen, false) AS power_kw_frozen, coalesce(temp_frozen, false) AS temp_frozen
FROM w LEFT JOIN m ON w.site_id = m.site_id
WHERE NOT coalesce(CASE WHEN calc IS NULL OR load_rt IS NULL THEN NULL WHEN load_rt = 0 THEN true
                   ELSE abs(calc - load_rt) / load_rt > 3 END, false)
  AND coalesce(chg <= 120, true)
  AND NOT coalesce(abs(ratio - med) / med > 5, false)""",
)
def clean_readings(spark, sf):
    from plantspark.plans.cleaning import CleanOptions, clean_wide

    opt = CleanOptions(
        interval_minutes=60,
        slice_seconds=HOURLY_SLICE,
        frozen_threshold=20.0,
        load="load_rt",
        steady_minutes=180,
        steady_pct=120.0,
        heat=("pump_hz", "temp", "fan_hz"),
        heat_tolerance=3.0,
        affinity=("pump_hz", "power_kw"),
        affinity_tolerance=5.0,
        drop_invalid=True,
    )
    out = clean_wide(plant(spark, sf), opt)
    return out.select("site_id", "ts", r6("load_rt"), r6("power_kw"), "power_kw_frozen", "temp_frozen")


@query(
    "clean_every_point",
    f"""
WITH {PLANT}, p AS (SELECT site_id, ts, load_rt, power_kw, pump_hz, temp, fan_hz AS rh FROM plant),
b AS (SELECT *, {_WB} AS wb, CASE WHEN pump_hz > 0 THEN power_kw / pow(pump_hz, 3) END AS ratio FROM p),
w AS (
  SELECT *, count(power_kw) OVER f6 = 6 AND stddev_samp(power_kw) OVER f6 < 40 AS kw_frozen,
         count(wb) OVER f6 = 6 AND stddev_samp(wb) OVER f6 < 40 AS wb_frozen,
         CASE WHEN count(load_rt) OVER f3 = 3 THEN
           (max(load_rt) OVER f3 - min(load_rt) OVER f3) / ((max(load_rt) OVER f3 + min(load_rt) OVER f3) / 2.0 + 1e-6) * 100.0 END AS chg
  FROM b WINDOW f6 AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
    f3 AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
m AS (SELECT site_id, median(ratio) AS med FROM b GROUP BY 1)
SELECT w.site_id, ts, round(load_rt, 6) AS ch_0_rt, round(power_kw, 6) AS pump_kw, round(wb, 6) AS temp_wb_out,
       coalesce(kw_frozen, false) AS kw_frozen, coalesce(wb_frozen, false) AS wb_frozen, coalesce(chg <= 60, true) AS is_steady,
       abs(ratio - med) / med > 0.8 AS affinity_law_invalid
FROM w LEFT JOIN m ON w.site_id = m.site_id""",
)
def clean_every_point(spark, sf):
    """The whole chain from long readings without a sensor map: resample, wet bulb, frozen, steady, pump columns found by name."""
    from plantspark.plans.cleaning import CleanOptions, clean

    names = {"signup": "CH-0.RT", "purchase": "pump_kw", "view": "pump_hz", "click": "rh_out", "error": "temp_db_out"}
    sensor = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    r = readings(spark, sf).withColumn("sensor", sensor)
    opt = CleanOptions(
        interval_minutes=60, frozen_threshold=40.0, load="CH_0_RT", steady_minutes=180, steady_pct=60.0, affinity="auto", affinity_tolerance=0.8
    )
    out = clean(r, None, opt)
    return out.select(
        "site_id",
        "ts",
        r6("CH_0_RT", "ch_0_rt"),
        r6("pump_kw"),
        r6("temp_wb_out"),
        F.col("pump_kw_frozen").alias("kw_frozen"),
        F.col("temp_wb_out_frozen").alias("wb_frozen"),
        F.col("is_steady_state").alias("is_steady"),
        "affinity_law_invalid",
    )


@query(
    "plant_kpis",
    f"""
WITH {PLANT}
SELECT site_id, ts, round(load_rt * 3.517 / nullif(power_kw, 0), 6) AS cop, round(power_kw / nullif(load_rt, 0), 6) AS kw_per_rt,
       round(temp - fan_hz, 6) AS delta_t, round(pump_hz - temp, 6) AS tower_approach, round(power_kw - pump_hz, 6) AS tower_range
FROM plant""",
)
def plant_kpis(spark, sf):
    k = physics.plant_indicators("load_rt", "power_kw", "temp", "fan_hz", "power_kw", "pump_hz", "temp")
    return plant(spark, sf).select("site_id", "ts", *[r6(v, n) for n, v in k.items()])


@query(
    "unit_scrub",
    r"""
SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^0-9.\-eE]', '', 'g'), '') AS DOUBLE) AS number,
       TRY_CAST(nullif(regexp_replace(event_type || ' ' || CAST(event_id AS VARCHAR) || ' kW', '[^0-9.\-eE]', '', 'g'), '') AS DOUBLE) AS label_number
FROM events""",
)
def unit_scrub(spark, sf):
    label = F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" kW"))
    return table(spark, sf, "events").select(
        "event_id", scrub_number("props").alias("number"), scrub_number(label).alias("label_number")
    )


@query(
    "unit_convert",
    f"""
WITH {METERS}, u AS (
  SELECT run, line, kw AS value, CASE line % 3 WHEN 0 THEN 'GPM' WHEN 1 THEN 'F' ELSE 'kW' END AS unit FROM meters)
SELECT run, line, CASE unit WHEN 'GPM' THEN 'LPM' WHEN 'F' THEN 'C' ELSE unit END AS unit,
       round(CASE unit WHEN 'GPM' THEN value * 3.78541 WHEN 'F' THEN (value - 32.0) * 5.0 / 9.0 ELSE value END, 4) AS value
FROM u""",
)
def unit_convert(spark, sf):
    unit = F.when(F.col("line") % 3 == 0, "GPM").when(F.col("line") % 3 == 1, "F").otherwise("kW")
    m = meters(spark, sf).withColumn("unit", unit)
    return m.select(
        "run", "line", physics.si_unit("unit").alias("unit"), F.round(physics.to_si("kw", "unit"), 4).alias("value")
    )


@query(
    "to_utc",
    """
SELECT event_id, ts - INTERVAL 8 HOUR AS taipei_utc,
       CASE WHEN ts < TIMESTAMP '2024-03-10 02:00:00' THEN ts + INTERVAL 5 HOUR ELSE ts + INTERVAL 4 HOUR END AS new_york_utc
FROM events""",
)
def utc(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", to_utc("ts").alias("taipei_utc"), to_utc("ts", "America/New_York").alias("new_york_utc")
    )


@query(
    "future_guard",
    f"""
WITH {READINGS}, bad AS (
  SELECT source_file || '_' || sensor AS source_file, count(*) AS n_future, max(ts) AS last_ts FROM readings
  WHERE ts > TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 5 MINUTE GROUP BY 1),
ok AS (SELECT source_file || '_' || sensor AS source_file, count(*) AS n FROM readings
       WHERE source_file || '_' || sensor NOT IN (SELECT source_file FROM bad) GROUP BY 1)
SELECT source_file, n_future, last_ts, CAST(0 AS BIGINT) AS n_accepted FROM bad
UNION ALL SELECT source_file, 0, NULL, n FROM ok""",
)
def future_guard(spark, sf):
    r = readings(spark, sf).withColumn("source_file", F.concat_ws("_", "source_file", "sensor"))
    ok, bad = quality.split_future(r, datetime(2024, 1, 30, 12))
    none = F.lit(0).cast("long")
    kept = ok.groupBy("source_file").agg(
        none.alias("n_future"), F.lit(None).cast("timestamp_ntz").alias("last_ts"), F.count(F.lit(1)).alias("n_accepted")
    )
    return bad.withColumn("n_accepted", none).unionByName(kept)


@query(
    "bad_timestamps",
    """
SELECT o_orderkey, o_orderdate FROM orders
WHERE year(o_orderdate) < 1993 OR abs(date_diff('day', DATE '1995-06-15', CAST(o_orderdate AS DATE))) > 900""",
)
def bad_timestamps(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return quality.implausible_timestamps(o, datetime(1995, 6, 15), min_year=1993, max_days=900, ts="o_orderdate")


@query(
    "complete_cases",
    f"""
WITH {PLANT}
SELECT site_id, ts, round(load_rt, 6) AS load_rt, round(power_kw, 6) AS power_kw FROM plant
WHERE load_rt IS NOT NULL AND power_kw IS NOT NULL AND pump_hz IS NOT NULL""",
)
def complete_cases(spark, sf):
    c = quality.complete_cases(plant(spark, sf), ["load_rt", "power_kw", "pump_hz"])
    return c.select("site_id", "ts", r6("load_rt"), r6("power_kw"))


@query(
    "null_top5",
    f"""
WITH {PLANT}
SELECT feature, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT count(*) - count(load_rt) AS load_rt, count(*) - count(power_kw) AS power_kw, count(*) - count(pump_hz) AS pump_hz,
         count(*) - count(fan_hz) AS fan_hz, count(*) - count(temp) AS temp, 0 AS ts FROM plant) n
UNPIVOT (null_count FOR feature IN (load_rt, power_kw, pump_hz, fan_hz, temp, ts))
ORDER BY null_count DESC, feature LIMIT 5""",
)
def null_top5(spark, sf):
    return quality.null_counts(plant(spark, sf), ["load_rt", "power_kw", "pump_hz", "fan_hz", "temp", "ts"])


@query(
    "batch_stats",
    f"""
WITH {PLANT}
SELECT count(*) AS total_rows, CAST(7 AS BIGINT) AS total_cols, min(ts) AS start_ts, max(ts) AS end_ts,
       round((6 * count(*) - count(load_rt) - count(power_kw) - count(pump_hz) - count(fan_hz) - count(temp) - count(*))::DOUBLE
             / (7.0 * count(*)), 6) AS null_share, count(DISTINCT site_id) AS files_count
FROM plant""",
)
def batch_stats(spark, sf):
    return quality.batch_stats(plant(spark, sf), file="site_id").withColumn("null_share", r6("null_share"))


@query(
    "cleaning_report",
    f"""
WITH {PLANT}, w AS (
  SELECT *, CASE WHEN count(load_rt) OVER f = 3 THEN
      (max(load_rt) OVER f - min(load_rt) OVER f) / ((max(load_rt) OVER f + min(load_rt) OVER f) / 2.0 + 1e-6) * 100.0 END AS chg,
    pump_hz * (temp - fan_hz) / 24.0 AS calc
  FROM plant WINDOW f AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT count(*) AS rows_in, CAST(sum(CASE WHEN temp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS rows_filled,
       CAST(sum(CASE WHEN abs(calc - load_rt) / load_rt > 0.15 THEN 1 ELSE 0 END) AS BIGINT) AS rows_failed,
       round(avg(CASE WHEN coalesce(chg <= 60, true) THEN 1.0 ELSE 0.0 END), 6) AS steady_share
FROM w""",
)
def cleaning_report(spark, sf):
    s = quality.steady_state(plant(spark, sf), "load_rt", HOURLY_SLICE, 180, 60, 60.0)
    rep = quality.cleaning_report(
        s,
        F.col("temp").isNull(),
        physics.heat_balance_invalid("pump_hz", "temp", "fan_hz", "load_rt"),
        F.col("is_steady_state"),
    )
    return rep.withColumn("steady_share", r6("steady_share"))


@query(
    "circuit_breaker",
    f"""
WITH {PLANT}, s AS (
  SELECT count(*) AS total_rows, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS invalid_rows,
         avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS share
  FROM (SELECT coalesce(abs(pump_hz * (temp - fan_hz) / 24.0 - load_rt) / load_rt > 0.15, false) AS bad FROM plant))
SELECT total_rows, invalid_rows, round(share, 6) AS invalid_share, share > 0.3 AS tripped FROM s""",
)
def circuit_breaker(spark, sf):
    s = quality.invalid_share(plant(spark, sf), physics.heat_balance_invalid("pump_hz", "temp", "fan_hz", "load_rt"))
    return s.withColumn("tripped", F.col("invalid_share") > 0.3).withColumn("invalid_share", r6("invalid_share"))


_FLAGGED = f"""{HOURLY}, w AS (
  SELECT *, coalesce(count(value) OVER f = 3 AND stddev_samp(value) OVER f < 10, false) AS frozen FROM hourly
  WINDOW f AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
flagged AS (SELECT site_id, sensor, ts, value,
  list_concat(CASE WHEN frozen THEN ['FROZEN'] ELSE [] END, CASE WHEN value > 150 THEN ['OUTLIER'] ELSE [] END,
              CASE WHEN n_readings > 2 THEN ['HAND_MADE'] ELSE [] END) AS fl FROM w)"""


def _flagged(spark, sf):
    f = quality.frozen_flags(hourly(spark, sf), HOURLY_SLICE, window=3, threshold=10.0)
    rules = {"FROZEN": F.col("is_frozen"), "OUTLIER": F.col("value") > 150, "HAND_MADE": F.col("n_readings") > 2}
    return flags.with_flags(f, rules)


@query(
    "flag_filters",
    f"""
WITH {_FLAGGED}
SELECT site_id, sensor, ts, round(value, 6) AS value FROM flagged WHERE len(fl) = 0""",
)
def flag_filters(spark, sf):
    clean = flags.drop_flagged(_flagged(spark, sf).withColumn("device_role", F.lit("primary")))
    return flags.sanitise_columns(clean).select("site_id", "sensor", "ts", r6("value"))


@query(
    "flag_one_hot",
    f"""
WITH {_FLAGGED}
SELECT site_id, sensor, ts, array_to_string(fl, ',') AS flags, CAST(list_contains(fl, 'FROZEN') AS INTEGER) AS flag_frozen,
       CAST(list_contains(fl, 'OUTLIER') AS INTEGER) AS flag_outlier
FROM flagged""",
)
def flag_one_hot(spark, sf):
    hot = flags.one_hot(_flagged(spark, sf), ["FROZEN", "OUTLIER"])
    return hot.select("site_id", "sensor", "ts", F.array_join("quality_flags", ",").alias("flags"), "flag_frozen", "flag_outlier")


@query(
    "flag_vocabulary",
    f"""
WITH {_FLAGGED}
SELECT flag, count(*) AS n_rows FROM (SELECT unnest(fl) AS flag FROM flagged) WHERE flag NOT IN ('FROZEN', 'OUTLIER') GROUP BY 1""",
)
def flag_vocabulary(spark, sf):
    return flags.unknown_flags(_flagged(spark, sf))
