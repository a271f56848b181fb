"""Queries over single series: resampling, gaps, frozen and steady data, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.functions.timefx import bucket_start, calendar_features, cyclic_features
from plantspark.operators import features, quality
from plantspark.operators import resample as rs
from plantspark.plans.rolling import rolling_blocks
from plantspark.plans.slices import fit_slices
from plantspark.queries.registry import (
    HOURLY,
    HOURLY_SLICE,
    PLANT,
    READINGS,
    hourly,
    plant,
    query,
    r6,
    readings,
    table,
)

KIND_NAME = {"purchase": "METER_KWH", "error": "FAULT", "click": "RUN_S"}

KINDS = """kinds AS (
  SELECT 'site_' || (user_id % 2) AS site_id,
         'u' || (user_id % 5) || '_' || CASE event_type WHEN 'purchase' THEN 'METER_KWH' WHEN 'error' THEN 'FAULT'
           WHEN 'click' THEN 'RUN_S' ELSE upper(event_type) END AS sensor,
         event_id AS row_no, ts, value
  FROM events)"""


def kinds(spark, sf):
    kind = F.upper("event_type")
    for e, n in KIND_NAME.items():
        kind = F.when(F.col("event_type") == e, F.lit(n)).otherwise(kind)
    return table(spark, sf, "events").select(
        F.concat(F.lit("site_"), (F.col("user_id") % 2).cast("string")).alias("site_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"), F.lit("_"), kind).alias("sensor"),
        F.col("event_id").alias("row_no"),
        "ts",
        "value",
    )


@query(
    "resample_by_kind",
    f"""
WITH {KINDS}
SELECT site_id, sensor, date_trunc('hour', ts) AS ts,
       round(CASE WHEN sensor LIKE '%KWH' THEN arg_max(value, ts)
                  WHEN sensor LIKE '%!_S' ESCAPE '!' OR sensor LIKE '%FAULT%' THEN max(value)
                  ELSE avg(value) END, 6) AS value,
       count(value) AS n_readings
FROM kinds GROUP BY 1, 2, 3""",
)
def resample_by_kind(spark, sf):
    return rs.resample(kinds(spark, sf), "1 hour").withColumn("value", r6("value"))


@query(
    "resample_agg_map",
    f"""
WITH {READINGS}
SELECT site_id, sensor, date_trunc('day', ts) AS ts,
       round(CASE WHEN sensor LIKE 'click%' THEN sum(value) WHEN sensor LIKE 'view%' THEN arg_min(value, ts)
                  WHEN sensor LIKE 'error%' THEN arg_max(value, ts) ELSE avg(value) END, 6) AS value,
       count(value) AS n_readings
FROM readings GROUP BY 1, 2, 3""",
)
def resample_agg_map(spark, sf):
    r = readings(spark, sf)
    s = F.col("sensor")
    method = F.when(s.startswith("click"), "sum").when(s.startswith("view"), "first").when(s.startswith("error"), "last")
    dim = r.select("sensor").distinct().withColumn("agg_method", method)
    return rs.resample_with(r, dim, "1 day").withColumn("value", r6("value"))


@query(
    "gap_fill",
    f"""
WITH {HOURLY}, spine AS (
  SELECT site_id, sensor, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY 1, 2)
SELECT s.site_id, s.sensor, s.ts, round(h.value, 6) AS value,
       CASE WHEN h.ts IS NULL THEN 'INSUFFICIENT_DATA' ELSE '' END AS quality_flags
FROM spine s LEFT JOIN hourly h USING (site_id, sensor, ts)""",
)
def gap_fill(spark, sf):
    g = rs.gap_fill(hourly(spark, sf), "1 HOUR", HOURLY_SLICE)
    return g.select("site_id", "sensor", "ts", r6("value"), F.array_join("quality_flags", ",").alias("quality_flags"))


@query(
    "sensor_offline",
    f"""
WITH {HOURLY}, spine AS (
  SELECT site_id, sensor, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY 1, 2),
filled AS (SELECT s.*, h.value FROM spine s LEFT JOIN hourly h USING (site_id, sensor, ts))
SELECT site_id, sensor, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, count(value) AS n_valid,
       count(*) AS n_slots, count(value) = 0 AS is_offline
FROM filled GROUP BY 1, 2, 3""",
)
def sensor_offline(spark, sf):
    return rs.offline_windows(rs.gap_fill(hourly(spark, sf), "1 HOUR", HOURLY_SLICE), "6 hours")


@query(
    "frozen_flags",
    f"""
WITH {HOURLY}, w AS (
  SELECT *, CASE WHEN count(value) OVER f = 6 THEN stddev_samp(value) OVER f END AS sd FROM hourly
  WINDOW f AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT site_id, sensor, ts, round(value, 6) AS value, round(sd, 6) AS rolling_std, coalesce(sd < 25, false) AS is_frozen
FROM w""",
)
def frozen_flags(spark, sf):
    f = quality.frozen_flags(hourly(spark, sf), HOURLY_SLICE, window=6, threshold=25.0)
    return f.select("site_id", "sensor", "ts", r6("value"), r6("rolling_std"), "is_frozen")


@query(
    "frozen_summary",
    f"""
WITH {HOURLY}, w AS (
  SELECT *, CASE WHEN count(value) OVER f = 3 THEN stddev_samp(value) OVER f END AS sd FROM hourly
  WINDOW f AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT site_id, sensor, count(*) AS n_windows, CAST(sum(CASE WHEN coalesce(sd < 10, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_frozen,
       round(avg(value), 6) AS mean_value
FROM w GROUP BY 1, 2""",
)
def frozen_summary(spark, sf):
    f = quality.frozen_flags(hourly(spark, sf), HOURLY_SLICE, window=3, threshold=10.0)
    return f.groupBy("site_id", "sensor").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum(F.col("is_frozen").cast("long")).alias("n_frozen"),
        r6(F.avg("value"), "mean_value"),
    )


@query(
    "frozen_by_role",
    f"""
WITH {HOURLY}, roles AS (
  SELECT site_id, sensor, ts, floor(value / 100) AS value,
         CASE WHEN right(sensor, 1) IN ('0', '1') THEN 'primary' WHEN right(sensor, 1) IN ('2', '3') THEN 'backup'
              ELSE 'seasonal' END AS device_role
  FROM hourly)
SELECT site_id, sensor, ts, value, device_role, coalesce(
  CASE device_role
    WHEN 'primary' THEN count(value) OVER a = 2 AND min(value) OVER a = max(value) OVER a
    WHEN 'seasonal' THEN count(value) OVER b = 4 AND min(value) OVER b = max(value) OVER b
    ELSE count(value) OVER c = 6 AND min(value) OVER c = max(value) OVER c END, false) AS is_frozen
FROM roles WINDOW a AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY site_id, sensor ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def frozen_by_role(spark, sf):
    last = F.substring("sensor", -1, 1)
    roles = hourly(spark, sf).select(
        "site_id",
        "sensor",
        "ts",
        F.floor(F.col("value") / 100).cast("double").alias("value"),
        F.when(last.isin("0", "1"), "primary").when(last.isin("2", "3"), "backup").otherwise("seasonal").alias("device_role"),
    )
    return quality.frozen_by_role(roles, HOURLY_SLICE, base=2)


@query(
    "steady_state",
    f"""
WITH {PLANT}, w AS (
  SELECT *, count(load_rt) OVER f AS n, min(load_rt) OVER f AS lo, max(load_rt) OVER f AS hi FROM plant
  WINDOW f AS (PARTITION BY site_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT site_id, ts, round(load_rt, 6) AS load_rt,
       coalesce(CASE WHEN n = 3 THEN (hi - lo) / ((hi + lo) / 2.0 + 1e-6) * 100.0 END <= 60, true) AS is_steady_state
FROM w""",
)
def steady_state(spark, sf):
    s = quality.steady_state(plant(spark, sf), "load_rt", HOURLY_SLICE, window_minutes=180, interval_minutes=60, max_change_pct=60.0)
    return s.select("site_id", "ts", r6("load_rt"), "is_steady_state")


@query(
    "dedup_first",
    f"""
WITH {READINGS}, t AS (
  SELECT site_id, sensor, date_trunc('day', ts) AS ts, source_file, row_no, value,
         row_number() OVER (PARTITION BY site_id, sensor, date_trunc('day', ts) ORDER BY source_file, row_no) AS rn
  FROM readings)
SELECT site_id, sensor, ts, source_file, row_no, value FROM t WHERE rn = 1""",
)
def dedup_first(spark, sf):
    r = readings(spark, sf).withColumn("ts", bucket_start("ts", "1 day"))
    return rs.keep_first(r.select("site_id", "sensor", "ts", "source_file", "row_no", "value"))


_W = "PARTITION BY site_id ORDER BY ts"


@query(
    "lag_rolling_features",
    f"""
WITH {PLANT}
SELECT site_id, ts,
       round(lag(load_rt, 1) OVER s, 6) AS load_rt_lag_1, round(lag(load_rt, 3) OVER s, 6) AS load_rt_lag_3,
       round(CASE WHEN count(load_rt) OVER r3 = 3 THEN avg(load_rt) OVER r3 END, 6) AS load_rt_rollmean_3,
       round(CASE WHEN count(load_rt) OVER r3 = 3 THEN max(load_rt) OVER r3 END, 6) AS load_rt_rollmax_3,
       round(lag(pump_hz, 1) OVER s, 6) AS pump_hz_lag_1, round(lag(pump_hz, 3) OVER s, 6) AS pump_hz_lag_3,
       round(CASE WHEN count(pump_hz) OVER r6 = 6 THEN avg(pump_hz) OVER r6 END, 6) AS pump_hz_rollmean_6,
       round(CASE WHEN count(pump_hz) OVER r6 = 6 THEN max(pump_hz) OVER r6 END, 6) AS pump_hz_rollmax_6,
       round(lag(temp, 2) OVER s, 6) AS temp_lag_2,
       round(CASE WHEN count(temp) OVER r4 >= 1 THEN stddev_samp(temp) OVER r4 END, 6) AS temp_rollstd_4,
       round(CASE WHEN count(temp) OVER r4 >= 1 THEN min(temp) OVER r4 END, 6) AS temp_rollmin_4
FROM plant WINDOW s AS ({_W}), r3 AS ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  r4 AS ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), r6 AS ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
)
def lag_rolling_features(spark, sf):
    notes = [
        {"sensor": "load_rt", "physical_type": "load", "device_role": "primary"},
        {"sensor": "pump_hz", "physical_type": "frequency", "device_role": "backup"},
        {"sensor": "power_kw", "physical_type": "load", "device_role": "primary", "is_target": True},
        {"sensor": "temp", "physical_type": "temperature", "device_role": "primary"},
    ]
    policies = [
        features.Policy("Standard", ["load", "frequency"], features.StatsRule((1, 3), (3,), ("mean", "max"))),
        features.Policy("Slow", ["temperature"], features.StatsRule((2,), (4,), ("std", "min"), min_periods=1)),
    ]
    rules = features.resolve_policies(notes, policies)
    out = features.lag_rolling(plant(spark, sf), rules, HOURLY_SLICE, keys=["site_id"])
    names = [c for c in out.columns if "_lag_" in c or "_roll" in c]
    return out.select("site_id", "ts", *[r6(c) for c in names])


@query(
    "wide_rolling_window",
    f"""
WITH {READINGS}
SELECT site_id, row_no, round(CASE WHEN count(value) OVER w = 1200 THEN avg(value) OVER w END, 6) AS value_rollmean_1200
FROM readings WINDOW w AS (PARTITION BY site_id ORDER BY ts, row_no ROWS BETWEEN 1200 PRECEDING AND 1 PRECEDING)""",
)
def wide_rolling_window(spark, sf):
    rules = {"value": features.StatsRule((), (1200,))}
    out = features.lag_rolling(readings(spark, sf), rules, keys=["site_id"], order=["ts", "row_no"])
    return out.select("site_id", "row_no", r6("value_rollmean_1200"))


HOT_HOUR = f"""{READINGS}, hot AS (
  SELECT CASE WHEN row_no % 10 < 6 THEN 'hot' ELSE sensor END AS sensor, site_id, row_no, value,
         CASE WHEN row_no % 10 < 6 THEN TIMESTAMP '2024-01-15 08:00:00' + to_microseconds((row_no * 7919) % 3600000000)
              ELSE ts END AS ts
  FROM readings)"""

#: Rows of a slice and of a block in the queries below: few, so that the smallest tables have many of them.
SMALL_SLICE, SMALL_BLOCK = 400, 150


def hot_hour(spark, sf):
    """Readings of which six in ten belong to one sensor of either site, within one hour."""
    r, hot = readings(spark, sf), F.col("row_no") % 10 < 6
    moved = F.expr("TIMESTAMP_NTZ'2024-01-15 08:00:00' + make_dt_interval(0, 0, 0, ((row_no * 7919) % 3600000000) / 1000000.0)")
    return r.select("site_id", F.when(hot, "hot").otherwise(F.col("sensor")).alias("sensor"), "row_no", "value", F.when(hot, moved).otherwise(F.col("ts")).alias("ts"))


@query(
    "hot_hour_drops",
    f"""
WITH {HOT_HOUR}, d AS (
  SELECT site_id, sensor, value - lag(value) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS diff FROM hot)
SELECT site_id, sensor, count(*) AS n_readings, CAST(sum(CASE WHEN diff < -0.01 THEN 1 ELSE 0 END) AS BIGINT) AS drops_count,
       true AS within_limit
FROM d GROUP BY 1, 2""",
)
def hot_hour_drops(spark, sf):
    """Falls of meters over measured slices, and whether every slice of the series kept to its limit."""
    r = hot_hour(spark, sf)
    cut = fit_slices(r, ["site_id", "sensor"], ["ts", "row_no"], SMALL_SLICE)
    sizes = cut.add(r).groupBy("site_id", "sensor", "_slice").agg(F.count("*").alias("n"))
    within = sizes.groupBy("site_id", "sensor").agg((F.max("n") <= SMALL_SLICE).alias("within_limit"))
    return quality.meter_drops(r, cut).join(within, ["site_id", "sensor"])


@query(
    "hot_hour_rolling",
    f"""
WITH {HOT_HOUR}
SELECT site_id, row_no,
       round(CASE WHEN count(value) OVER w = 700 THEN avg(value) OVER w END, 6) AS value_rollmean_700,
       round(CASE WHEN count(value) OVER w = 700 THEN stddev_samp(value) OVER w END, 6) AS value_rollstd_700,
       round(CASE WHEN count(value) OVER w = 700 THEN min(value) OVER w END, 6) AS value_rollmin_700,
       round(CASE WHEN count(value) OVER w = 700 THEN max(value) OVER w END, 6) AS value_rollmax_700
FROM hot WINDOW w AS (PARTITION BY site_id ORDER BY ts, row_no ROWS BETWEEN 700 PRECEDING AND 1 PRECEDING)""",
)
def hot_hour_rolling(spark, sf):
    """Windows of 700 rows from blocks of 150, over measured slices of 400."""
    r = hot_hour(spark, sf)
    cut = fit_slices(r, ["site_id"], ["ts", "row_no"], SMALL_SLICE)
    wanted = {700: {f"value_roll{a}_700": ("value", a, 700) for a in ("mean", "std", "min", "max")}}
    out = rolling_blocks(r, ["site_id"], ["ts", "row_no"], wanted, cut, SMALL_BLOCK)
    return out.select("site_id", "row_no", *[r6(c) for c in wanted[700]])


@query(
    "time_features",
    f"""
WITH {READINGS}
SELECT row_no, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) AS INTEGER) AS day_of_week,
       CASE WHEN isodow(ts) >= 5 THEN 1 ELSE 0 END AS is_weekend,
       round(sin(2 * pi() * hour(ts) / 24.0), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) AS hour_cos,
       round(sin(2 * pi() * isodow(ts) / 7.0), 6) AS dow_sin, round(cos(2 * pi() * isodow(ts) / 7.0), 6) AS dow_cos
FROM readings""",
)
def time_features(spark, sf):
    cyc = {k: r6(v, k) for k, v in cyclic_features("ts").items()}
    cols = {**calendar_features("ts"), **cyc}
    return readings(spark, sf).select("row_no", *[v.alias(k) for k, v in cols.items()])


@query(
    "meter_monotonic",
    f"""
WITH {READINGS}, d AS (
  SELECT site_id, sensor, value - lag(value) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS diff FROM readings)
SELECT site_id, sensor, count(*) AS n_readings, CAST(sum(CASE WHEN diff < -0.01 THEN 1 ELSE 0 END) AS BIGINT) AS drops_count
FROM d GROUP BY 1, 2""",
)
def meter_monotonic(spark, sf):
    return quality.meter_drops(readings(spark, sf))


@query(
    "long_gaps",
    f"""
WITH {READINGS}, g AS (
  SELECT site_id, sensor, ts, row_no, lag(ts) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS prev_ts FROM readings)
SELECT site_id, sensor, ts, row_no, prev_ts, date_diff('microsecond', prev_ts, ts)::DOUBLE / 60000000::DOUBLE AS gap_minutes
FROM g WHERE date_diff('microsecond', prev_ts, ts) > 3600000000""",
)
def long_gaps(spark, sf):
    return quality.long_gaps(readings(spark, sf))


@query(
    "low_pf_spans",
    f"""
WITH {READINGS}, s AS (
  SELECT *, value / 60.0 < 0.8 AS low FROM readings),
c AS (SELECT *, CASE WHEN low IS NOT DISTINCT FROM lag(low) OVER w THEN 0 ELSE 1 END AS chg FROM s
      WINDOW w AS (PARTITION BY site_id, sensor ORDER BY ts, row_no)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS isle FROM c),
a AS (SELECT site_id, sensor, isle, any_value(low) AS low, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_rows
      FROM g GROUP BY 1, 2, 3)
SELECT site_id, sensor, seg_start, seg_end, n_rows, date_diff('microsecond', seg_start, seg_end)::DOUBLE / 60000000::DOUBLE AS minutes
FROM a WHERE low AND date_diff('microsecond', seg_start, seg_end) > 3600000000""",
)
def low_pf_spans(spark, sf):
    r = readings(spark, sf).withColumn("value", F.col("value") / 60.0)
    return quality.low_power_factor_spans(r)


@query(
    "union_missing_columns",
    """
SELECT 'events' AS origin, ts, value, event_type, CAST(NULL AS VARCHAR) AS o_orderpriority FROM events
UNION ALL SELECT 'orders', o_orderdate, o_totalprice, NULL, o_orderpriority FROM orders
UNION ALL SELECT 'parts', NULL, CAST(p_size AS DOUBLE), NULL, NULL FROM part""",
)
def union_missing_columns(spark, sf):
    e = table(spark, sf, "events").select(F.lit("events").alias("origin"), "ts", "value", "event_type")
    o = table(spark, sf, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderpriority"
    )
    p = table(spark, sf, "part").select(F.lit("parts").alias("origin"), F.col("p_size").alias("value"))
    return rs.union_tables(e, o, p)
