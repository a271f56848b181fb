"""The query registry and the bindings of the driver tables to the plant domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.timefx import bucket_start
from plantspark.operators.resample import resample, to_wide

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Slices of hourly values, 168 rows a week; those of raw readings are measured.
HOURLY_SLICE = 7 * 86_400


#: Added before rounding on both sides: means of two-decimal values often end in an exact 5 at the
#: seventh digit, which Spark (decimal) and DuckDB (binary) round differently.
TIE_SHIFT = 1e-9


def _shift_ties(sql: str) -> str:
    """Write every ``round(x, 6)`` of a statement as ``round(x + TIE_SHIFT, 6)``."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        body = _shift_ties(sql[j + 6 : k - 1])
        if body.endswith(", 6"):
            body = f"({body[:-3]}) + {TIE_SHIFT}, 6"
        out += [sql[i:j], "round(", body, ")"]
        i = k
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = _shift_ties(sql.strip())
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + F.lit(TIE_SHIFT), 6).alias(name or c)


# ------------------------------------------------------------------ bindings


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as sensor readings of two sites."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("site_"), (F.col("user_id") % 2).cast("string")).alias("site_id"),
        F.concat(F.lit("feed_"), F.col("event_type")).alias("source_file"),
        F.col("event_id").alias("row_no"),
        "ts",
        F.concat_ws("_", "event_type", (F.col("user_id") % 5).cast("string")).alias("sensor"),
        "event_type",
        "value",
    )


READINGS = """readings AS (
  SELECT 'site_' || (user_id % 2) AS site_id, 'feed_' || event_type AS source_file, event_id AS row_no, ts,
         event_type || '_' || (user_id % 5) AS sensor, event_type, value
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(readings(spark, sf_dir), "1 hour", F.lit("mean"))


HOURLY = READINGS + """, hourly AS (
  SELECT site_id, sensor, date_trunc('hour', ts) AS ts, avg(value) AS value, count(value) AS n_readings
  FROM readings GROUP BY 1, 2, 3)"""

PLANT_SENSORS = {"signup": "load_rt", "purchase": "power_kw", "view": "pump_hz", "click": "fan_hz", "error": "temp"}


def plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and hour with a column per physical quantity."""
    r = readings(spark, sf_dir).select("site_id", bucket_start("ts", "1 hour").alias("ts"), "event_type", "value")
    return to_wide(r, PLANT_SENSORS, sensor="event_type")


PLANT = READINGS + """, plant AS (
  SELECT site_id, date_trunc('hour', ts) AS ts,
         avg(value) FILTER (WHERE event_type = 'signup') AS load_rt,
         avg(value) FILTER (WHERE event_type = 'purchase') AS power_kw,
         avg(value) FILTER (WHERE event_type = 'view') AS pump_hz,
         avg(value) FILTER (WHERE event_type = 'click') AS fan_hz,
         avg(value) FILTER (WHERE event_type = 'error') AS temp
  FROM readings GROUP BY 1, 2)"""


def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as drive measurements: supplier = asset, quantity = Hz, price = kW."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("asset"),
        F.col("l_orderkey").alias("run"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("hz"),
        F.col("l_extendedprice").alias("kw"),
        (F.col("l_discount") * 1000.0).alias("rh"),
        (F.col("l_tax") * 500.0).alias("temp"),
    )


METERS = """meters AS (
  SELECT l_suppkey AS asset, l_orderkey AS run, l_linenumber AS line, l_shipdate AS ts, l_quantity AS hz,
         l_extendedprice AS kw, l_discount * 1000.0 AS rh, l_tax * 500.0 AS temp
  FROM lineitem)"""
