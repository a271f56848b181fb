"""The cleaning chain: resample, wet bulb, frozen, steady, heat balance, affinity, filter."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions import physics
from plantspark.operators import quality
from plantspark.operators.resample import keep_first, resample, to_wide
from plantspark.operators.sensors import pump_columns_of
from plantspark.plans.ordered import chunk_of, windowed
from plantspark.sources.reports import read_reports


@dataclass(frozen=True)
class CleanOptions:
    """Which steps run and on which columns; a step without columns is skipped."""

    interval_minutes: int = 5
    #: Length of the slices that ordered checks work on; None measures slices of equal row counts.
    slice_seconds: int | None = None
    frozen_window: int = 6
    frozen_threshold: float = 0.001
    frozen_columns: Sequence[str] | None = None
    wet_bulb: tuple[str, str] = ("temp_db_out", "rh_out")
    load: str | None = None
    steady_minutes: int = 15
    steady_pct: float = 5.0
    heat: tuple[str, str, str] | None = None
    heat_tolerance: float = 0.15
    #: Frequency and power column of a pump, or ``auto``: the first of either found by name.
    affinity: tuple[str, str] | str | None = None
    affinity_tolerance: float = 0.20
    drop_invalid: bool = False


def frozen_candidates(columns: Sequence[str]) -> list[str]:
    """Columns checked for frozen values by default: every name with ``kw`` or ``temp`` in it."""
    return [c for c in columns if "kw" in c.lower() or "temp" in c.lower()]


def clean_wide(df: DataFrame, opt: CleanOptions, site: Sequence[str] = ("site_id",), ts: str = "ts") -> DataFrame:
    """Check a resampled wide table. Frozen and steady checks share one window pass."""
    t, h = opt.wet_bulb
    if t in df.columns and h in df.columns:
        df = df.withColumn("temp_wb_out", physics.wet_bulb(t, h))
    checked = opt.frozen_columns if opt.frozen_columns is not None else frozen_candidates(df.columns)
    exprs = {}
    for c in checked:

        def frozen(w, c=c):
            frame = w.rowsBetween(-(opt.frozen_window - 1), 0)
            full = F.count(c).over(frame) == opt.frozen_window
            return F.coalesce(full & (F.stddev_samp(c).over(frame) < opt.frozen_threshold), F.lit(False))

        exprs[f"{c}_frozen"] = frozen
    lookback = opt.frozen_window - 1
    if opt.load and opt.load in df.columns:
        n = max(1, opt.steady_minutes // opt.interval_minutes)
        lookback = max(lookback, n - 1)

        def steady(w):
            frame = w.rowsBetween(-(n - 1), 0)
            lo, hi = F.min(opt.load).over(frame), F.max(opt.load).over(frame)
            pct = F.try_divide(hi - lo, (hi + lo) / 2.0 + 1e-6) * 100.0
            return F.coalesce(F.when(F.count(opt.load).over(frame) == n, pct) <= opt.steady_pct, F.lit(True))

        exprs["is_steady_state"] = steady
    if exprs:
        df = windowed(df, list(site), [ts], lookback, exprs, chunk_of(df, list(site), [ts], opt.slice_seconds))
    if opt.load and opt.load not in df.columns:
        df = df.withColumn("is_steady_state", F.lit(True))
    if opt.heat and opt.load:
        df = df.withColumn("heat_balance_invalid", physics.heat_balance_invalid(*opt.heat, opt.load, opt.heat_tolerance))
    pump = pump_columns_of(df.columns) if opt.affinity == "auto" else opt.affinity
    if pump:
        df = quality.affinity_check(df, *pump, list(site), opt.affinity_tolerance)
    return quality.drop_invalid(df) if opt.drop_invalid else df


def sensor_columns(readings: DataFrame, sensors: dict[str, str] | None) -> dict[str, str]:
    """Column of every sensor of ``readings``, by name: the mapped ones as mapped, the others under their own name.

    Signs that a column name cannot hold become ``_``; a name that is taken gets a number. The names of the points, as many as a
    site has, reach the driver; a mapped sensor without readings keeps its column.
    """
    found = sorted(r.sensor for r in readings.select("sensor").where("sensor IS NOT NULL").distinct().collect())
    out = dict(sensors or {})
    taken = {c.lower() for c in out.values()} | {"site_id", "ts"}
    for name in found:
        if name in out:
            continue
        plain = column = re.sub(r"[^\w]", "_", name) or "_"
        n = 1
        while column.lower() in taken:
            n += 1
            column = f"{plain}_{n}"
        taken.add(column.lower())
        out[name] = column
    return out


def clean(
    readings: DataFrame,
    sensors: dict[str, str] | None = None,
    opt: CleanOptions | None = None,
    site: Sequence[str] = ("site_id",),
    ts: str = "ts",
    keep_rest: bool = False,
) -> DataFrame:
    """Long readings to a checked wide table: resample by sensor kind, pivot, then :func:`clean_wide`.

    ``sensors`` maps sensor to column; only those are read, or with ``keep_rest``, or without a map, all (see
    :func:`sensor_columns`).
    """
    opt = opt or CleanOptions()
    columns = sensor_columns(readings, sensors) if keep_rest or sensors is None else sensors
    wanted = readings.where(F.col("sensor").isin(list(columns)))
    small = resample(wanted, f"{opt.interval_minutes} minutes", keys=[*site, "sensor"], ts=ts)
    return clean_wide(to_wide(small, columns, [*site, ts]), opt, site, ts)


def process_directory(
    spark: SparkSession,
    path: str,
    sensors: dict[str, str] | None = None,
    opt: CleanOptions | None = None,
    pattern: str = "*.csv",
    site_id: str = "site",
    keep_rest: bool = False,
    **reader,
) -> tuple[DataFrame, DataFrame]:
    """All reports of a folder as one checked wide table, and the files that gave no readings.

    Each file is resampled on its own; where files overlap, the first by name keeps the window.
    Checks that look at earlier rows then run over the merged series. ``sensors`` and ``keep_rest`` as in :func:`clean`:
    without a map every point becomes a column, and with ``affinity="auto"`` the pump is found by name.
    """
    opt = opt or CleanOptions()
    readings, errors = read_reports(spark, path, site_id, glob=pattern, **reader)
    columns = sensor_columns(readings, sensors) if keep_rest or sensors is None else sensors
    wanted = readings.where(F.col("sensor").isin(list(columns)))
    keys = ["site_id", "source_file", "sensor"]
    small = resample(wanted, f"{opt.interval_minutes} minutes", keys=keys)
    merged = keep_first(small, ["site_id", "sensor", "ts"], ["source_file"])
    return clean_wide(to_wide(merged, columns), opt), errors
