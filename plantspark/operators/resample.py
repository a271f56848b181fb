"""Fixed-interval resampling, de-duplication, gap filling and the long/wide switch."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.functions.timefx import epoch_micros
from plantspark.plans.joins import key_join
from plantspark.plans.ordered import chunk_of, first_per_key, windowed
from plantspark.plans.slices import Slices
from plantspark.schema import SERIES


#: Windows of a hole that are listed in one step.
HOLE_BLOCK = 10_000


def method_by_name(sensor: Column | str = "sensor") -> Column:
    """Aggregate implied by a sensor name: meters keep the last reading, status and fault points
    the maximum, everything else is averaged."""
    up = F.upper(F.col(sensor) if isinstance(sensor, str) else sensor)
    status = up.rlike("[_.][SF]$") | up.contains("STATUS") | up.contains("FAULT")
    return F.when(up.endswith("KWH"), F.lit("last")).when(status, F.lit("max")).otherwise(F.lit("mean"))


def _row_order(ts: str, row_no: str) -> Column:
    """(ts, row_no) as one decimal, which keeps ``max_by`` inside the hash aggregate."""
    return epoch_micros(ts).cast("decimal(38,0)") * F.lit(Decimal(10**19)) + F.col(row_no)


METHODS = ("sum", "min", "max", "first", "last")


def _window_aggregates(df, every, keys, ts, value, row_no, needs_order: Column) -> DataFrame:
    """Every aggregate of a window at once; all of them combine before the shuffle."""
    v = F.col(value)
    ordered = F.when(needs_order, _row_order(ts, row_no))
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.window(ts, every).alias("_w"))
        .agg(
            F.avg(v).alias("_mean"),
            F.sum(v).alias("_sum"),
            F.min(v).alias("_min"),
            F.max(v).alias("_max"),
            F.min_by(v, ordered).alias("_first"),
            F.max_by(v, ordered).alias("_last"),
            F.count(v).alias("n_readings"),
        )
    )


def _pick(agg: DataFrame, method: Column, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    picked = F.col("_mean")
    for name in METHODS:
        picked = F.when(method == name, F.col(f"_{name}")).otherwise(picked)
    return agg.select(*keys, F.col("_w.start").alias(ts), picked.alias(value), "n_readings")


def resample(
    df: DataFrame,
    every: str,
    method: Column | None = None,
    keys: Sequence[str] = tuple(SERIES),
    ts: str = "ts",
    value: str = "value",
    row_no: str = "row_no",
) -> DataFrame:
    """One row per series and non-empty window (closed left, labelled by its start).

    ``method`` is a Column over ``keys`` naming ``mean``, ``sum``, ``min``, ``max``, ``first`` or
    ``last``; by default it follows the sensor name.
    """
    method = method_by_name("sensor") if method is None else method
    agg = _window_aggregates(df, every, keys, ts, value, row_no, method.isin("first", "last"))
    return _pick(agg, method, keys, ts, value)


def resample_with(
    df: DataFrame,
    dim: DataFrame,
    every: str,
    default: str = "mean",
    keys: Sequence[str] = tuple(SERIES),
    ts: str = "ts",
    value: str = "value",
    row_no: str = "row_no",
) -> DataFrame:
    """Resample with the ``agg_method`` a sensor table names; ``default`` where it has none.

    The sensor table meets the windows, not the readings, so a sensor with very many readings is
    reduced before the join.
    """
    agg = _window_aggregates(df, every, keys, ts, value, row_no, F.lit(True))
    joined = key_join(agg, dim.select("sensor", "agg_method"), ["sensor"])
    return _pick(joined, F.coalesce(F.col("agg_method"), F.lit(default)), keys, ts, value)


def keep_first(
    df: DataFrame, keys: Sequence[str] = (*SERIES, "ts"), order: Sequence[str] = ("source_file", "row_no")
) -> DataFrame:
    """One reading per series and timestamp: the first by file and row."""
    return first_per_key(df, list(keys), list(order))


def gap_fill(
    df: DataFrame,
    every: str,
    slices: int | Slices | None = None,
    keys: Sequence[str] = tuple(SERIES),
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Insert the missing windows of a resampled table as null rows.

    Every row generates the gap in front of it, in blocks, so no spine table and no join are needed. Added
    rows carry the flag ``INSUFFICIENT_DATA`` in ``quality_flags``.
    """
    step = F.expr(f"INTERVAL {every}")
    prev = windowed(
        df.select(*keys, ts, value), keys, [ts], 1, {"_prev": lambda w: F.lag(ts).over(w)}, chunk_of(df, keys, [ts], slices)
    )
    # A hole is cut into blocks of at most HOLE_BLOCK windows, so no array grows with it.
    long = F.expr(f"{HOLE_BLOCK} * INTERVAL {every}")
    first = F.coalesce(F.col("_prev") + step, F.col(ts))
    blocks = prev.withColumn("_from", F.explode(F.sequence(first, F.col(ts), long)))
    grid = blocks.withColumn("_slot", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + long - step, F.col(ts)), step)))
    real = F.col("_slot") == F.col(ts)
    return grid.select(
        *keys,
        F.col("_slot").alias(ts),
        F.when(real, F.col(value)).alias(value),
        F.when(real, F.array().cast("array<string>")).otherwise(F.array(F.lit("INSUFFICIENT_DATA"))).alias("quality_flags"),
    )


def offline_windows(
    df: DataFrame, every: str, keys: Sequence[str] = tuple(SERIES), ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Coarser windows of a gap-filled table without a single valid reading (``SENSOR_OFFLINE``)."""
    return (
        df.groupBy(*keys, F.window(ts, every).alias("_w"))
        .agg(F.count(value).alias("n_valid"), F.count(F.lit(1)).alias("n_slots"))
        .select(
            *keys,
            F.col("_w.start").alias(ts),
            "n_valid",
            "n_slots",
            (F.col("n_valid") == 0).alias("is_offline"),
        )
    )


def to_wide(
    df: DataFrame, sensors: dict[str, str], keys: Sequence[str] = ("site_id", "ts"), sensor: str = "sensor", value: str = "value"
) -> DataFrame:
    """Pivot to one column per sensor; ``sensors`` maps sensor to column name, absent ones are null.

    The list is explicit, so no extra pass looks for the distinct sensors.
    """
    aggs = [F.avg(F.when(F.col(sensor) == s, F.col(value))).alias(name) for s, name in sensors.items()]
    return df.where(F.col(sensor).isin(list(sensors))).groupBy(*keys).agg(*aggs)


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("site_id", "ts")) -> DataFrame:
    """Unpivot sensor columns; text columns are cast, bad text becomes null."""
    cast = df.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keys), list(columns), "sensor", "value")


def union_tables(*frames: DataFrame) -> DataFrame:
    """Stack wide tables with different columns; a column that is numeric anywhere becomes double.

    Absent columns are filled with null.
    """
    from pyspark.sql import types as T

    kinds: dict[str, set[bool]] = {}
    types: dict[str, list] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(isinstance(field.dataType, T.NumericType))
            types.setdefault(field.name, []).append(field.dataType)

    def aligned(f: DataFrame) -> DataFrame:
        out = []
        for c in f.columns:
            mixed = True in kinds[c] and any(t != types[c][0] for t in types[c])
            out.append(F.col(c).try_cast("double").alias(c) if mixed else F.col(c))
        return f.select(*out)

    first, *rest = [aligned(f) for f in frames]
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first
