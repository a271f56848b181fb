"""Data-quality checks, guards and reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.functions import physics
from plantspark.functions.timefx import minutes_between, naive_literal
from plantspark.plans.joins import key_join
from plantspark.plans.ordered import chunk_of, segments, windowed
from plantspark.plans.slices import Slices
from plantspark.plans.quantiles import exact_quantiles
from plantspark.plans.sketches import approx_quantiles
from plantspark.schema import ROLE_FROZEN_MULTIPLIER, ROLE_ZERO_LIMIT, SERIES

ORDER = ["ts", "row_no"]


class CircuitBreakerOpen(RuntimeError):
    """Too large a share of the rows is invalid."""


class FutureDataError(ValueError):
    """Rows lie after the allowed point in time."""


# ------------------------------------------------------------------ ordered checks


def frozen_flags(
    df: DataFrame,
    slices: int | Slices | None = None,
    window: int = 6,
    threshold: float = 0.001,
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = ("ts",),
    value: str = "value",
) -> DataFrame:
    """Add ``rolling_std`` over ``window`` rows and ``is_frozen`` (std below the threshold).

    An incomplete window, or one with nulls in it, has no std and is not frozen.
    """
    v = F.col(value)

    def std(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return F.when(F.count(v).over(frame) == window, F.stddev_samp(v).over(frame))

    out = windowed(df, keys, order, window - 1, {"rolling_std": std}, chunk_of(df, keys, order, slices))
    return out.withColumn("is_frozen", F.coalesce(F.col("rolling_std") < F.lit(threshold), F.lit(False)))


def frozen_by_role(
    df: DataFrame,
    slices: int | Slices | None = None,
    base: int = 3,
    role: str = "device_role",
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = ("ts",),
    value: str = "value",
) -> DataFrame:
    """``is_frozen`` when the last ``base * multiplier(role)`` values are all equal."""
    longest = base * max(ROLE_FROZEN_MULTIPLIER.values())
    v = F.col(value)

    def equal_run(w):
        out = F.lit(None).cast("boolean")
        for name, mult in ROLE_FROZEN_MULTIPLIER.items():
            n = base * mult
            frame = w.rowsBetween(-(n - 1), 0)
            same = (F.count(v).over(frame) == n) & (F.min(v).over(frame) == F.max(v).over(frame))
            out = F.when(F.col(role) == name, same).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return windowed(df, keys, order, longest - 1, {"is_frozen": equal_run}, chunk_of(df, keys, order, slices))


def steady_state(
    df: DataFrame,
    load: str,
    slices: int | Slices | None = None,
    window_minutes: int = 15,
    interval_minutes: int = 5,
    max_change_pct: float = 5.0,
    keys: Sequence[str] = ("site_id",),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Add ``is_steady_state``: load spread over the window within ``max_change_pct`` of its middle.

    Unknown counts as steady; without the load column every row is steady.
    """
    if load not in df.columns:
        return df.withColumn("is_steady_state", F.lit(True))
    n = max(1, window_minutes // interval_minutes)
    v = F.col(load).try_cast("double")

    def change(w):
        frame = w.rowsBetween(-(n - 1), 0)
        lo, hi = F.min(v).over(frame), F.max(v).over(frame)
        pct = F.try_divide(hi - lo, (hi + lo) / F.lit(2.0) + F.lit(1e-6)) * F.lit(100.0)
        return F.when(F.count(v).over(frame) == n, pct)

    out = windowed(df, keys, order, n - 1, {"_change": change}, chunk_of(df, keys, order, slices))
    return out.withColumn("is_steady_state", F.coalesce(F.col("_change") <= F.lit(max_change_pct), F.lit(True))).drop("_change")


def meter_drops(
    df: DataFrame,
    slices: int | Slices | None = None,
    tolerance: float = 0.01,
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = tuple(ORDER),
    value: str = "value",
) -> DataFrame:
    """Readings and falls (beyond the tolerance) of each cumulative meter."""
    diff = windowed(
        df, keys, order, 1, {"_diff": lambda w: F.col(value) - F.lag(value).over(w)}, chunk_of(df, keys, order, slices)
    )
    return diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum(F.when(F.col("_diff") < F.lit(-tolerance), 1).otherwise(0)).alias("drops_count"),
    )


def long_gaps(
    df: DataFrame,
    slices: int | Slices | None = None,
    max_minutes: float = 60.0,
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = tuple(ORDER),
) -> DataFrame:
    """Pairs of neighbouring readings of a series further apart than ``max_minutes``."""
    ts = order[0]
    prev = windowed(
        df.select(*keys, *order), keys, order, 1, {"prev_ts": lambda w: F.lag(ts).over(w)}, chunk_of(df, keys, order, slices)
    )
    return prev.withColumn("gap_minutes", minutes_between("prev_ts", ts)).where(F.col("gap_minutes") > F.lit(max_minutes))


def low_power_factor_spans(
    df: DataFrame,
    slices: int | Slices | None = None,
    limit: float = 0.8,
    min_minutes: float = 60.0,
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = tuple(ORDER),
    value: str = "value",
) -> DataFrame:
    """Runs of readings below ``limit`` that last longer than ``min_minutes``."""
    low = df.where(F.col(value).isNotNull()).withColumn("_low", F.col(value) < F.lit(limit))
    spans = segments(low, keys, order, "_low", chunk_of(low, keys, order, slices))
    return (
        spans.where(F.col("_low"))
        .withColumn("minutes", minutes_between("seg_start", "seg_end"))
        .where(F.col("minutes") > F.lit(min_minutes))
        .drop("_low")
    )


# ------------------------------------------------------------------ distribution checks


def zero_share(df: DataFrame, keys: Sequence[str] = tuple(SERIES), value: str = "value", role: str | None = None) -> DataFrame:
    """Share of zero values per series against the limit of its device role."""
    group = [*keys, role] if role else list(keys)
    out = df.groupBy(*group).agg(F.avg(F.when(F.col(value) == 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("zero_share"))
    limit = F.lit(ROLE_ZERO_LIMIT["primary"])
    if role:
        for name, x in ROLE_ZERO_LIMIT.items():
            limit = F.when(F.col(role) == name, F.lit(x)).otherwise(limit)
    return out.withColumn("zero_limit", limit).withColumn("high_zero_ratio", F.col("zero_share") > F.col("zero_limit"))


def distribution_warnings(
    df: DataFrame, limits: DataFrame, keys: Sequence[str] = tuple(SERIES), value: str = "value", low_variance: float = 0.001
) -> DataFrame:
    """Mean outside ``mean_lo..mean_hi`` and near-zero spread, per series.

    ``limits`` holds ``sensor, mean_lo, mean_hi``. The statistics are reduced before they meet it.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return (
        stats.join(limits, "sensor", "left")
        .withColumn("mean_out_of_range", ~F.col("mean").between(F.col("mean_lo"), F.col("mean_hi")))
        .withColumn("low_variance", F.col("std") < F.lit(low_variance))
    )


def iqr_outliers(
    df: DataFrame,
    keys: Sequence[str] = tuple(SERIES),
    value: str = "value",
    whiskers: float = 1.5,
    approx_k: int | None = None,
) -> DataFrame:
    """Rows outside the whiskers around the quartiles of their series (flag ``is_outlier``).

    The quartiles are exact, or with ``approx_k`` from sketches of that size (see ``plans.sketches``).
    """
    probs = {"q1": 0.25, "q3": 0.75}
    q = approx_quantiles(df, keys, value, probs, approx_k) if approx_k else exact_quantiles(df, keys, value, probs)
    iqr = F.col("q3") - F.col("q1")
    return (
        key_join(df, q, keys)
        .withColumn("lower", F.col("q1") - F.lit(whiskers) * iqr)
        .withColumn("upper", F.col("q3") + F.lit(whiskers) * iqr)
        .withColumn("is_outlier", (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
        .drop("q1", "q3")
    )


def affinity_check(
    df: DataFrame,
    hz: str,
    kw: str,
    keys: Sequence[str],
    tolerance: float = 0.20,
    approx_k: int | None = None,
) -> DataFrame:
    """Add ``affinity_ratio`` and ``affinity_law_invalid`` (too far from the asset's median ratio; ``approx_k`` as above)."""
    ratio = df.withColumn("affinity_ratio", physics.affinity_ratio(hz, kw))
    probs = {"median_ratio": 0.5}
    med = approx_quantiles(ratio, keys, "affinity_ratio", probs, approx_k) if approx_k else exact_quantiles(ratio, keys, "affinity_ratio", probs)
    ratio_col, mid = F.col("affinity_ratio"), F.col("median_ratio")
    invalid = (
        F.when(ratio_col.isNull(), F.lit(None).cast("boolean"))
        .when(mid == 0, F.lit(True))
        .otherwise(F.abs(ratio_col - mid) / mid > F.lit(tolerance))
    )
    return key_join(ratio, med, keys).withColumn("affinity_law_invalid", invalid)


# ------------------------------------------------------------------ filters and guards


def drop_invalid(
    df: DataFrame, heat_balance: bool = True, steady: bool = True, affinity: bool = True
) -> DataFrame:
    """Remove rows that failed a check; an unknown verdict stays, absent checks are ignored."""
    if heat_balance and "heat_balance_invalid" in df.columns:
        df = df.where(~F.coalesce("heat_balance_invalid", F.lit(False)))
    if steady and "is_steady_state" in df.columns:
        df = df.where(F.coalesce("is_steady_state", F.lit(True)))
    if affinity and "affinity_law_invalid" in df.columns:
        df = df.where(~F.coalesce("affinity_law_invalid", F.lit(False)))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in ``columns``.

    One predicate per column: each can reach the Parquet scan, which ``dropna`` (a single
    predicate over all columns) cannot.
    """
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    floats = [c for c in columns if df.schema[c].dataType.typeName() in ("double", "float")]
    for c in floats:
        df = df.where(~F.isnan(c))
    return df


def split_future(df: DataFrame, baseline: datetime, minutes: int = 5, file: str = "source_file", ts: str = "ts"):
    """Accepted rows and the list of rejected files.

    A file with any row later than ``baseline`` plus the tolerance is rejected whole.
    """
    late = F.col(ts) > naive_literal(baseline) + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    rejected = (
        df.where(late).groupBy(file).agg(F.count(F.lit(1)).alias("n_future"), F.max(ts).alias("last_ts"))
    )
    accepted = key_join(df, rejected.select(file), [file], "left_anti")
    return accepted, rejected


def require_no_leakage(df: DataFrame, cutoff: datetime, ts: str = "ts") -> DataFrame:
    """Raise when any row lies after the cut-off."""
    late = df.where(F.col(ts) > naive_literal(cutoff))
    n, last = late.agg(F.count("*"), F.max(ts)).first()
    if n:
        raise FutureDataError(f"{n} rows after the cut-off {cutoff}, the last at {last}")
    return df


def implausible_timestamps(df: DataFrame, baseline: datetime, min_year: int = 2020, max_days: int = 1, ts: str = "ts") -> DataFrame:
    """Rows from before ``min_year`` or more than ``max_days`` away from the baseline date."""
    base = naive_literal(baseline).cast("date")
    return df.where((F.year(ts) < min_year) | (F.abs(F.datediff(F.col(ts).cast("date"), base)) > max_days))


def require_samples(df: DataFrame, features: Sequence[str], label: str, minimum: int = 10) -> int:
    """Number of complete rows; raises with the worst null counts when there are too few."""
    n = complete_cases(df, [*features, label]).count()
    if n < minimum:
        worst = [(r["feature"], r["null_count"]) for r in null_counts(df, [*features, label]).collect()]
        raise ValueError(f"{n} complete rows, {minimum} needed; most nulls: {worst}")
    return n


def null_counts(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """The ``top`` columns with the most nulls: one aggregate, then a handful of rows."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return (
        sums.unpivot([], list(columns), "feature", "null_count")
        .orderBy(F.desc("null_count"), "feature")
        .limit(top)
    )


def invalid_share(df: DataFrame, invalid: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(F.coalesce(invalid, F.lit(False)).cast("long")).alias("invalid_rows"),
        F.avg(F.coalesce(invalid, F.lit(False)).cast("double")).alias("invalid_share"),
    )


def circuit_breaker(df: DataFrame, invalid: Column, max_share: float = 0.3, on_trip: str = "raise") -> DataFrame:
    """Stop, or tag every row ``DATA_SUSPICIOUS``, when too many rows are invalid."""
    share = invalid_share(df, invalid).first()["invalid_share"] or 0.0
    if share <= max_share:
        return df
    if on_trip == "raise":
        raise CircuitBreakerOpen(f"{share:.1%} of the rows are invalid, limit {max_share:.1%}")
    return df.withColumn("batch_tag", F.lit("DATA_SUSPICIOUS"))


def cleaning_report(df: DataFrame, filled: Column, failed: Column, steady: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.sum(F.coalesce(filled, F.lit(False)).cast("long")).alias("rows_filled"),
        F.sum(F.coalesce(failed, F.lit(False)).cast("long")).alias("rows_failed"),
        F.avg(F.coalesce(steady, F.lit(True)).cast("double")).alias("steady_share"),
    )


def batch_stats(df: DataFrame, ts: str = "ts", file: str | None = "source_file") -> DataFrame:
    """Rows, columns, time range, null share and file count of a table, in one pass."""
    cols = df.columns
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(cols)).cast("long").alias("total_cols"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.try_divide(F.sum(nulls).cast("double"), F.count(F.lit(1)) * F.lit(float(len(cols)))).alias("null_share"),
    ]
    if file:
        aggs.append(F.count_distinct(file).alias("files_count"))
    return df.agg(*aggs)
