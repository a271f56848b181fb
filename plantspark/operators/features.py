"""Leakage-safe lag and rolling features, feature policies and order checks."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.functions.physics import wet_bulb_guarded
from plantspark.functions.timefx import calendar_features, cyclic_features
from plantspark.plans.ordered import chunk_of, windowed
from plantspark.plans.rolling import rolling_blocks
from plantspark.plans.slices import Slices
from plantspark.schema import SERIES

@dataclass(frozen=True)
class StatsRule:
    """Lags and rolling windows (in rows) wanted for a column."""

    lags: Sequence[int] = ()
    windows: Sequence[int] = ()
    aggs: Sequence[str] = ("mean",)
    min_periods: int | None = None

    def for_backup(self, max_window: int | None = None, max_lags: int | None = None) -> StatsRule:
        """Backup devices idle for long: windows twice as wide, cut only where the policy says so."""
        wide = (2 * w for w in self.windows)
        return replace(
            self, windows=tuple(w if max_window is None else min(w, max_window) for w in wide), lags=tuple(self.lags[:max_lags])
        )


@dataclass(frozen=True)
class Policy:
    name: str
    physical_types: Sequence[str]
    rule: StatsRule = field(default_factory=StatsRule)
    #: Limits for backup devices; None is none.
    backup_max_window: int | None = None
    backup_max_lags: int | None = None


def resolve_policies(
    annotations: Sequence[Mapping], policies: Sequence[Policy], overrides: Mapping[str, StatsRule] | None = None
) -> dict[str, StatsRule]:
    """Rule per column from annotation rows (``sensor, physical_type, device_role, is_target``).

    Targets never get features; a later policy replaces an earlier one; an override wins.
    """
    overrides = overrides or {}
    out: dict[str, StatsRule] = {}
    for policy in policies:
        for a in annotations:
            role = a.get("device_role") or "primary"
            skip = a["physical_type"] not in policy.physical_types or a.get("is_target")
            if skip or (role == "backup" and policy.name == "High_Freq"):
                continue
            base = policy.rule.for_backup(policy.backup_max_window, policy.backup_max_lags) if role == "backup" else policy.rule
            out[a["sensor"]] = overrides.get(a["sensor"], base)
    return out


#: Rows from which a rolling window is put together from blocks.
WIDE = 256

_AGGS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def _rolling(column: str, agg: str, n: int, need: int):
    def build(w):
        frame = w.rowsBetween(-n, -1)
        return F.when(F.count(column).over(frame) >= need, _AGGS[agg](column).over(frame))

    return build


def lag_rolling(
    df: DataFrame,
    rules: Mapping[str, StatsRule],
    slices: int | Slices | None = None,
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = ("ts",),
    wide_from: int = WIDE,
) -> DataFrame:
    """Add ``<c>_lag_<n>`` and ``<c>_roll<agg>_<n>`` for every column with a rule.

    Rolling windows end at the previous row, so a feature never sees the value it may predict. Every requested
    window is computed, however wide: windows of ``wide_from`` rows and more are put together from blocks of rows
    (see ``plans.rolling``), in time that does not depend on their width; all others and the lags share one window
    spec, so one shuffle and one sort.
    """
    exprs, wide, lookback = {}, {}, 1
    for c, r in rules.items():
        for n in r.lags:
            exprs[f"{c}_lag_{n}"] = lambda w, c=c, n=n: F.lag(c, n).over(w)
            lookback = max(lookback, n)
        for n in r.windows:
            for agg in r.aggs:
                if n >= wide_from:
                    wide.setdefault(n, {})[f"{c}_roll{agg}_{n}"] = (c, agg, r.min_periods or n)
                else:
                    exprs[f"{c}_roll{agg}_{n}"] = _rolling(c, agg, n, r.min_periods or n)
                    lookback = max(lookback, n)
    chunk = chunk_of(df, keys, order, slices)
    out = windowed(df, keys, order, lookback, exprs, chunk) if exprs else df
    return rolling_blocks(out, keys, order, wide, chunk) if wide else out


def usable_windows(rule: StatsRule, series_rows: int) -> tuple[StatsRule, StatsRule]:
    """The rule without lags and windows longer than half of the series, and the rule of those left out."""
    half = series_rows * 0.5

    def part(keep) -> StatsRule:
        return replace(rule, lags=tuple(n for n in rule.lags if keep(n)), windows=tuple(n for n in rule.windows if keep(n)))

    return part(lambda n: n <= half), part(lambda n: n > half)


def add_time_features(df: DataFrame, ts: str = "ts", weekend_from: int = 5, cyclic: bool = False) -> DataFrame:
    out = df.withColumns(calendar_features(ts, weekend_from))
    return out.withColumns(cyclic_features(ts)) if cyclic else out


def paired_wet_bulb(df: DataFrame, suffixes: tuple[str, str] = ("_temp", "_rh")) -> DataFrame:
    """A guarded wet-bulb column for every ``{location}_temp`` with a ``{location}_rh``."""
    t, h = suffixes
    pairs = [c.removesuffix(t) for c in df.columns if c.endswith(t) and c.removesuffix(t) + h in df.columns]
    return df.withColumns({f"{p}_wet_bulb_physics": wet_bulb_guarded(p + t, p + h) for p in pairs}) if pairs else df


def available_features(columns: Sequence[str], configured: Sequence[str]) -> list[str]:
    """Configured features that exist, each once, in configured order."""
    present = set(columns)
    return [c for c in dict.fromkeys(configured) if c in present]


def feature_hash(names: Sequence[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def feature_hash_column(names: Column) -> Column:
    return F.sha2(F.array_join(names, ","), 256)


class FeatureOrderError(ValueError):
    """Model and data disagree on the feature list."""


def check_alignment(expected: Sequence[str], actual: Sequence[str], expected_hash: str | None = None) -> None:
    """Raise unless names, order, count and (if given) hash agree."""
    if len(expected) != len(actual):
        raise FeatureOrderError(f"{len(actual)} features, {len(expected)} expected")
    wrong = [(i, e, a) for i, (e, a) in enumerate(zip(expected, actual)) if e != a]
    if wrong:
        raise FeatureOrderError(f"first difference at position {wrong[0][0]}: {wrong[0][1]} expected, {wrong[0][2]} found")
    if expected_hash and feature_hash(actual) != expected_hash:
        raise FeatureOrderError("feature hash differs")


def set_overlap(a: Column, b: Column) -> Column:
    """Share of ``a`` also in ``b`` (null for an empty ``a``)."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double"))


def membership_overlap(df: DataFrame, keys: Sequence[str], item: str, in_a: Column, in_b: Column) -> DataFrame:
    """Per key: size of set A, of A and B together, and the share of A also in B.

    The sets stay rows (one per key and item), so a key with very many items is never gathered.
    """
    each = df.groupBy(*keys, item).agg(F.max(in_a.cast("int")).alias("_a"), F.max(in_b.cast("int")).alias("_b"))
    return each.groupBy(*keys).agg(
        F.sum("_a").alias("n_a"), F.sum(F.col("_a") * F.col("_b")).alias("n_both")
    ).withColumn("overlap", F.try_divide(F.col("n_both").cast("double"), F.col("n_a").cast("double")))
