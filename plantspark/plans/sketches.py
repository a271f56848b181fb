"""Approximate quantiles on request: one mergeable sketch per series and day, stored, merged for any range of days.

A sketch holds a few thousand numbers whatever it has seen, so a year of a series is read as 365 small rows. Sketches of
tasks are merged as partial aggregates: a series that holds a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.plans.joins import key_join

#: Size of a sketch; larger is more exact.
K = 800


def rank_error(k: int = K) -> float:
    """The share of rows by which a quantile's rank is off at most, at 99 % confidence (published fit for this sketch)."""
    return 2.296 / k**0.9723


def _values(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.withColumn("_v", v).where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def day_sketches(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", k: int = K) -> DataFrame:
    """``keys, day, n, sketch``. Null and NaN values do not count; rows without a time are on a null day; null keys are keys."""
    by_day = _values(df, value).groupBy(*keys, F.col(ts).cast("date").alias("day"))
    return by_day.agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def append_days(sketches: DataFrame, path: str) -> None:
    """Add days to a stored table of sketches; a day may be added in parts, which are merged on reading."""
    sketches.repartition("day").write.mode("append").partitionBy("day").parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], first: date | None = None, last: date | None = None) -> DataFrame:
    """``keys, n, sketch`` over the days from ``first`` to ``last``, both included; without a bound, all days, the null one too.

    The days are a partition column of a stored table, so other days are not read.
    """
    if first is not None:
        sketches = sketches.where(F.col("day") >= F.lit(first))
    if last is not None:
        sketches = sketches.where(F.col("day") <= F.lit(last))
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """``keys, n`` and a value per wanted share, within ``rank_error`` of its rank."""
    return sketches.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()])


def approx_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], k: int = K) -> DataFrame:
    """As ``exact_quantiles``, within ``rank_error(k)`` of the rank: one aggregate, no sort. No row for a key without values."""
    sketch = _values(df, value).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))
    return quantiles_of(sketch, keys, probs).drop("n")


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, found: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``keys`` and for each share how far the rank of the found value is from it, counted over all rows."""
    joined = key_join(_values(df, value).select(*keys, "_v"), found, keys, "inner")

    def error(name: str, p: float) -> Column:
        below, upto = F.avg((F.col("_v") < F.col(name)).cast("double")), F.avg((F.col("_v") <= F.col(name)).cast("double"))
        return F.greatest(F.lit(0.0), F.lit(p) - upto, below - F.lit(p)).alias(name)

    return joined.groupBy(*keys).agg(*[error(name, p) for name, p in probs.items()])
