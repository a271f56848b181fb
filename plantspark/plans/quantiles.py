"""Exact interpolated quantiles per key that hold for keys of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one buffer. Here equal
values are counted first (combined before the shuffle, so a value repeated by a third of all rows
costs one row), and the counts are spread over buckets that follow the order of the values. Ranks
are located on the bucket totals; only the few buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.plans.joins import key_join

#: Buckets per factor e of the absolute value: 0.01 % wide.
RESOLUTION = 10_000
_OFFSET = 800 * RESOLUTION


def order_bucket(v: Column, resolution: int = RESOLUTION) -> Column:
    """A bucket number that never falls as ``v`` rises (logarithmic in the absolute value)."""
    size = F.least(F.abs(v), F.lit(1.7e308))
    scaled = F.floor(F.ln(size) * F.lit(float(resolution))).cast("bigint") + F.lit(_OFFSET)
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, scaled).otherwise(-scaled)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], resolution: int = RESOLUTION
) -> DataFrame:
    """One row per key with the linearly interpolated quantiles named in ``probs``.

    Null and NaN values are ignored, a null key is a key; ``keys`` holds at least one column. The value counts are
    shuffled once: ranks and values read the same exchange.
    """
    v = F.col(value).cast("double")
    counts = (
        df.select(*keys, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", order_bucket(F.col("_v"), resolution))
    )
    w_key = Window.partitionBy(*keys)
    totals = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_t"))
        .withColumn("_upto", F.sum("_t").over(w_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_t").over(w_key))
        .withColumn("_before", F.col("_upto") - F.col("_t"))
    )
    ranks = {}
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        ranks[name] = (F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos))
    wanted = F.lit(False)
    for lo, hi, _ in ranks.values():
        for r in (lo, hi):
            wanted = wanted | ((F.col("_before") < r) & (r <= F.col("_upto")))
    targets = totals.where(wanted).select(*keys, "_b", "_before", "_n")
    inside = (
        key_join(counts, targets, [*keys, "_b"], "inner")
        .withColumn(
            "_hi_rank",
            F.col("_before")
            + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_lo_rank", F.col("_hi_rank") - F.col("_c") + 1)
    )
    picks = []
    for name, (lo, hi, _) in ranks.items():
        for tag, r in (("lo", lo), ("hi", hi)):
            hit = (F.col("_lo_rank") <= r) & (r <= F.col("_hi_rank"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}_{name}"))
    picked = inside.groupBy(*keys, "_n").agg(*picks)
    out = []
    for name, (_, _, frac) in ranks.items():
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(a == b, a).otherwise(a + (b - a) * frac).alias(name))
    return picked.select(*keys, *out)
