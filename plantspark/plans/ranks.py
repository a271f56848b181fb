"""Exact quantiles by refinement: count in buckets, keep the bucket that holds the rank, count again inside it.

Nothing is sorted but the last few values. Buckets are equal parts of the range that the bucket's own values
span, so a pass narrows times of one day, whose numbers agree in ten digits, as well as values of any
other distribution. A pass reads the rows once, against a table of a few numbers per key, and combines its counts
before the shuffle; a billion rows need about three passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.plans.joins import key_join
from plantspark.plans.stored import stored

#: Parts of a bucket's range in one pass.
PARTS = 1024
#: Rows of a bucket that may be sorted.
MAX_VALUES = 100_000


def _inside(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with each target of their key whose range holds them."""
    joined = key_join(rows, targets, keys, "inner")
    return joined.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def refined_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float], max_values: int = MAX_VALUES, lower: bool = False
) -> DataFrame:
    """One row per key with ``n`` and the quantiles named in ``probs``, as doubles: linearly interpolated, or with ``lower``
    the value at or below the place.

    Null and NaN values do not count, a key without others has no row, null keys are keys, and without ``keys`` there is
    one row for the table (none if it is empty). Equal values fall into one part, and a part of equal values is done,
    so a value that a third of all rows share costs nothing more. At most ``max_values`` rows of a key and rank are
    sorted, in one task each.
    """
    if not keys:
        return refined_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, max_values, lower).drop("_all")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    span = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    span = stored(span.where("n > 0"), "rank-spans")
    wanted = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(f"{end}_{name}").alias("_target"), (f(pos) + 1).cast("bigint").alias("_rank")) for end, f in (("lo", F.floor), ("hi", F.ceil))]
    targets = span.withColumn("_w", F.explode(F.array(*wanted))).select(*keys, "_w.*", "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"), F.col("n").alias("_n"))
    # Targets of a key begin with one range, so the first pass counts it once.
    by = [*keys, "_lo", "_hi"]
    while True:
        targets = stored(targets, "rank-targets")
        open_ = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > max_values)
        if not targets.where(open_).limit(1).count():
            break
        ranges = targets.where(open_).select(*by).distinct()
        width = F.col("_hi") - F.col("_lo")
        # Halves first, so that ranges as wide as all doubles stay finite.
        share = F.when(width < F.lit(float("inf")), F.try_divide(F.col("_v") - F.col("_lo"), width)).otherwise(
            F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        )
        ends = F.when(F.col("_v") == F.col("_lo"), F.lit(0)).when(F.col("_v") == F.col("_hi"), F.lit(PARTS - 1))
        part = ends.otherwise(F.least(F.lit(PARTS - 1), F.floor(F.coalesce(F.when(~F.isnan(share), share), F.lit(0.5)) * PARTS)))
        counts = (
            _inside(rows, ranges, keys)
            .groupBy(*by, part.alias("_part"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
            .withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
        )
        ranked = key_join(targets.where(open_).drop("_n"), counts, by, "inner")
        at = F.col("_before") + F.col("_upto")
        hit = ranked.where((F.col("_rank") <= at) & (F.col("_rank") > at - F.col("_n")))
        narrower = hit.select(*keys, "_target", "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (at - F.col("_n")).alias("_before"), "_n")
        targets = targets.where(~open_).unionByName(narrower)
    few = targets.where(F.col("_lo") < F.col("_hi"))
    order = Window.partitionBy(*by).orderBy("_v")
    listed = _inside(rows, few.select(*by).distinct(), keys).withColumn("_no", F.row_number().over(order))
    picked = key_join(few, listed.select(*by, "_no", "_v"), by, "inner").where(F.col("_no") == F.col("_rank") - F.col("_before"))
    found = targets.where(F.col("_lo") == F.col("_hi")).select(*keys, "_target", F.col("_lo").alias("_v")).unionByName(picked.select(*keys, "_target", "_v"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_target") == f"{end}_{name}", F.col("_v"))).alias(f"_{end}_{name}") for name in probs for end in ("lo", "hi")])
    out = key_join(span.select(*keys, "n"), wide, keys)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append(F.when((a == b) | F.lit(lower), a).otherwise(a + (b - a) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, "n", *cols)

