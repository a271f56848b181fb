"""Consistency between a system model and the sum of its component models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
BASE_TOLERANCE = 5.0
LOAD_FACTOR = {"light": 1.5, "medium": 1.0, "heavy": 0.8}
MEASUREMENT_ERROR = 0.5
MAX_TOLERANCE = 15.0
MIN_BIN_ROWS = 10
MIN_CORRELATION = 0.95
MAX_BIAS_PCT = 5.0
COUPLING_BIAS_PCT = 3.0
MAX_SINGLE_ERROR_KW = 50.0
MIN_COMPARISON_ROWS = 100


class ConsistencyError(ValueError):
    """System and component models disagree too much, or cannot be compared."""


def component_sum(
    components: DataFrame, keys: Sequence[str], kw: str, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Sum of component predictions per key, the number of components and any ``extra`` aggregates."""
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return components.groupBy(*keys).agg(F.sum(kw).alias("component_kw"), F.count(F.lit(1)).alias("n_components"), *more)


def compare(
    system: DataFrame, components: DataFrame, keys: Sequence[str], kw: str, extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """System predictions next to the component sums. Components shrink to one row per key first."""
    return system.join(component_sum(components, keys, kw, extra), list(keys))


def load_bin(load_percent: Column) -> Column:
    return F.when(load_percent < 30, "light").when(load_percent > 70, "heavy").otherwise("medium")


def ambient_bin(wet_bulb: Column) -> Column:
    return F.when(wet_bulb < 20, "low").when(wet_bulb > 26, "high").otherwise("mid")


def combo_bin(n_machines: Column) -> Column:
    return F.when(n_machines == 1, "single").when(n_machines == 2, "dual").otherwise("multi")


def dynamic_tolerance(
    load_percent: Column, n_machines: Column, gamma: Column | float = 1.0, beta_table: Mapping[int, float] | None = None
) -> Column:
    """Allowed relative error in percent for a load and a number of running machines.

    Three and more machines add 10 % each by default; ``beta_table`` may fix other factors, its
    largest key standing for all higher counts.
    """
    b = load_bin(load_percent)
    alpha = F.when(b == "light", LOAD_FACTOR["light"]).when(b == "heavy", LOAD_FACTOR["heavy"]).otherwise(LOAD_FACTOR["medium"])
    if beta_table:
        top = max(beta_table)
        beta = F.lit(float(beta_table[top]))
        for k in sorted(beta_table):
            if k != top:
                beta = F.when(n_machines == k, float(beta_table[k])).otherwise(beta)
    else:
        beta = F.when(n_machines == 1, 0.9).when(n_machines == 2, 1.0).otherwise(F.lit(1.0) + (n_machines - 2) * F.lit(0.1))
    g = F.lit(float(gamma)) if isinstance(gamma, (int, float)) else gamma
    return F.least(F.lit(BASE_TOLERANCE) * alpha * beta * g + F.lit(MEASUREMENT_ERROR), F.lit(MAX_TOLERANCE))


def binned_metrics(
    df: DataFrame,
    system: str,
    component: str,
    bins: Mapping[str, Column],
    tolerance: Column | None = None,
    min_rows: int = MIN_BIN_ROWS,
) -> DataFrame:
    """MAPE, MAE, bias and row count per bin of every bin family, in one aggregate.

    Each row is repeated once per family inside its task; the aggregate combines before the
    shuffle, so only (families x bins) rows travel. Bins under ``min_rows`` are skipped.
    """
    s, c = F.col(system), F.col(component)
    families = F.array(*[F.struct(F.lit(k).alias("family"), v.alias("bin")) for k, v in bins.items()])
    cols = [F.col(system), F.col(component), F.explode(families).alias("_b")]
    if tolerance is not None:
        cols.append(tolerance.alias("_tol"))
    aggs = [
        (F.avg(F.try_divide(F.abs(s - c), s)) * 100.0).alias("mape"),
        F.avg(F.abs(s - c)).alias("mae"),
        F.avg(c - s).alias("bias"),
        F.avg(s).alias("mean_system"),
        F.count(F.lit(1)).alias("n_samples"),
    ]
    if tolerance is not None:
        aggs.append(F.avg("_tol").alias("tolerance"))
    return (
        df.select(*cols)
        .groupBy(F.col("_b.family").alias("family"), F.col("_b.bin").alias("bin"))
        .agg(*aggs)
        .where(F.col("n_samples") >= min_rows)
    )


def overall_stats(df: DataFrame, system: str, component: str) -> DataFrame:
    s, c = F.col(system), F.col(component)
    return df.agg(
        (F.avg(F.try_divide(F.abs(s - c), s)) * 100.0).alias("mape"),
        F.corr(s, c).alias("correlation"),
        F.avg(c - s).alias("bias"),
        F.try_divide(F.avg(c - s) * 100.0, F.avg(s)).alias("bias_percent"),
        F.max(F.abs(s - c)).alias("max_error"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def coupling_factor(bins: DataFrame) -> DataFrame:
    """Tolerance factor per load bin: above one where the components add up to too much."""
    g = F.when(F.col("bias") > 0, F.lit(1.0) + F.try_divide(F.col("bias"), F.col("mean_system"))).otherwise(F.lit(1.0))
    return bins.where(F.col("family") == "load").select("bin", F.round(g, 3).alias("gamma"))


def verdict(bins: DataFrame, overall: DataFrame, availability: str = "L3") -> DataFrame:
    """One row with the failed and warned rules. ``bins`` needs a ``tolerance`` column.

    Both inputs are already reduced to a few rows.
    """
    over = bins.where(F.col("mape") >= F.col("tolerance"))
    light = bins.where(
        (F.col("family") == "load")
        & (F.col("bin") == "light")
        & (F.col("mape") > BASE_TOLERANCE)
        & (F.col("mape") < F.col("tolerance"))
    )
    j = overall.withColumn("bins_over", over.agg(F.count(F.lit(1))).scalar()).withColumn(
        "light_high", light.agg(F.count(F.lit(1))).scalar()
    )
    bias = F.abs(F.col("bias_percent"))
    fails = F.array_compact(
        F.array(
            F.when(F.col("bins_over") > 0, "EXCEEDS_DYNAMIC_TOLERANCE"),
            F.when(bias > MAX_BIAS_PCT, "SYSTEMATIC_BIAS_DETECTED"),
            F.when(F.col("correlation") < MIN_CORRELATION, "TREND_MISMATCH"),
            F.when(F.col("max_error") > MAX_SINGLE_ERROR_KW, "OUTLIER_VIOLATION"),
            F.lit("INSUFFICIENT_COMPONENTS" if availability == "L1" else None).cast("string"),
        )
    )
    warns = F.array_compact(
        F.array(
            F.when((bias > COUPLING_BIAS_PCT) & (bias <= MAX_BIAS_PCT), "COUPLING_EFFECT_DETECTED"),
            F.when(F.col("light_high") == 1, "LIGHT_LOAD_HIGH_VARIANCE"),
            F.lit("PARTIAL_COMPONENTS" if availability == "L2" else None).cast("string"),
        )
    )
    return j.withColumn("failures", fails).withColumn("warnings", warns).withColumn(
        "verdict", F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARNING").otherwise("FULL_CONSISTENCY")
    )


def impute_missing(
    system: Column, available_sum: Column, n_missing: Column, energy_ratio: Column, estimate: Column
) -> dict[str, Column]:
    """Component sum and confidence when some component models are missing.

    Nothing missing: the plain sum. More than 80 % of the energy known: half of the residual is
    added. At most two missing: an estimate (physics or historical mean) is added. Otherwise no
    comparison is possible.
    """
    known, few = energy_ratio > 0.8, n_missing <= 2
    total = (
        F.when(n_missing == 0, available_sum)
        .when(known, available_sum + (system - available_sum) * F.lit(0.5))
        .when(few, available_sum + estimate)
    )
    confidence = (
        F.when(n_missing == 0, 1.0).when(known, energy_ratio).when(few, energy_ratio * F.lit(0.8)).otherwise(F.lit(0.0))
    )
    return {"component_kw": total, "confidence": confidence}


def availability_level(n_available: Column, n_chillers: Column, n_missing: Column) -> Column:
    """L3 all components, L2 several chillers, L1 a single component, L0 none."""
    return (
        F.when(n_available == 0, "L0").when(n_missing == 0, "L3").when((n_available == 1) | (n_chillers <= 1), "L1").otherwise("L2")
    )


def comparison_rows(df: DataFrame, split: str = "split", minimum: int = MIN_COMPARISON_ROWS, combine_from: int = MIN_COMPARISON_ROWS):
    """Rows to compare on and their source: test, else validation, else both together."""
    n = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).where(F.col(split).isin("test", "val")).collect()}
    test, val = n.get("test", 0), n.get("val", 0)
    for name, size in (("test", test), ("val", val)):
        if size >= minimum:
            return df.where(F.col(split) == name), name
    if test + val >= combine_from:
        return df.where(F.col(split).isin("test", "val")), "combined"
    raise ConsistencyError(f"only {test} test and {val} validation rows")


def discrepancy(df: DataFrame, system: str, component: str, fail_at: float = 15.0, warn_at: float = 5.0) -> DataFrame:
    """Largest relative difference in percent with its status."""
    s, c = F.col(system), F.col(component)
    return df.agg((F.max(F.try_divide(F.abs(s - c), s)) * 100.0).alias("max_discrepancy")).withColumn(
        "status",
        F.when(F.col("max_discrepancy") > fail_at, "FAIL").when(F.col("max_discrepancy") > warn_at, "WARNING").otherwise("OK"),
    )
