"""Sensor names as data: classification, target choice, coverage and annotations."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.text import glob_to_regex, snake_case
from plantspark.plans.joins import key_join

# ---------------------------------------------------------------- fixed values

STANDARD_CATEGORIES = [
    "chiller", "chw_pump", "scp_pump", "chw_temp", "chw_pressure", "chw_flow",
    "cw_pump", "cw_temp", "cw_pressure", "cw_flow", "cooling_tower", "environment", "system_level",
]

REQUIRED_CATEGORIES = ["chiller", "system_level"]

#: Name parts that put a sensor in a category (matched anywhere, case ignored).
NAME_PARTS = {
    "chiller": ["CH_", "CHILLER", "RT", "TON", "EVAP", "COND"],
    "chw_pump": ["CHP", "CHWP", "CHILLED_PUMP"],
    "scp_pump": ["SCP", "SECONDARY", "SEC_CHP"],
    "chw_temp": ["CHW_TEMP", "CHWT", "CHW_ST", "CHW_RT", "CHW_SUPPLY", "CHW_RETURN", "CHW_DELTA", "EVAP_TEMP", "EVAP_WATER"],
    "chw_pressure": ["CHW_P", "CHWPRESS", "CHW_HEAD", "CHW_DELTA_P"],
    "chw_flow": ["CHW_FLOW", "CHWFLOW", "CHW_LPM", "CHW_GPM", "EVAP_FLOW", "CHW_RATE"],
    "cw_pump": ["CWP", "COND_PUMP", "CONDENSER_PUMP", "CW_PUMP"],
    "cw_temp": ["CW_TEMP", "CWT", "CWS", "CWR", "CW_SUPPLY", "CW_RETURN", "CW_DELTA", "COND_TEMP", "COND_WATER", "CONDENSER_TEMP"],
    "cw_pressure": ["CW_P", "CWPRESS", "CW_HEAD", "CW_DELTA_P"],
    "cw_flow": ["CW_FLOW", "CWFLOW", "CW_LPM", "CW_GPM", "COND_FLOW", "CW_RATE"],
    "cooling_tower": ["CT_", "TOWER", "CTFAN"],
    "environment": ["OAT", "OUTDOOR", "OA_TEMP", "AMBIENT", "OAH", "RH", "HUMIDITY", "RELATIVE_HUMID", "WBT", "WET_BULB", "WB_TEMP", "ENTHALPY", "H_AIR"],
    "system_level": ["TOTAL", "SYSTEM", "PLANT", "COP", "EFFICIENCY", "KW_RT", "KW/RT"],
}

#: Name parts that keep a sensor out of every category, and out of one category.
EXCLUDED_ANYWHERE = ["FROZEN", "FLAG", "ALARM", "FAULT", "ERROR"]
EXCLUDED_FROM = {"chiller": ["CH_SYS", "SYSTEM", "TOTAL"]}

PUMP_HZ_PARTS = ["pump_freq", "pump_hz", "chwp_hz", "cwp_hz", "hz", "frequency"]
PUMP_KW_PARTS = ["pump_kw", "chwp_kw", "cwp_kw", "pump_power"]

#: Older names of categories, accepted when a mapping file is read.
CATEGORY_ALIASES = {
    "load": "chiller",
    "load_cols": "chiller",
    "chw_pump_hz_cols": "chw_pump",
    "cw_pump_hz_cols": "cw_pump",
    "ct_fan_hz_cols": "cooling_tower",
    "temp_cols": "chw_temp",
    "env_cols": "environment",
}

DIM_SCHEMA = "sensor string, category string, is_target boolean, target_metric string"


def contains_any(name: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | name.contains(p)
    return out


def _categories(cases: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in cases.items()]))


def classify_by_parts(
    sensors: DataFrame, name: str = "sensor", parts: Mapping[str, Sequence[str]] = NAME_PARTS
) -> DataFrame:
    """One row per sensor and category it falls into. The pattern list is part of the expression,
    so no join is involved."""
    up = F.upper(name)
    cases = {}
    for cat, ps in parts.items():
        hit = contains_any(up, [p.upper() for p in ps])
        if cat in EXCLUDED_FROM:
            hit = hit & ~contains_any(up, EXCLUDED_FROM[cat])
        cases[cat] = hit
    usable = sensors.where(~contains_any(up, EXCLUDED_ANYWHERE))
    return usable.withColumn("category", F.explode(_categories(cases)))


def classify_by_glob(
    sensors: DataFrame, globs: Mapping[str, str | Sequence[str]], name: str = "sensor"
) -> DataFrame:
    """As :func:`classify_by_parts` with shell globs; categories outside the standard list are custom."""
    cases = {}
    for cat, gs in globs.items():
        hit = F.lit(False)
        for g in [gs] if isinstance(gs, str) else gs:
            hit = hit | F.col(name).rlike(glob_to_regex(g))
        cases[cat] = hit
    return sensors.withColumn("category", F.explode(_categories(cases))).withColumn(
        "is_custom", ~F.col("category").isin(STANDARD_CATEGORIES)
    )


def target_priority(name: Column) -> Column:
    """1 COP, 2 other efficiency measures, 3 total power, 4 any ``_KW`` point, else null."""
    up = F.upper(name)
    return (
        F.when(up.contains("COP"), 1)
        .when(contains_any(up, ["KW_RT", "KW/RT", "KW_PER_RT", "EFFICIENCY"]), 2)
        .when(up.contains("TOTAL") & up.contains("KW"), 3)
        .when(up.endswith("_KW"), 4)
    )


def pick_target(sensors: DataFrame, name: str = "sensor", position: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """The prediction target among the sensors (best priority, then first) and its metric kind."""
    ranked = sensors.withColumn("_p", target_priority(F.col(name))).where(F.col("_p").isNotNull())
    best = ranked.groupBy(*keys).agg(F.min_by(name, F.struct("_p", position)).alias("target"))
    eff = contains_any(F.upper("target"), ["COP", "EFFICIENCY", "KW_RT", "KW/RT"])
    return best.withColumn("target_metric", F.when(eff, "efficiency").otherwise("power"))


def pick_target_by_glob(sensors: DataFrame, glob: str = "*TOTAL*KW", name: str = "sensor", position: str = "position") -> DataFrame:
    return sensors.where(F.col(name).rlike(glob_to_regex(glob))).agg(F.min_by(name, position).alias("target"))


def pick_pump_columns(sensors: DataFrame, name: str = "sensor", position: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """First frequency and first power column of a pump by name."""
    low = F.lower(name)
    return sensors.groupBy(*keys).agg(
        F.min_by(name, F.when(contains_any(low, PUMP_HZ_PARTS), F.col(position))).alias("freq_col"),
        F.min_by(name, F.when(contains_any(low, PUMP_KW_PARTS), F.col(position))).alias("power_col"),
    )


def pump_columns_of(columns: Sequence[str]) -> tuple[str, str] | None:
    """The first frequency and the first power column of a pump among the names of a wide table, if it has both."""

    def first(parts: Sequence[str]) -> str | None:
        return next((c for c in columns if any(x in c.lower() for x in parts)), None)

    hz, kw = first(PUMP_HZ_PARTS), first(PUMP_KW_PARTS)
    return (hz, kw) if hz and kw else None


def mapping_coverage(mapping: DataFrame, actual: DataFrame, name: str = "sensor") -> DataFrame:
    """Mapped sensors as ``matched``, ``missing_required`` or ``missing_optional``, and actual
    sensors without a mapping as ``unmapped``."""
    m = mapping.select(name, "category").distinct()
    a = actual.select(name).distinct()
    required = F.col("category").isin(REQUIRED_CATEGORIES)
    known = m.join(a, name, "left_semi").withColumn("status", F.lit("matched"))
    missing = m.join(a, name, "left_anti").withColumn(
        "status", F.when(required, "missing_required").otherwise("missing_optional")
    )
    extra = a.join(m, name, "left_anti").select(
        name, F.lit(None).cast("string").alias("category"), F.lit("unmapped").alias("status")
    )
    return known.unionByName(missing).unionByName(extra)


def match_rate(coverage: DataFrame) -> DataFrame:
    mapped = F.col("status") != "unmapped"
    return coverage.agg(
        F.coalesce(
            F.try_divide(F.sum((F.col("status") == "matched").cast("double")), F.sum(mapped.cast("double"))), F.lit(0.0)
        ).alias("match_rate")
    )


def annotation_gaps(actual: DataFrame, dim: DataFrame, name: str = "sensor") -> DataFrame:
    """Sensors without annotation and annotations without sensor."""
    a, d = actual.select(name).distinct(), dim.select(name).distinct()
    return (
        a.join(d, name, "left_anti").withColumn("gap", F.lit("unannotated"))
        .unionByName(d.join(a, name, "left_anti").withColumn("gap", F.lit("orphan")))
    )


def enforce_annotation(readings: DataFrame, dim: DataFrame, policy: str = "error", name: str = "sensor") -> DataFrame:
    """``error`` raises on sensors without annotation, ``skip`` drops them, ``warn`` keeps them."""
    if policy == "warn":
        return readings
    if policy == "skip":
        return key_join(readings, dim.select(name).distinct(), [name], "left_semi")
    unknown = without_annotation(readings, dim, name)
    if first := unknown.first():
        raise ValueError(f"{unknown.count()} sensors without annotation, e.g. {first[0]}")
    return readings


def without_annotation(readings: DataFrame, dim: DataFrame, name: str = "sensor") -> DataFrame:
    """All sensors that the annotation table lacks; names are made distinct before the join."""
    return key_join(readings.select(name).distinct(), dim.select(name), [name], "left_anti")


def inherit_annotations(base: DataFrame, site: DataFrame, name: str = "sensor") -> DataFrame:
    """Site annotations over base annotations, column by column."""
    cols = [c for c in base.columns if c != name]
    b = base.select(name, *[F.col(c).alias(f"_b_{c}") for c in cols])
    joined = site.join(b, name, "full_outer")
    return joined.select(
        name, *[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) if c in site.columns else F.col(f"_b_{c}").alias(c) for c in cols]
    )


def equipment_groups(dim: DataFrame) -> dict[str, object]:
    """Filters on an annotated sensor table by equipment, type prefix, role and electrical kind."""
    return {
        "by_equipment": lambda eq: dim.where(F.col("equipment_id") == eq),
        "by_type": lambda prefix: dim.where(F.col("equipment_id").startswith(prefix)),
        "by_role": lambda role: dim.where(F.col("device_role") == role),
        "electrical": lambda kinds=("power", "current", "voltage", "power_factor", "energy"): dim.where(
            F.col("physical_type").isin(list(kinds))
        ),
    }


def label_features(features: DataFrame, dim: DataFrame, name: str = "sensor") -> DataFrame:
    """Physical type of each feature; columns made by the library count as ``derived``."""
    return features.join(dim.select(name, "physical_type"), name, "left").withColumn(
        "physical_type", F.coalesce("physical_type", F.lit("derived"))
    )


def standardise_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Every distinct name with its snake_case form and the number of names that share it."""
    std = names.select(name).distinct().withColumn(
        "standard", F.when(F.col(name) == "timestamp", F.col(name)).otherwise(snake_case(name))
    )
    shared = std.groupBy("standard").agg(F.count(F.lit(1)).alias("n_names"))
    return std.join(shared, "standard", "left").withColumn("is_valid", F.col("standard").isNotNull())


def require_unique_names(names: DataFrame, name: str = "name") -> DataFrame:
    """Raise when a name has no standard form or two names share one."""
    std = standardise_names(names, name)
    bad = std.where(~F.col("is_valid") | (F.col("n_names") > 1))
    if first := bad.orderBy(name).first():
        raise ValueError(f"{bad.count()} names without a unique standard form, e.g. {first[name]}; standardise_names lists all")
    return std


# ------------------------------------------------------------------ the mapping as a table


def mapping_frame(
    spark: SparkSession, categories: Mapping[str, Sequence[str]], target: str | None = None, metric: str = "efficiency"
) -> DataFrame:
    rows = [(s, CATEGORY_ALIASES.get(c, c), False, None) for c, names in categories.items() for s in names]
    if target:
        rows.append((target, "target", True, metric))
    return spark.createDataFrame(rows, DIM_SCHEMA).distinct()


def add_category(mapping: DataFrame, category: str, names: Sequence[str]) -> DataFrame:
    rows = [(n, category, False, None) for n in names]
    return mapping.unionByName(mapping.sparkSession.createDataFrame(rows, DIM_SCHEMA))


def remove_category(mapping: DataFrame, category: str) -> DataFrame:
    if category in STANDARD_CATEGORIES:
        return mapping
    return mapping.where(F.col("category") != category)


def category_sensors(mapping: DataFrame, category: str) -> DataFrame:
    return mapping.where(F.col("category") == CATEGORY_ALIASES.get(category, category)).select("sensor")


def save_mapping(mapping: DataFrame, path: str) -> None:
    mapping.coalesce(1).write.mode("overwrite").json(path)


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIM_SCHEMA).json(path)


def read_mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """A site's mapping file (one JSON object of lists). Old key names are accepted, unknown keys
    ignored, ``custom_features`` and ``custom_categories`` become categories of their own."""
    text = spark.read.text(path, wholetext=True).first()[0]
    raw = json.loads(text)
    cats: dict[str, list[str]] = {}
    for key, val in raw.items():
        name = CATEGORY_ALIASES.get(key, key.removesuffix("_cols"))
        if name in STANDARD_CATEGORIES and isinstance(val, list):
            cats.setdefault(name, []).extend(v for v in val if v not in cats.get(name, []))
        elif key in ("custom_features", "custom_categories") and isinstance(val, dict):
            for c, names in val.items():
                cats.setdefault(c, []).extend(names)
    return mapping_frame(spark, cats, raw.get("target_col"), raw.get("target_metric", "efficiency"))
