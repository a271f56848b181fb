"""Plain tables in and out: CSV, Parquet layout and contract, scenarios, batches, run history."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.operators.flags import FLAGS, flags_to_json, sanitise_columns
from plantspark.operators.quality import batch_stats
from plantspark.schema import FORBIDDEN_COLUMNS, QUALITY_FLAGS


class ContractError(ValueError):
    """A table or manifest breaks the output contract."""


# ------------------------------------------------------------------ CSV and scenarios


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A headed CSV file; give a schema for large inputs, as inference reads them twice."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows as they come."""
    return df.limit(n)


def read_scenarios(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Historical weather rows (CSV or Parquet) as contexts for a batch of searches."""
    return spark.read.parquet(path) if path.rstrip("/").endswith("parquet") else read_csv(spark, path, schema)


# ------------------------------------------------------------------ batches


def write_readings(
    df: DataFrame,
    path: str,
    ts: str = "ts",
    rows_per_file: int | None = None,
    compression: str = "snappy",
    mode: str = "overwrite",
    cluster_by: Sequence[str] = ("site_id", "sensor"),
) -> None:
    """Parquet under ``year=/month=`` with files as large as their ranges (``rows_per_file`` splits them); flags are stored as JSON text.

    Rows are ranged by month, series and time first, so a month is written by many tasks (however
    large it is) and files hold narrow ranges that row-group statistics can skip.
    """
    if FLAGS in df.columns and isinstance(df.schema[FLAGS].dataType, T.ArrayType):
        df = flags_to_json(df)
    out = sanitise_columns(df).withColumns({"year": F.year(ts), "month": F.month(ts)})
    keys = [c for c in cluster_by if c in df.columns]
    tie = [c for c in ("row_no",) if c in df.columns]
    (
        out.repartitionByRange("year", "month", *keys, ts, *tie)
        .sortWithinPartitions("year", "month", *keys, ts, *tie)
        .write.mode(mode)
        .partitionBy("year", "month")
        .option("maxRecordsPerFile", rows_per_file or 0)
        .option("compression", compression)
        .parquet(path)
    )


def check_schema(schema: T.StructType, ts: str = "ts") -> list[str]:
    """Breaches of the output contract: time type, forbidden columns, storage of the flags."""
    found = []
    names = schema.fieldNames()
    if ts not in names:
        found.append(f"column {ts} is missing")
    elif not isinstance(schema[ts].dataType, (T.TimestampNTZType, T.TimestampType)):
        found.append(f"column {ts} is {schema[ts].dataType.simpleString()}, not a timestamp")
    found += [f"forbidden column {c}" for c in FORBIDDEN_COLUMNS if c in names]
    if FLAGS in names and not isinstance(schema[FLAGS].dataType, T.StringType):
        found.append(f"{FLAGS} must be JSON text")
    return found


def verify_parquet(spark: SparkSession, path: str, ts: str = "ts") -> None:
    if spark.conf.get("spark.sql.parquet.outputTimestampType") == "INT96":
        raise ContractError("timestamps must not be written as INT96")
    found = check_schema(spark.read.parquet(path).schema, ts)
    if found:
        raise ContractError("; ".join(found))


def write_batch(df: DataFrame, path: str, site_id: str, baseline: datetime, metadata: dict | None = None, audit: dict | None = None) -> str:
    """Write readings, the list of their files and a manifest next to them; returns the manifest path."""
    spark = df.sparkSession
    write_readings(df, f"{path}/data")
    stored = spark.read.parquet(f"{path}/data")
    stats = batch_stats(stored, file=None).first().asDict()
    files = _stored_files(spark, path)
    files.write.mode("overwrite").parquet(f"{path}/files")
    body = {
        "manifest_version": "1",
        "batch_id": str(uuid.uuid4()),
        "site_id": site_id,
        "temporal_baseline": {"pipeline_origin_timestamp": baseline.isoformat(), "timezone": "UTC"},
        "feature_metadata": metadata or {},
        "annotation_audit_trail": audit or {},
        "quality_flags_schema": list(QUALITY_FLAGS),
        "timestamp_schema": {"format": "INT64", "unit": "microseconds", "timezone": "UTC"},
        "output_format": "parquet",
        "compression": "snappy",
        "stats": {k: v.isoformat() if isinstance(v, datetime) else v for k, v in stats.items()},
        "files_count": files.count(),
    }
    text = json.dumps(body, sort_keys=True)
    manifest = f"{path}/manifest"
    spark.createDataFrame([(text,)], "manifest string").withColumn("checksum", F.sha2("manifest", 256)).coalesce(1).write.mode(
        "overwrite"
    ).json(manifest)
    return manifest


def _stored_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` below ``path``/data, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    return listed.select(F.substring_index("path", "/data/", -1).alias("file"), F.col("length").alias("bytes"))


def file_differences(spark: SparkSession, path: str) -> DataFrame:
    """``file, problem`` for files of a batch that are missing, foreign or of another size than its list says."""
    now = _stored_files(spark, path).withColumnRenamed("bytes", "_now")
    both = spark.read.schema("file string, bytes bigint").parquet(f"{path}/files").join(now, "file", "full")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("bytes").isNull(), "foreign").when(F.col("bytes") != F.col("_now"), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a folder, computed where the file is read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def read_batch(spark: SparkSession, path: str, vocabulary: Sequence[str] = tuple(QUALITY_FLAGS), schema_version: str | None = None, ts: str = "ts") -> tuple[DataFrame, dict]:
    """Readings and manifest of a batch after its checks: checksum, time baseline, vocabulary, version, list of files, columns, time unit."""
    row = spark.read.schema("manifest string, checksum string").json(f"{path}/manifest").select(
        "manifest", (F.sha2("manifest", 256) == F.col("checksum")).alias("ok")
    ).first()
    if row is None or not row["ok"]:
        raise ContractError("manifest is missing or damaged")
    m = json.loads(row["manifest"])
    if not m.get("temporal_baseline"):
        raise ContractError("manifest has no time baseline")
    if set(m["quality_flags_schema"]) != set(vocabulary):
        diff = sorted(set(m["quality_flags_schema"]) ^ set(vocabulary))
        raise ContractError(f"flag vocabulary differs: {diff}")
    audit = m.get("annotation_audit_trail") or {}
    if schema_version and audit and audit.get("schema_version") != schema_version:
        raise ContractError(f"annotation version {audit.get('schema_version')}, {schema_version} expected")
    differ = file_differences(spark, path)
    if first := differ.first():
        raise ContractError(f"{differ.count()} files differ from the batch's list, e.g. {first['file']} is {first['problem']}")
    data = spark.read.parquet(f"{path}/data")
    if found := check_schema(data.schema, ts):
        raise ContractError("; ".join(found))
    times = m.get("timestamp_schema") or {}
    if (times.get("unit"), times.get("timezone")) != ("microseconds", "UTC"):
        raise ContractError(f"times in {times.get('unit')} of {times.get('timezone')}, microseconds of UTC expected")
    return data, m


# ------------------------------------------------------------------ run history

RUNS = (
    "run_id string, timestamp timestamp_ntz, model_name string, load_rt double, outdoor_temp double, "
    "current_chw_pump_hz double, current_cw_pump_hz double, current_tower_fan_hz double, "
    "optimal_chw_pump_hz double, optimal_cw_pump_hz double, optimal_tower_fan_hz double, "
    "current_power_kw double, optimal_power_kw double, savings_kw double, savings_percent double, method string"
)


def runs_from_search(
    found: DataFrame, model_name: str, method: str, at: Column | datetime, load: str = "load_rt", outdoor: str | None = None, current: Mapping[str, str] | None = None
) -> DataFrame:
    """Records of a set-point search, one per context that has a winner.

    ``found`` comes from a search: ``best_<name>``, ``best_kw``, ``baseline_kw`` for the set-points ``chw_pump_hz``, ``cw_pump_hz`` and
    ``ct_fan_hz`` (recorded as the tower fan's). ``current`` names the columns with today's settings; a setting that the
    search lacks is recorded as 0, and savings are of the baseline, 0 per cent where it is not positive.
    """
    setpoints = {"chw_pump_hz": "chw_pump_hz", "cw_pump_hz": "cw_pump_hz", "tower_fan_hz": "ct_fan_hz"}

    def or_zero(column: str | None) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) if column and column in found.columns else F.lit(0.0)

    save = F.col("baseline_kw") - F.col("best_kw")
    moment = at if isinstance(at, Column) else F.lit(at)
    return found.where(F.col("best_kw").isNotNull()).select(
        F.expr("uuid()").alias("run_id"),
        moment.cast("timestamp_ntz").alias("timestamp"),
        F.lit(model_name).alias("model_name"),
        F.col(load).cast("double").alias("load_rt"),
        (F.col(outdoor).cast("double") if outdoor else F.lit(None).cast("double")).alias("outdoor_temp"),
        *[or_zero((current or {}).get(s)).alias(f"current_{n}") for n, s in setpoints.items()],
        *[or_zero(f"best_{s}").alias(f"optimal_{n}") for n, s in setpoints.items()],
        F.col("baseline_kw").alias("current_power_kw"),
        F.col("best_kw").alias("optimal_power_kw"),
        save.alias("savings_kw"),
        F.when(F.col("baseline_kw") > 0, save / F.col("baseline_kw") * 100.0).otherwise(F.lit(0.0)).alias("savings_percent"),
        F.lit(method).alias("method"),
    )


class RunHistory:
    """Recorded optimisation runs as an append-only Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, runs: DataFrame) -> None:
        names = T._parse_datatype_string(RUNS).fieldNames()
        if "run_id" not in runs.columns:
            runs = runs.withColumn("run_id", F.expr("uuid()"))
        runs.select(*names).write.mode("append").parquet(self.path)

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def all(self) -> DataFrame:
        """Runs that are not deleted."""
        gone = self._read(f"{self.path}.deleted", "run_id string")
        return self._read(self.path, RUNS).join(gone, "run_id", "left_anti")

    def clear(self) -> None:
        self.spark.createDataFrame([], RUNS).write.mode("overwrite").parquet(self.path)
        self.spark.createDataFrame([], "run_id string").write.mode("overwrite").parquet(f"{self.path}.deleted")

    def delete(self, run_id: str) -> bool:
        """Mark one run as deleted; the runs themselves are never rewritten, so nothing appended meanwhile is lost."""
        if self.all().where(F.col("run_id") == run_id).isEmpty():
            return False
        self.spark.createDataFrame([(run_id,)], "run_id string").write.mode("append").parquet(f"{self.path}.deleted")
        return True
