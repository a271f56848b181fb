"""Column names, vocabularies and other fixed values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

#: The canonical long table: one row per sensor reading.
READINGS = T.StructType(
    [
        T.StructField("site_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

#: One series is one sensor at one site; every ordered operator partitions by these.
SERIES = ["site_id", "sensor"]

# ---------------------------------------------------------------- fixed values
# Values below must equal the published ones for results to agree.

BASIC_NULL_TOKENS = ["", "NA", "null"]

NULL_TOKENS = [
    "", "NA", "null", "NULL",
    "---", "Error", "N/A", "OFF", "OFFLINE",
    "#VALUE!", "#N/A", "None", "--",
]

#: Row flags: data-quality flags first, equipment-rule flags second.
QUALITY_FLAGS = [
    "FROZEN",
    "HEAT_IMBALANCE",
    "AFFINITY_VIOLATION",
    "OUTLIER",
    "INSUFFICIENT_DATA",
    "SENSOR_OFFLINE",
    "PHYSICAL_IMPOSSIBLE",
    "MANUAL_REVIEW",
    "INTERPOLATED",
    "LOGIC_CONSTRAINT_VIOLATION",
    "REQUIRES_VIOLATION",
    "MUTEX_VIOLATION",
    "SEQUENCE_VIOLATION",
    "MIN_RUNTIME_VIOLATION",
    "MIN_DOWNTIME_VIOLATION",
]

#: Columns that may never reach an output table.
FORBIDDEN_COLUMNS = ["device_role", "ignore_warnings", "is_target", "__index_level_0__"]

#: Metadata keys that may travel with a column.
ALLOWED_METADATA_KEYS = [
    "column_name", "physical_type", "unit", "description", "precision", "temporal_baseline",
]

RESERVED_NAMES = ["class", "def", "if", "else", "for", "while", "timestamp"]

#: Window multiplier and tolerated share of zero values by device role.
ROLE_FROZEN_MULTIPLIER = {"primary": 1, "backup": 3, "seasonal": 2}
ROLE_ZERO_LIMIT = {"primary": 0.10, "backup": 0.80, "seasonal": 0.50}
