"""Stored order used again: tables bucketed by series, and file lists with ranges that choose files before listing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.timefx import naive_literal
from plantspark.schema import SERIES

RANGES = "files"


# ------------------------------------------------------------------ buckets


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str] = tuple(SERIES), order: Sequence[str] = ("ts", "row_no")
) -> None:
    """Parquet below ``path`` in ``buckets`` by hash of ``keys``, each sorted by keys and order, as table ``table``.

    Grouping, windows and joins by the keys, or by more columns beside them, then need no exchange. The rows are shuffled
    once here, so a bucket is one file. A series with a large share of all rows would make one bucket as large: for
    such data add a slice of time to ``keys`` (say a ``day`` column) and group by it too. How the table is
    bucketed is noted next to it, for :func:`open_bucketed` in a session without this catalogue.
    """
    by = [c for c in order if c in df.columns]
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *by).option("path", f"{path}/data").saveAsTable(table)
    note = json.dumps({"buckets": buckets, "keys": list(keys), "order": by, "schema": json.loads(df.schema.json())})
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def open_bucketed(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A table that :func:`write_bucketed` left below ``path``, registered under ``table`` if it is not."""
    if not spark.catalog.tableExists(table):
        note = json.loads(spark.read.text(f"{path}/layout").first()[0])

        def quoted(names: Sequence[str]) -> str:
            return ", ".join(f"`{n}`" for n in names)

        schema = spark.read.parquet(f"{path}/data").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE `{table}` ({columns}) USING parquet CLUSTERED BY ({quoted(note['keys'])}) "
            f"SORTED BY ({quoted([*note['keys'], *note['order']])}) INTO {note['buckets']} BUCKETS LOCATION '{path}/data'"
        )
    return spark.table(table)


# ------------------------------------------------------------------ file ranges


def write_ranged(
    df: DataFrame, path: str, ts: str = "ts", keys: Sequence[str] = tuple(SERIES), rows_per_file: int = 0, files: int | None = None
) -> None:
    """Parquet below ``path`` whose files hold narrow ranges of time, and their list with each file's rows and ranges.

    Rows are ranged by time, then series, so one hour of all series may be split over tasks but a file spans little
    time. The list is made from one read of time and keys of what was written.
    """
    kept = [k for k in keys if k in df.columns]
    ranged = df.repartitionByRange(files, ts, *kept) if files else df.repartitionByRange(ts, *kept)
    ranged.sortWithinPartitions(ts, *kept).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    list_ranges(df.sparkSession, path, ts, kept).write.mode("overwrite").parquet(f"{path}/{RANGES}")


def list_ranges(spark: SparkSession, path: str, ts: str = "ts", keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """``file, rows, no_time`` (rows without a time), ``first_ts, last_ts`` and ``first_<key>, last_<key>`` of each file below ``path``/data."""
    rows = spark.read.parquet(f"{path}/data").select(ts, *keys, F.col("_metadata.file_path").alias("_file"))
    ends = [f(c).alias(f"{n}_{'ts' if c == ts else c}") for c in (ts, *keys) for n, f in (("first", F.min), ("last", F.max))]
    listed = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ts).isNull()).alias("no_time"), *ends)
    return listed.select(F.substring_index("_file", "/data/", -1).alias("file"), *[c for c in listed.columns if c != "_file"])


def files_between(spark: SparkSession, path: str, first: datetime, last: datetime, **values: str) -> list[str]:
    """Files that may hold rows from ``first`` to ``last`` (both included) and of the given values of keys."""
    listed = spark.read.parquet(f"{path}/{RANGES}").where((F.col("first_ts") <= naive_literal(last)) & (F.col("last_ts") >= naive_literal(first)))
    for key, value in values.items():
        listed = listed.where((F.col(f"first_{key}") <= value) & (F.col(f"last_{key}") >= value))
    return [r.file for r in listed.select("file").orderBy("file").collect()]


def read_between(spark: SparkSession, path: str, first: datetime, last: datetime, ts: str = "ts", **values: str) -> DataFrame:
    """Rows from ``first`` to ``last``, both included, of the given values of keys; no other file is listed or opened.

    Rows without a time are in no range. Without any such file the result is empty. What reaches the driver is the names
    of the files of the range.
    """
    names = files_between(spark, path, first, last, **values)
    schema = spark.read.parquet(f"{path}/data").schema
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    rows = rows.where(F.col(ts).between(naive_literal(first), naive_literal(last)))
    for key, value in values.items():
        rows = rows.where(F.col(key) == value)
    return rows
