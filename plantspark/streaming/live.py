"""Structured Streaming forms of two batch operators.

The batch operators stay the reference; these give the same rows for data that arrives within the
lateness bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.operators.resample import method_by_name
from plantspark.schema import SERIES


def resample_stream(
    df: DataFrame, every: str, late: str = "10 minutes", keys: Sequence[str] = tuple(SERIES), ts: str = "ts", value: str = "value"
) -> DataFrame:
    """Tumbling means, maxima or last values by sensor kind; a window is final once the watermark
    passes its end. ``ts`` must be a TIMESTAMP. Of readings of one time the last by ``row_no`` counts, where
    the stream has one."""
    kind = method_by_name("sensor")
    last = F.struct(ts, "row_no") if "row_no" in df.columns else F.col(ts)
    return (
        df.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, every).alias("_w"))
        .agg(
            F.avg(value).alias("_mean"),
            F.max(value).alias("_max"),
            F.max_by(value, last).alias("_last"),
            F.count(value).alias("n_readings"),
        )
        .select(
            *keys,
            F.col("_w.start").alias(ts),
            F.when(kind == "last", F.col("_last")).when(kind == "max", F.col("_max")).otherwise(F.col("_mean")).alias(value),
            "n_readings",
        )
    )


def keep_first_stream(df: DataFrame, late: str = "10 minutes", keys: Sequence[str] = tuple(SERIES), ts: str = "ts") -> DataFrame:
    """The first arriving reading per series and time; state is dropped behind the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def stream_time(ts: Column | str = "ts") -> Column:
    """Watermarks need TIMESTAMP; readings hold naive UTC."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
