"""Time expressions for TIMESTAMP_NTZ columns, independent of the session time zone."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def naive_literal(moment: datetime) -> Column:
    """A Python time as a naive UTC literal, whatever the session time zone."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(UTC).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp."""
    t = as_col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    sec = F.extract(F.lit("SECOND"), t)
    return (
        days * F.lit(DAY_US)
        + F.hour(t).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(t).cast("bigint") * F.lit(60_000_000)
        + (sec * F.lit(1_000_000)).cast("bigint")
    )


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(60_000_000.0)


def time_chunk(ts: Column | str, seconds: int) -> Column:
    """Number of the fixed-length time slice a row falls in (monotone in ``ts``)."""
    t = as_col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
    if seconds % 86_400 == 0:
        return F.floor(days / F.lit(seconds // 86_400)).cast("bigint")
    return F.floor(epoch_micros(t) / F.lit(seconds * 1_000_000)).cast("bigint")


def bucket_start(ts: Column | str, every: str) -> Column:
    """Start of the tumbling window (closed left) that holds ``ts``."""
    return F.window(as_col(ts), every).getField("start")


def parse_date_time(date: Column | str, time: Column | str) -> Column:
    """``2024/01/31`` and ``08:15:00`` to a naive timestamp; anything else to null.

    A cast rather than a format pattern: it never passes through the session time zone. Each input
    is used once, as the optimizer may copy the expression into a filter.
    """
    text = F.translate(F.concat(as_col(date), F.lit(" "), as_col(time)), "-", "?")
    iso = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})$", "$1-$2-$3")
    return iso.try_cast("timestamp_ntz")


def parse_text_timestamp(c: Column | str) -> Column:
    """ISO text to a naive timestamp, null when it is not one."""
    return as_col(c).try_cast("timestamp_ntz")


def to_utc(ts: Column | str, zone: str = "Asia/Taipei") -> Column:
    """A naive local timestamp in ``zone`` as naive UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), as_col(ts))


def text_to_utc(text: Column | str, zone: str = "Asia/Taipei") -> Column:
    """Text to naive UTC: an explicit offset wins, otherwise ``zone`` is assumed."""
    t = F.trim(as_col(text))
    has_offset = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d")
    with_offset = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), t.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(has_offset, with_offset).otherwise(to_utc(t.try_cast("timestamp_ntz"), zone))


def calendar_features(ts: Column | str, weekend_from: int = 5) -> dict[str, Column]:
    """Hour, month, ISO day of week and the weekend mark.

    ``weekend_from=5`` marks Friday to Sunday; pass 6 for Saturday and Sunday only.
    """
    t = as_col(ts)
    dow = F.weekday(t) + F.lit(1)
    return {
        "hour": F.hour(t),
        "month": F.month(t),
        "day_of_week": dow,
        "is_weekend": (dow >= F.lit(weekend_from)).cast("int"),
    }


def cyclic_features(ts: Column | str) -> dict[str, Column]:
    t = as_col(ts)
    hour_angle = F.lit(2.0) * F.pi() * F.hour(t) / F.lit(24.0)
    dow_angle = F.lit(2.0) * F.pi() * (F.weekday(t) + F.lit(1)) / F.lit(7.0)
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "dow_sin": F.sin(dow_angle),
        "dow_cos": F.cos(dow_angle),
    }
