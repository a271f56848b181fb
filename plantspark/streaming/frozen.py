"""Frozen sensors on a stream: keyed state holds what is not final yet and the last few values that are."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantspark.schema import SERIES

#: The state store that keyed state with timers needs; set it on the session before the query starts.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def sample_deviation(values: Sequence[float]) -> float | None:
    """Of at least two values, by running mean and squared deviations; None for fewer."""
    n, mean, m2 = 0, 0.0, 0.0
    for v in values:
        n += 1
        step = v - mean
        mean += step / n
        m2 += step * (v - mean)
    return math.sqrt(m2 / (n - 1)) if n > 1 else None


class FrozenProcessor(StatefulProcessor):
    """Per series: readings above the watermark, by time and row number, and the last ``window - 1`` values below it.

    A timer at the earliest waiting reading wakes the series once the watermark has passed it; all readings that are
    final by then come out in order. When none waits, a timer ``idle`` after the last reading ends the state.
    """

    def __init__(self, keys: Sequence[str], window: int, threshold: float, idle_ms: int) -> None:
        self.names = [*keys, "_us", "_row_no", "_value", "rolling_std", "is_frozen"]
        self.window, self.threshold, self.idle_ms = window, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, row_no long", "value double")
        self.tail = handle.getValueState("tail", "vals array<double>, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        # The engine lets rows pass that are late by less than a batch; what came out already stays as it is.
        mark, earliest = timerValues.getCurrentWatermarkInMs(), None
        for r in rows:
            if 0 < mark and r["_us"] <= mark * 1000:
                continue
            self.waiting.updateValue((r["_us"], r["_row_no"]), (r["_value"],))
            earliest = r["_us"] if earliest is None else min(earliest, r["_us"])
        if earliest is not None:
            self.handle.registerTimer(_wake_ms(earliest))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = self.tail.get() if self.tail.exists() else None
        last, end = (list(held[0]), held[1]) if held else ([], 0)
        ready, left = [], None
        for (us, row_no), (value,) in self.waiting.iterator():
            if us <= mark * 1000:
                ready.append((us, row_no, value))
            else:
                left = us if left is None else min(left, us)
        ready.sort()
        for us, row_no, value in ready:
            self.waiting.removeKey((us, row_no))
            if end and _wake_ms(us) - end >= self.idle_ms:
                last = []
            seen = [*last, value]
            whole = len(seen) == self.window and None not in seen
            std = sample_deviation(seen) if whole else None
            last, end = seen[-(self.window - 1) :] if self.window > 1 else [], _wake_ms(us)
            made = (*key, us, row_no, value, std, std is not None and std < self.threshold)
            yield Row(**dict(zip(self.names, made, strict=True)))
        if ready:
            self.tail.update((last, end))
        if left is not None:
            self.handle.registerTimer(_wake_ms(left))
        elif ready:
            self.handle.registerTimer(end + self.idle_ms)
        elif end and end + self.idle_ms <= mark:
            self.tail.clear()

    def close(self) -> None:
        pass


def _wake_ms(us: int) -> int:
    return -(-us // 1000)


def frozen_stream(
    df: DataFrame,
    window: int = 6,
    threshold: float = 0.001,
    late: str = "10 minutes",
    idle: float = 86_400,
    keys: Sequence[str] = tuple(SERIES),
    ts: str = "ts",
    row_no: str = "row_no",
    value: str = "value",
) -> DataFrame:
    """``keys, ts, row_no, value, rolling_std, is_frozen`` of every reading, in append mode, as the batch form gives them.

    ``ts`` must be a TIMESTAMP. Readings may arrive in any order up to ``late`` behind the newest; each comes out once the
    watermark has passed it, after all that precede it by time and row number. Later ones are dropped.
    State per series: the readings not yet final, ``window - 1`` values, and nothing once ``idle`` seconds
    have gone by without a reading; after such a gap between two readings the series begins anew, without a past. Readings without a time are left out, a null value
    empties the windows that hold it, a null key is a key, and of readings equal in series, time and row number the
    last to arrive counts. Needs the state store of ``STATE_STORE``.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    given = df.where(F.col(ts).isNotNull()).select(
        *keys, ts, F.unix_micros(ts).alias("_us"), F.coalesce(F.col(row_no).cast("bigint"), F.lit(-1)).alias("_row_no"), F.col(value).cast("double").alias("_value")
    )
    found = (
        given.withWatermark(ts, late)
        .groupBy(*keys)
        .transformWithState(
            FrozenProcessor(keys, window, threshold, int(idle * 1000)),
            f"{fields}, _us bigint, _row_no bigint, _value double, rolling_std double, is_frozen boolean",
            "append",
            "eventTime",
        )
    )
    return found.select(
        *keys, F.timestamp_micros("_us").alias(ts), F.nullif("_row_no", F.lit(-1)).alias(row_no), F.col("_value").alias(value), "rolling_std", "is_frozen"
    )
