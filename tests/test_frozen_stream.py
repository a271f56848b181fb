"""The frozen check on shuffled micro-batches against the batch check."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.operators import quality
from plantspark.streaming import frozen

START = datetime(2024, 1, 1)
SCHEMA = "site_id string, sensor string, ts timestamp, row_no long, value double"
END = ("end", "end", START + timedelta(days=30), 0, 1.0)


@pytest.fixture()
def store(spark):
    before = {k: spark.conf.get(k, None) for k in frozen.STATE_STORE}
    for k, v in frozen.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def readings():
    """Two series with frozen stretches, ties in time, null values, and one of null name."""
    rnd, out = random.Random(4), []
    for sensor, step in (("kw", 60), (None, 90)):
        for i in range(60):
            value = 5.0 if 15 <= i < 30 else None if i % 23 == 7 else round(rnd.random() * 50, 3)
            out.append(("s", sensor, START + timedelta(seconds=step * (i - i % 20 % 2)), i, value))
    return out


def streamed(spark, path, batches, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i:03}")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")
    name = f"frozen_{abs(hash(str(path)))}"
    q = frozen.frozen_stream(live, **options).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{path}-state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).where("site_id <> 'end'"), q


def listed(df):
    cols = ["site_id", "sensor", F.col("ts").cast("timestamp_ntz").alias("ts"), "row_no", "value", "rolling_std", "is_frozen"]
    return sorted(((str(r.sensor), r.ts, r.row_no, r.value, None if r.rolling_std is None else round(r.rolling_std, 9), r.is_frozen) for r in df.select(*cols).collect()), key=str)


def batch(spark, rows):
    full = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return listed(quality.frozen_flags(full, 86_400, order=["ts", "row_no"]))


def test_shuffled_batches_give_the_batch_result(spark, store, tmp_path):
    rows = readings()
    shuffled = sorted(rows, key=lambda r, rnd=random.Random(1): r[2] + timedelta(seconds=rnd.randrange(600)))
    batches = [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)]
    got, _ = streamed(spark, tmp_path / "in", [*batches, [END], [END]], late="20 minutes")
    out = listed(got)
    assert out == batch(spark, rows) and sum(r[-1] for r in out) > 8


def test_too_late_readings_are_dropped_and_idle_state_ends(spark, store, tmp_path):
    def at(minute, value, no):
        return ("s", "kw", START + timedelta(minutes=minute), no, value)

    first = [at(i, 1.0, i) for i in range(8)]
    pause = [at(400, 1.0, 50)]
    late = [at(3, 9.0, 60)]
    again = [at(401 + i, 1.0, 70 + i) for i in range(5)]
    got, q = streamed(spark, tmp_path / "in", [first, pause, late, again, [END], [END]], late="5 minutes", idle=3600)
    out = {r[2]: r for r in listed(got)}
    assert 60 not in out, "four hundred minutes late"
    assert [out[i][-1] for i in range(8)] == [False] * 5 + [True] * 3
    assert not any(out[i][-1] for i in (50, 70, 71, 72, 73)) and out[74][-1], "the pause ended the state"
