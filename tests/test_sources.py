"""CSV, Parquet layout and contract, batches with a manifest, run history, streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.operators import quality
from plantspark.operators import resample as rs
from plantspark.schema import READINGS
from plantspark.session import tune
from plantspark.sources import tables as tb
from plantspark.streaming import live

T0 = datetime(2024, 1, 30)


@pytest.fixture()
def readings(spark):
    rows = [("a", "f", i, T0 + timedelta(hours=6 * i), f"s{i % 2}", float(i)) for i in range(20)]
    return spark.createDataFrame(rows, READINGS)


def test_csv(spark, readings, tmp_path, rows):
    tb.write_csv(readings, str(tmp_path / "c"))
    assert tb.read_csv(spark, str(tmp_path / "c")).count() == 20
    again = tb.read_csv(spark, str(tmp_path / "c"), READINGS)
    assert rows(again) == rows(readings)
    assert tb.read_scenarios(spark, str(tmp_path / "c"), READINGS).count() == 20


def test_parquet_layout(spark, readings, tmp_path):
    df = readings.withColumn("quality_flags", F.array(F.lit("FROZEN"))).withColumn("device_role", F.lit("x"))
    tb.write_readings(df, str(tmp_path / "p"), rows_per_file=3)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert {(r.year, r.month) for r in back.select("year", "month").distinct().collect()} == {(2024, 1), (2024, 2)}
    assert back.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] <= 3
    assert "device_role" not in back.columns and back.schema["quality_flags"].dataType.simpleString() == "string"
    tb.verify_parquet(spark, str(tmp_path / "p"))
    assert sum(1 for _ in (tmp_path / "p" / "year=2024").iterdir()) == 2


def test_contract_breaches(spark, readings):
    bad = readings.withColumn("ts", F.col("ts").cast("string")).withColumn("is_target", F.lit(True)).withColumn("quality_flags", F.array(F.lit("x")))
    assert len(tb.check_schema(bad.schema)) == 3
    assert tb.check_schema(readings.drop("ts").schema) == ["column ts is missing"]


def test_batch_roundtrip(spark, readings, tmp_path, rows):
    path = str(tmp_path / "b")
    tb.write_batch(readings, path, "site_a", T0, {"s0": {"unit": "kW"}}, {"schema_version": "1.2"})
    df, m = tb.read_batch(spark, path, schema_version="1.2")
    assert rows(df.select(readings.columns)) == rows(readings)
    assert m["stats"]["total_rows"] == 20 and m["site_id"] == "site_a" and m["files_count"] >= 2
    with pytest.raises(tb.ContractError, match="vocabulary"):
        tb.read_batch(spark, path, vocabulary=["FROZEN"])
    with pytest.raises(tb.ContractError, match="version"):
        tb.read_batch(spark, path, schema_version="9")
    sums = tb.file_checksums(spark, path + "/data").collect()
    assert all(len(r.sha256) == 64 for r in sums)
    spark.createDataFrame([("{}", "0")], "manifest string, checksum string").write.mode("overwrite").json(path + "/manifest")
    with pytest.raises(tb.ContractError, match="damaged"):
        tb.read_batch(spark, path)


def test_run_history(spark, tmp_path):
    h = tb.RunHistory(spark, str(tmp_path / "runs"))
    assert h.all().count() == 0
    cols = [c for c in spark.createDataFrame([], tb.RUNS).columns if c not in ("run_id", "timestamp", "model_name", "method")]
    run = spark.range(3).select(
        F.col("id").cast("string").alias("run_id"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"), F.lit("m").alias("model_name"),
        F.lit("grid").alias("method"), *[F.col("id").cast("double").alias(c) for c in cols],
    )
    h.append(run)
    h.append(run.withColumn("run_id", F.concat(F.lit("x"), "run_id")))
    assert h.all().count() == 6
    assert h.delete("x1") and not h.delete("nope")
    assert h.all().count() == 5
    h.clear()
    assert h.all().count() == 0


def test_tune(spark):
    assert tune(spark).conf.get("spark.sql.adaptive.enabled") == "true"


# ------------------------------------------------------------------ streams


@pytest.fixture()
def stream(spark, tmp_path):
    """A file stream that delivers one batch per file, and the same rows as a batch frame."""
    start = datetime(2024, 1, 1)
    rows_ = [("a", start + timedelta(minutes=i), "x_KW", 5.0 if i < 8 else float(i)) for i in range(30)]
    schema = "site_id string, ts timestamp, sensor string, value double"
    batch = spark.createDataFrame(rows_, schema)
    for k in range(3):
        batch.where((F.minute("ts") >= 10 * k) & (F.minute("ts") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live_df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return live_df, batch


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_stream_resample(stream, rows):
    live_df, batch = stream
    out = drain(live.resample_stream(live_df, "5 minutes", late="1 minute"), "resampled", "append")
    full = batch.withColumn("row_no", F.lit(0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = rs.resample(full, "5 minutes")
    got = {r.ts: r.value for r in out.collect()}
    ref = {r.ts: r.value for r in want.collect()}
    assert len(got) >= 4 and all(ref[k] == v for k, v in got.items())


def test_stream_resample_breaks_ties_as_the_batch_does(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows_ = [("a", start + timedelta(minutes=i // 3), "m_KWH", float(i * 7 % 11), i) for i in range(60)]
    schema = "site_id string, ts timestamp, sensor string, value double, row_no long"
    batch = spark.createDataFrame(rows_, schema).repartition(4)
    batch.write.parquet(str(tmp_path / "ties"))
    live_df = spark.readStream.schema(schema).parquet(str(tmp_path / "ties"))
    out = drain(live.resample_stream(live_df, "5 minutes", late="0 seconds"), "ties", "append")
    want = {r.ts: r.value for r in rs.resample(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "5 minutes").collect()}
    got = {r.ts: r.value for r in out.collect()}
    assert len(got) >= 2 and all(want[k] == v for k, v in got.items())


def test_stream_keep_first(stream):
    live_df, batch = stream
    twice = live_df.withColumn("v2", F.explode(F.array("value", "value"))).drop("value").withColumnRenamed("v2", "value")
    assert drain(live.keep_first_stream(twice), "deduped", "append").count() == batch.count()


def test_batch_files_are_checked(spark, readings, tmp_path):
    path = str(tmp_path / "batch")
    tb.write_batch(readings, path, "s", datetime(2024, 1, 1))
    assert tb.read_batch(spark, path)[0].count() == readings.count()
    readings.limit(1).write.parquet(path + "/data/year=2030/month=1")
    with pytest.raises(tb.ContractError, match="foreign"):
        tb.read_batch(spark, path)
