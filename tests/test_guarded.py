"""Guards observed while writing: one read of the input, commits that readers see, batches turned away."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.sources import guarded

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, load double, kw double, bad boolean"


@pytest.fixture()
def batch(spark):
    def make(n=40, bad=5, nulls=3):
        rows = [(T0 + timedelta(hours=i), None if i < nulls else float(i), float("nan") if i == 10 else 1.0, i < bad if i % 7 else None) for i in range(n)]
        return spark.createDataFrame([*rows, (None, 1.0, 1.0, None)], SCHEMA).repartition(4)

    return make


def test_all_guards_in_one_write(spark, batch, tmp_path):
    path, before = str(tmp_path / "b"), []
    guards = [
        guarded.invalid_share(F.col("bad"), 0.3),
        guarded.minimum_samples(["load"], "kw", 20),
        guarded.no_leakage(T0 + timedelta(hours=30), exclude=True),
        guarded.report(F.col("load").isNull(), F.col("bad"), F.col("kw") > 0),
    ]
    done = guarded.write_guarded(batch(), path, guards)
    want = {"rows_in": 41, "invalid_rows": 4, "complete_rows": 37, "lacking_load": 3, "lacking_kw": 1, "rows_after_cutoff": 9, "rows_filled": 3, "rows_failed": 4, "rows_steady": 41}
    assert done.metrics == want and not done.problems and not before
    read = guarded.read_committed(spark, path)
    assert read.count() == 32 and {r.batch_tags for r in read.collect()} == {""}
    assert guarded.commits(spark, path).first().metrics == want


def test_the_input_is_read_once(spark, batch, tmp_path):
    """A counter on the rows: as many as there are, though four guards look at them."""
    seen = spark.sparkContext.accumulator(0)

    def scan(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = batch().mapInArrow(scan, SCHEMA)
    guarded.write_guarded(df, str(tmp_path / "b"), [guarded.invalid_share(F.col("bad")), guarded.minimum_samples(["load"], "kw")])
    assert seen.value == 41


def test_rejected_batches_are_never_read(spark, batch, tmp_path):
    path = str(tmp_path / "b")
    guarded.write_guarded(batch(), path, [guarded.invalid_share(F.col("bad"))])
    with pytest.raises(guarded.BatchRejected, match="12.5%|limit 5.0%") as e:
        guarded.write_guarded(batch(), path, [guarded.invalid_share(F.col("bad"), 0.05)])
    assert e.value.metrics["invalid_rows"] == 4
    with pytest.raises(guarded.BatchRejected, match=re.escape("0 complete rows, 10 needed; most nulls: [('load', 40), ('kw', 1)]")):
        guarded.write_guarded(batch(nulls=99).where("ts IS NOT NULL"), path, [guarded.minimum_samples(["load"], "kw")])
    with pytest.raises(guarded.BatchRejected, match="39 rows after"):
        guarded.write_guarded(batch(), path, [guarded.no_leakage(T0)])
    assert guarded.read_committed(spark, path).count() == 41 and guarded.commits(spark, path).count() == 1


def test_tagged_batches(spark, batch, tmp_path):
    path = str(tmp_path / "b")
    done = guarded.write_guarded(batch(bad=40), path, [guarded.invalid_share(F.col("bad"), on_trip="tag")])
    assert done.tags == [guarded.SUSPICIOUS] and len(done.problems) == 1
    guarded.write_guarded(batch(), path, [guarded.invalid_share(F.col("bad"), on_trip="tag")], partition_by=["bad"])
    assert {r.batch_tags: r["count"] for r in guarded.read_committed(spark, path).groupBy("batch_tags").count().collect()} == {guarded.SUSPICIOUS: 41, "": 41}


def test_empty_batch(spark, batch, tmp_path):
    none = batch().where("load < -5")
    done = guarded.write_guarded(none, str(tmp_path / "b"), [guarded.invalid_share(F.col("bad"))])
    assert done.metrics == {"rows_in": 0, "invalid_rows": 0}
    with pytest.raises(guarded.BatchRejected):
        guarded.write_guarded(none, str(tmp_path / "b"), [guarded.minimum_samples(["load"], "kw", 1)])
    with pytest.raises(ValueError, match="same name"):
        guarded.write_guarded(none, str(tmp_path / "b"), [guarded.no_leakage(T0), guarded.no_leakage(T0)])


def test_split_leakage(batch):
    kept, gone = guarded.split_leakage(batch(), T0 + timedelta(hours=30), ["bad"])
    assert kept.count() == 32 and sum(r.n_excluded for r in gone.collect()) == 9
