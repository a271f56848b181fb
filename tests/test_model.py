"""Model training and scoring on the 200-row plant fixture."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantspark.operators import model as md

# Value ranges of the fixture columns.
RANGES = {
    "CH_0_RT": (100, 600), "CH_1_RT": (100, 600), "CH_2_RT": (0, 300), "CH_3_RT": (0, 300),
    "CHP_01_VFD_OUT": (35, 55), "CHP_02_VFD_OUT": (35, 55), "CHP_03_VFD_OUT": (0, 55),
    "CWP_01_VFD_OUT": (35, 55), "CWP_02_VFD_OUT": (35, 55), "CWP_03_VFD_OUT": (0, 55),
    "CT_01_VFD_OUT": (30, 60), "CT_02_VFD_OUT": (30, 60), "CT_03_VFD_OUT": (0, 60),
    "CH_0_SWT": (6, 8), "CH_0_RWT": (10, 14), "CW_SYS_SWT": (28, 34), "CW_SYS_RWT": (32, 38),
}


@pytest.fixture(scope="module")
def plant(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(200):
        r = {c: rnd.uniform(*lim) for c, lim in RANGES.items()}
        load = sum(v for c, v in r.items() if c.endswith("_RT"))
        pump = sum(v for c, v in r.items() if "P_0" in c) / 6
        fan = sum(v for c, v in r.items() if c.startswith("CT_")) / 3
        r["CH_SYS_TOTAL_KW"] = 0.7 * load + 10 * (pump / 50) ** 3 + 5 * (fan / 50) ** 3 + rnd.gauss(0, 10)
        rows.append((datetime(2024, 1, 1) + timedelta(minutes=i), *r.values()))
    cols = ["timestamp", *RANGES, "CH_SYS_TOTAL_KW"]
    return spark.createDataFrame(rows, cols).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).cache()


@pytest.fixture(scope="module")
def fitted(plant):
    return md.train(plant, md.ModelConfig(trees=12, depth=4))


def test_quality(fitted, plant):
    m = fitted.metrics
    assert set(m) == {"n", "mape", "rmse", "mae", "r2"} and m["r2"] <= 1
    assert m["mape"] < 20
    p = [r.prediction for r in fitted.score(plant.limit(10)).collect()]
    assert len(p) == 10 and all(x > 0 for x in p)


def test_features_keep_order(fitted):
    assert fitted.features[:4] == ["CH_0_RT", "CH_1_RT", "CH_2_RT", "CH_3_RT"]
    assert fitted.features[-4:] == md.TIME_FEATURES
    assert sum(w for _, w in fitted.importance()) == pytest.approx(1, abs=0.01)


def test_save_and_load(spark, fitted, plant, tmp_path):
    fitted.save(str(tmp_path / "m"))
    back = md.PowerModel.load(spark, str(tmp_path / "m"))
    assert back.features == fitted.features and back.metrics == fitted.metrics
    a = [r.prediction for r in fitted.score(plant).orderBy("timestamp").collect()]
    b = [r.prediction for r in back.score(plant).orderBy("timestamp").collect()]
    assert a == b


def test_order_mismatch_is_refused(fitted, plant):
    with pytest.raises(ValueError):
        fitted.score(plant.drop("CH_0_RT"))


def test_interval(plant):
    rf = md.train(plant, md.ModelConfig(kind="random_forest", trees=10, depth=5), split="time")
    out = md.predict_interval(rf, plant, 0.9)
    assert out.where((F.col("lower") > F.col("mean") + 1e-9) | (F.col("mean") > F.col("upper") + 1e-9)).count() == 0
    joined = out.join(rf.score(plant).select("timestamp", "prediction"), "timestamp")
    assert joined.where(F.abs(F.col("mean") - F.col("prediction")) > 1e-6).count() == 0


def test_time_split(plant):
    a, b = md.time_split(plant, "timestamp", 0.25)
    assert (a.count(), b.count()) == (150, 50)
    assert a.agg(F.max("timestamp")).first()[0] < b.agg(F.min("timestamp")).first()[0]


def test_impute_and_scale(plant):
    holes = plant.withColumn("CH_0_RT", F.when(F.col("CH_0_RT") > 200, F.col("CH_0_RT")))
    m = md.train(holes, md.ModelConfig(trees=5, depth=3, impute="median", scale=True, kind="random_forest"))
    assert m.score(holes).count() == 200


def test_several_targets(plant):
    models, log = md.train_targets(plant, ["CH_SYS_TOTAL_KW", "ABSENT"], md.ModelConfig(trees=3, depth=3))
    assert set(models) == {"CH_SYS_TOTAL_KW"}
    assert {r.target: r.status for r in log.collect()} == {"CH_SYS_TOTAL_KW": "ok", "ABSENT": "failed"}


def test_search(plant):
    cfg = md.ModelConfig(kind="random_forest", trees=5, depth=3)
    best, results = md.search(plant, cfg, {"maxDepth": [2, 4]})
    assert len(results) == 2 and best.metrics["rmse"] == min(r["rmse"] for r in results)


def test_metrics_of_three_points(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0), (0.0, 5.0)], "y double, p double")
    assert md.regression_metrics(df.where("y > 0"), "y", "p").first().mape == pytest.approx(8.33, abs=0.01)
    assert md.regression_metrics(df, "y", "p").first().mape == pytest.approx(8.33, abs=0.01)


def test_eligible(spark):
    df = spark.createDataFrame([(50,), (100,), (600,), (2000,)], "n int")
    assert [len(r[0]) for r in df.select(md.eligible_models(F.col("n"))).collect()] == [0, 1, 2, 3]


def test_too_few_rows(plant):
    with pytest.raises(ValueError, match="complete rows"):
        md.train(plant.limit(5))


def test_fits_work_on_bounded_parts_of_vectors(spark, plant, monkeypatch):
    """However the input lies, tasks of a fit hold few rows, with all of them and nothing computed twice."""
    monkeypatch.setattr(md, "FIT_ROWS", 10)
    monkeypatch.setattr(md, "MIN_FIT_ROWS", 2)
    ready, names = md.prepare(plant.coalesce(1), md.ModelConfig())
    with md._vectors(ready, md._stages(md.ModelConfig(), names)[:-1], names, 200) as (shaped, vectors):
        sizes = [r["count"] for r in vectors.groupBy(F.spark_partition_id()).count().collect()]
        label = vectors.agg(F.sum("label")).first()[0]
    assert sum(sizes) == 200 and max(sizes) <= 12 and len(shaped.stages) == 1
    assert label == pytest.approx(plant.agg(F.sum("CH_SYS_TOTAL_KW")).first()[0])


def test_kinds_side_by_side_equal_single_fits(plant):
    cfg = md.ModelConfig(trees=3, depth=3)
    both = md.train_kinds(plant, cfg, ("gbt", "random_forest"))
    assert list(both) == ["gbt", "random_forest"] and both["random_forest"].config.kind == "random_forest"
    for kind, fitted in both.items():
        alone = md.train(plant, md.ModelConfig(trees=3, depth=3, kind=kind))
        assert alone.metrics == fitted.metrics and alone.importance() == fitted.importance()


def test_test_rows_follow_the_number_of_the_hash(spark):
    ids = spark.range(2000)
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), 1, 7), 16, 10).cast("long")
    for share in (0.0, 1e-3, 0.2, 0.9999, 1.0, 1.5):
        assert ids.where(md.is_test(["id"], share) != (digits < int(share * 16**7))).count() == 0
