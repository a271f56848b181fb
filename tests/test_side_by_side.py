"""Fits side by side: equal to fits one by one, one read of the input, failures stay alone."""

import random
import threading

import pytest

from plantspark.operators import model


@pytest.fixture(scope="module")
def plant(spark):
    r, rows = random.Random(3), []
    for i in range(400):
        a, b = r.uniform(0, 10), r.uniform(0, 10)
        rows.append((i, a, b, 3 * a + b, a - 2 * b, None if i % 2 else 5.0))
    return spark.createDataFrame(rows, "id int, a double, b double, first double, second double, third double").repartition(5)


CFG = model.ModelConfig(features=("a", "b"), use_time_features=False, kind="gbt", trees=4, depth=4, row_keys=("id",))


def test_targets_as_one_by_one_from_one_read(spark, plant):
    seen = spark.sparkContext.accumulator(0)

    def scan(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    models, log = model.train_targets(plant.mapInArrow(scan, plant.schema), ["first", "missing", "second", "third"], CFG, parallel=3)
    assert seen.value == 400
    status = {r.target: (r.status, r.message) for r in log.collect()}
    assert [status[t][0] for t in ("first", "missing", "second", "third")] == ["ok", "failed", "ok", "ok"] and "missing" in status["missing"][1]
    for t in ("first", "second"):
        alone = model.train(plant, model.replace(CFG, target=t))
        assert models[t].metrics["n"] == alone.metrics["n"] and models[t].metrics["rmse"] == pytest.approx(alone.metrics["rmse"], rel=1e-9)
        assert models[t].metrics["r2"] > 0.7


def test_jobs_run_at_the_same_time_in_groups_of_their_own(spark):
    meet, seen = threading.Barrier(3, timeout=30), {}
    spark.sparkContext.setLocalProperty("my.property", "kept")

    def job(name):
        meet.wait()
        sc = spark.sparkContext
        seen[name] = (sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.scheduler.pool"), sc.getLocalProperty("my.property"))
        if name == "b":
            raise ValueError("only b")
        return spark.range(10).count()

    done = model.side_by_side(spark, {n: lambda n=n: job(n) for n in "abc"}, parallel=3)
    assert done == {"a": (10, None), "b": (None, "only b"), "c": (10, None)}
    assert seen["a"] == ("fits: a", "fits", "kept") and spark.sparkContext.getLocalProperty("spark.scheduler.pool") != "fits"


def test_search_keeps_the_best_on_rows_that_never_change(spark, plant):
    cfg = model.replace(CFG, target="first")
    found, results = model.search(plant, cfg, {"maxDepth": [1, 5], "maxIter": [1, 6]})
    again = model.search(plant.repartition(2), cfg, {"maxDepth": [1, 5], "maxIter": [1, 6]})[1]
    assert len(results) == 4 and found.metrics["rmse"] == min(r["rmse"] for r in results)
    by = {(r["maxDepth"], r["maxIter"]): r["rmse"] for r in results}
    assert by[5, 6] < by[1, 1] / 2
    assert [r["rmse"] for r in again] == pytest.approx([r["rmse"] for r in results], rel=1e-9)
    assert found.score(plant).count() == 400
    partly, results = model.search(plant, cfg, {"maxDepth": [2, 99]})
    assert "error" in results[1] and results[1]["rmse"] is None and partly.metrics["rmse"] == results[0]["rmse"]
    with pytest.raises(ValueError, match="no combination"):
        model.search(plant, cfg, {"maxDepth": [99]})
