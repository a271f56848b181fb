"""Queries for model metrics, consistency checks and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.functions.timefx import epoch_micros
from plantspark.operators import consistency as co
from plantspark.operators import features, model
from plantspark.operators import setpoints as sp
from plantspark.plans import ranks
from plantspark.queries.registry import PLANT, meters, plant, query, r6, table

_PAIRS = """comp AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS component_kw, count(*) AS n_components,
         avg(l_quantity) * 2.0 AS load_pct, 12.0 + avg(l_discount) * 200.0 AS wet_bulb FROM lineitem GROUP BY 1),
pairs AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS system_kw, comp.* FROM orders JOIN comp ON o_orderkey = l_orderkey)"""


def pairs(spark, sf):
    parts = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("kw"),
        "l_quantity",
        "l_discount",
    )
    system = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("system_kw"))
    extra = {"load_pct": F.avg("l_quantity") * 2.0, "wet_bulb": F.lit(12.0) + F.avg("l_discount") * 200.0}
    return co.compare(system, parts, ["o_orderkey"], "kw", extra)


_METRICS = """count(*) AS n, round(avg(CASE WHEN abs(system_kw) > 1e-6 THEN abs((system_kw - component_kw) / system_kw) END) * 100.0, 6) AS mape,
  round(sqrt(avg(pow(system_kw - component_kw, 2))), 3) AS rmse, round(avg(abs(system_kw - component_kw)), 3) AS mae,
  round(1.0 - sum(pow(system_kw - component_kw, 2)) / (var_pop(system_kw) * count(*)), 6) AS r2"""


def _rounded(df, *keys):
    return df.select(*keys, "n", r6("mape"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), r6("r2"))


@query("regression_metrics", f"WITH {_PAIRS} SELECT {_METRICS} FROM pairs")
def regression_metrics(spark, sf):
    return _rounded(model.regression_metrics(pairs(spark, sf), "system_kw", "component_kw"))


@query("regression_metrics_by_key", f"WITH {_PAIRS} SELECT o_orderpriority, {_METRICS} FROM pairs GROUP BY 1")
def regression_metrics_by_key(spark, sf):
    m = model.regression_metrics(pairs(spark, sf), "system_kw", "component_kw", ["o_orderpriority"])
    return _rounded(m, "o_orderpriority")


_TOL = """least(5.0 * CASE WHEN load_pct < 30 THEN 1.5 WHEN load_pct > 70 THEN 0.8 ELSE 1.0 END
    * CASE WHEN n_components = 1 THEN 0.9 WHEN n_components = 2 THEN 1.0 ELSE 1.0 + (n_components - 2) * 0.1 END + 0.5, 15.0)"""

BIN_SQL = f"""{_PAIRS}, fam AS (
  SELECT 'load' AS family, CASE WHEN load_pct < 30 THEN 'light' WHEN load_pct > 70 THEN 'heavy' ELSE 'medium' END AS bin, *, {_TOL} AS tol FROM pairs
  UNION ALL SELECT 'ambient', CASE WHEN wet_bulb < 20 THEN 'low' WHEN wet_bulb > 26 THEN 'high' ELSE 'mid' END, *, {_TOL} FROM pairs
  UNION ALL SELECT 'combo', CASE WHEN n_components = 1 THEN 'single' WHEN n_components = 2 THEN 'dual' ELSE 'multi' END, *, {_TOL} FROM pairs),
bins AS (SELECT family, bin, avg(abs(system_kw - component_kw) / system_kw) * 100.0 AS mape, avg(abs(system_kw - component_kw)) AS mae,
    avg(component_kw - system_kw) AS bias, avg(system_kw) AS mean_system, count(*) AS n_samples, avg(tol) AS tolerance
  FROM fam GROUP BY 1, 2 HAVING count(*) >= 10)"""


def bins(spark, sf):
    families = {
        "load": co.load_bin(F.col("load_pct")),
        "ambient": co.ambient_bin(F.col("wet_bulb")),
        "combo": co.combo_bin(F.col("n_components")),
    }
    tol = co.dynamic_tolerance(F.col("load_pct"), F.col("n_components"))
    return co.binned_metrics(pairs(spark, sf), "system_kw", "component_kw", families, tol)


@query(
    "consistency_bins",
    f"""
WITH {BIN_SQL}
SELECT family, bin, round(mape, 6) AS mape, round(mae, 3) AS mae, round(bias, 3) AS bias, round(mean_system, 3) AS mean_system,
       n_samples, round(tolerance, 6) AS tolerance FROM bins""",
)
def consistency_bins(spark, sf):
    b = bins(spark, sf)
    r3 = [F.round(c, 3).alias(c) for c in ("mae", "bias", "mean_system")]
    return b.select("family", "bin", r6("mape"), *r3, "n_samples", r6("tolerance"))


_OVERALL = """avg(abs(system_kw - component_kw) / system_kw) * 100.0 AS mape, corr(system_kw, component_kw) AS correlation,
  avg(component_kw - system_kw) AS bias, avg(component_kw - system_kw) * 100.0 / avg(system_kw) AS bias_percent,
  max(abs(system_kw - component_kw)) AS max_error, count(*) AS n_samples"""


@query(
    "consistency_overall",
    f"""
WITH {_PAIRS}, o AS (SELECT {_OVERALL} FROM pairs)
SELECT round(mape, 6) AS mape, round(correlation, 6) AS correlation, round(bias, 3) AS bias, round(bias_percent, 6) AS bias_percent,
       round(max_error, 3) AS max_error, n_samples FROM o""",
)
def consistency_overall(spark, sf):
    o = co.overall_stats(pairs(spark, sf), "system_kw", "component_kw")
    return o.select(
        r6("mape"), r6("correlation"), F.round("bias", 3).alias("bias"), r6("bias_percent"), F.round("max_error", 3).alias("max_error"), "n_samples"
    )


@query(
    "coupling_factor",
    f"""
WITH {BIN_SQL}
SELECT bin, round(CASE WHEN bias > 0 THEN 1.0 + bias / mean_system ELSE 1.0 END, 3) AS gamma FROM bins WHERE family = 'load'""",
)
def coupling_factor(spark, sf):
    return co.coupling_factor(bins(spark, sf))


@query(
    "dynamic_tolerance",
    f"WITH {_PAIRS} SELECT o_orderkey, round({_TOL}, 6) AS tolerance FROM pairs",
)
def dynamic_tolerance(spark, sf):
    tol = co.dynamic_tolerance(F.col("load_pct"), F.col("n_components"))
    return pairs(spark, sf).select("o_orderkey", r6(tol, "tolerance"))


@query(
    "consistency_verdict",
    f"""
WITH {BIN_SQL}, o AS (SELECT {_OVERALL} FROM pairs),
v AS (SELECT o.*, (SELECT count(*) FROM bins WHERE mape >= tolerance) AS bins_over,
        (SELECT count(*) FROM bins WHERE family = 'load' AND bin = 'light' AND mape > 5 AND mape < tolerance) AS light_high FROM o),
f AS (SELECT n_samples, bins_over,
        concat_ws(',', CASE WHEN bins_over > 0 THEN 'EXCEEDS_DYNAMIC_TOLERANCE' END, CASE WHEN abs(bias_percent) > 5 THEN 'SYSTEMATIC_BIAS_DETECTED' END,
          CASE WHEN correlation < 0.95 THEN 'TREND_MISMATCH' END, CASE WHEN max_error > 50 THEN 'OUTLIER_VIOLATION' END) AS failures,
        concat_ws(',', CASE WHEN abs(bias_percent) > 3 AND abs(bias_percent) <= 5 THEN 'COUPLING_EFFECT_DETECTED' END,
          CASE WHEN light_high = 1 THEN 'LIGHT_LOAD_HIGH_VARIANCE' END) AS warnings FROM v)
SELECT *, CASE WHEN failures <> '' THEN 'FAIL' WHEN warnings <> '' THEN 'WARNING' ELSE 'FULL_CONSISTENCY' END AS verdict FROM f""",
)
def consistency_verdict(spark, sf):
    v = co.verdict(bins(spark, sf), co.overall_stats(pairs(spark, sf), "system_kw", "component_kw"))
    return v.select(
        "n_samples", "bins_over", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"), "verdict"
    )


@query(
    "system_discrepancy",
    f"""
WITH {_PAIRS}, d AS (SELECT max(abs(system_kw - component_kw) / system_kw) * 100.0 AS m FROM pairs)
SELECT round(m, 6) AS max_discrepancy, CASE WHEN m > 15 THEN 'FAIL' WHEN m > 5 THEN 'WARNING' ELSE 'OK' END AS status FROM d""",
)
def system_discrepancy(spark, sf):
    return co.discrepancy(pairs(spark, sf), "system_kw", "component_kw").withColumn("max_discrepancy", r6("max_discrepancy"))


@query(
    "missing_components",
    """
WITH c AS (SELECT l_orderkey, sum(l_extendedprice) AS total, coalesce(sum(l_extendedprice) FILTER (l_linenumber <= 3), 0) AS avail,
             count(*) FILTER (l_linenumber > 3) AS n_missing FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey, o_totalprice AS s, avail, n_missing, avail / total AS ratio, avail / 3.0 * n_missing AS est
      FROM orders JOIN c ON o_orderkey = l_orderkey)
SELECT o_orderkey, n_missing, round(CASE WHEN n_missing = 0 THEN avail WHEN ratio > 0.8 THEN avail + (s - avail) * 0.5
         WHEN n_missing <= 2 THEN avail + est END, 6) AS component_kw,
       round(CASE WHEN n_missing = 0 THEN 1.0 WHEN ratio > 0.8 THEN ratio WHEN n_missing <= 2 THEN ratio * 0.8 ELSE 0.0 END, 6) AS confidence
FROM p""",
)
def missing_components(spark, sf):
    known = F.col("l_linenumber") <= 3
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("total"),
        F.coalesce(F.sum(F.when(known, F.col("l_extendedprice"))), F.lit(0.0)).alias("avail"),
        F.sum((~known).cast("long")).alias("n_missing"),
    )
    p = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(c, "o_orderkey")
    out = co.impute_missing(
        F.col("o_totalprice"),
        F.col("avail"),
        F.col("n_missing"),
        F.col("avail") / F.col("total"),
        F.col("avail") / 3.0 * F.col("n_missing"),
    )
    return p.select("o_orderkey", "n_missing", *[r6(v, k) for k, v in out.items()])


@query(
    "model_eligibility",
    """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, n, concat_ws(',', CASE WHEN n >= 100 THEN 'random_forest' END, CASE WHEN n >= 500 THEN 'xgboost' END,
         CASE WHEN n >= 1000 THEN 'lightgbm' END) AS eligible FROM c""",
)
def model_eligibility(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("eligible", F.array_join(model.eligible_models(F.col("n")), ","))


@query(
    "feature_overlap",
    """
WITH i AS (SELECT l_suppkey, l_partkey, max((l_returnflag = 'A')::INT) AS a, max((l_returnflag = 'N')::INT) AS b FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(a * b) AS BIGINT) AS n_both, round(sum(a * b)::DOUBLE / nullif(sum(a), 0), 6) AS overlap
FROM i GROUP BY 1""",
)
def feature_overlap(spark, sf):
    li = table(spark, sf, "lineitem")
    o = features.membership_overlap(li, ["l_suppkey"], "l_partkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N")
    return o.withColumn("overlap", r6("overlap"))


@query(
    "time_split_cut",
    """
WITH n AS (SELECT count(*) AS n FROM lineitem),
c AS (SELECT l_shipdate AS cut FROM lineitem ORDER BY l_shipdate LIMIT 1 OFFSET (SELECT CAST(floor((n - 1) * 0.8) AS BIGINT) FROM n))
SELECT l_orderkey AS run, l_linenumber AS line, date_diff('microsecond', TIMESTAMP '1970-01-01', cut) AS cut_us,
       CASE WHEN l_shipdate <= cut THEN 'train' ELSE 'test' END AS side
FROM lineitem, c""",
)
def time_split_cut(spark, sf):
    m = meters(spark, sf).select("run", "line", "ts")
    train, test = model.time_split(m, "ts")
    cut = F.lit(model.split_moment(m, "ts")).cast("bigint").alias("cut_us")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.select("run", "line", cut, "side")


@query(
    "refined_quantiles",
    """
SELECT event_type, count(*) AS n, round(quantile_cont(ms, 0.05), 1) AS p05, round(quantile_cont(ms, 0.5), 1) AS p50,
       round(quantile_cont(ms, 0.999), 1) AS p999
FROM (SELECT event_type, date_diff('microsecond', TIMESTAMP '1970-01-01', ts)::DOUBLE / 1000::DOUBLE AS ms FROM events) GROUP BY 1""",
)
def refined_quantiles(spark, sf):
    """Quantiles of times, which agree in their first digits; buckets are split down to 20 rows."""
    e = table(spark, sf, "events").select("event_type", (epoch_micros("ts") / F.lit(1000.0)).alias("ms"))
    q = ranks.refined_quantiles(e, ["event_type"], "ms", {"p05": 0.05, "p50": 0.5, "p999": 0.999}, max_values=20)
    return q.select("event_type", "n", *[F.round(c, 1).alias(c) for c in ("p05", "p50", "p999")])


# ------------------------------------------------------------------ fitted models
# Predictions have no SQL; the queries return what must hold for every row, whatever the trees look like.


def _config(kind: str, trees: int) -> model.ModelConfig:
    return model.ModelConfig(features=("hz", "rh", "temp"), target="kw", ts="ts", kind=kind, trees=trees, depth=4, row_keys=("run", "line"))


_TEST_ROW = "('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 7))::BIGINT < 53687091"


@query(
    "train_score_gbt",
    f"SELECT l_orderkey AS run, l_linenumber AS line, l_extendedprice AS kw, {_TEST_ROW} AS is_test, true AS scored FROM lineitem",
)
def train_score_gbt(spark, sf):
    m = meters(spark, sf)
    fitted = model.train(m, _config("gbt", 8))
    scored = fitted.score(m)
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < 1e12)
    return scored.select("run", "line", "kw", model.is_test(["run", "line"]).alias("is_test"), finite.alias("scored"))


@query(
    "models_learn",
    f"""
WITH kinds AS (SELECT unnest(['gbt', 'random_forest']) AS kind)
SELECT kind, count(*) AS n_test, true AS halves_the_error
FROM lineitem, kinds WHERE {_TEST_ROW} GROUP BY 1""",
)
def models_learn(spark, sf):
    """Power by a formula of the inputs; on test rows a model must err less than half as much as the mean of the training rows."""
    power = F.lit(12.0) * F.col("hz") + F.when(F.col("rh") > 50, F.lit(150.0)).otherwise(F.lit(0.0)) + F.lit(2.0) * F.col("temp")
    m = meters(spark, sf).withColumn("kw", power)
    train, test = model.hash_split(m, ["run", "line"])
    mean = train.agg(F.avg("kw")).first()[0]
    plain = test.agg(F.count("*"), F.sqrt(F.avg((F.col("kw") - mean) * (F.col("kw") - mean)))).first()
    rows = []
    for kind, fitted in model.train_kinds(m, _config("gbt", 8), ("gbt", "random_forest")).items():
        found = fitted.metrics
        rows.append((kind, found["n"], bool(found["rmse"] < plain[1] / 2 and found["n"] == plain[0])))
    return spark.createDataFrame(rows, "kind string, n_test long, halves_the_error boolean")


@query(
    "rf_interval",
    "SELECT l_orderkey AS run, l_linenumber AS line, true AS in_order, true AS in_label_range FROM lineitem",
)
def rf_interval(spark, sf):
    m = meters(spark, sf)
    fitted = model.train(m, _config("random_forest", 8), split="time")
    low, high = m.agg(F.min("kw"), F.max("kw")).first()
    p = model.predict_interval(fitted, m)
    inside = (F.col("lower") >= low - 1e-6) & (F.col("upper") <= high + 1e-6) & F.col("mean").between(low - 1e-6, high + 1e-6)
    return p.select("run", "line", ((F.col("lower") <= F.col("upper")) & (F.col("std") >= 0)).alias("in_order"), inside.alias("in_label_range"))


@query(
    "importance_rank",
    """
SELECT feature, 1.0::DOUBLE AS total, true AS in_order
FROM (VALUES ('hz'), ('rh'), ('temp'), ('hour'), ('month'), ('day_of_week'), ('is_weekend')) t(feature)""",
)
def importance_rank(spark, sf):
    ranked = model.train(meters(spark, sf), _config("random_forest", 5)).importance()
    falling = all(a[1] >= b[1] for a, b in zip(ranked, ranked[1:]))
    rows = [(name, round(sum(w for _, w in ranked), 6), falling) for name, _ in ranked]
    return spark.createDataFrame(rows, "feature string, total double, in_order boolean")


@query(
    "setpoint_by_model",
    f"""
WITH {PLANT}
SELECT site_id, ts, round(load_rt, 6) AS load_rt, true AS found, true AS on_axes, true AS not_worse
FROM plant""",
)
def setpoint_by_model(spark, sf):
    p = plant(spark, sf)
    cfg = model.ModelConfig(features=("load_rt", "pump_hz", "fan_hz"), target="power_kw", use_time_features=False, kind="random_forest", trees=5, depth=4, impute="mean", row_keys=("site_id", "ts"))
    fitted = model.train(p, cfg)
    contexts = p.select(F.concat_ws("|", "site_id", F.col("ts").cast("string")).alias("context_id"), "site_id", "ts", "load_rt")
    axes = {"chw_pump_hz": sp.hz_steps(), "ct_fan_hz": sp.hz_steps()}
    best = sp.best_setpoints_by_model(
        contexts, "context_id", fitted, lambda s: {"pump_hz": s["chw_pump_hz"], "fan_hz": s["ct_fan_hz"]}, axes
    )
    steps = [F.lit(x) for x in sp.hz_steps()]
    on_axes = F.col("best_chw_pump_hz").isin(steps) & F.col("best_ct_fan_hz").isin(steps)
    return best.select(
        "site_id",
        "ts",
        r6("load_rt"),
        F.col("best_kw").isNotNull().alias("found"),
        F.coalesce(on_axes, F.lit(False)).alias("on_axes"),
        F.coalesce(F.col("savings_kw") >= 0, F.lit(False)).alias("not_worse"),
    )
