"""Queries for set-point search, unit commitment and what-if questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.operators import setpoints as sp
from plantspark.operators.units import cheapest_units as cheapest
from plantspark.queries.registry import PLANT, plant, query, r6, table

AXES = {n: sp.hz_steps() for n in sp.SETPOINTS}

_GRID = "grid AS (SELECT a.v AS chw, b.v AS cw, c.v AS fan FROM ax a, ax b, ax c)"
_AX = "ax AS (SELECT 30.0 + 5.0 * i AS v FROM generate_series(0, 6) t(i))"


def _kw(chw: str, cw: str, fan: str) -> str:
    return f"""(0.7::DOUBLE * load_rt + 10.0::DOUBLE * pow((({chw}) + ({cw}))::DOUBLE / 2.0::DOUBLE / 50.0::DOUBLE, 3)
      + 5.0::DOUBLE * pow(({fan})::DOUBLE / 50.0::DOUBLE, 3)
      + 1.0::DOUBLE * load_rt * (pow(50.0::DOUBLE / ({chw})::DOUBLE - 1.0::DOUBLE, 2) + pow(50.0::DOUBLE / ({cw})::DOUBLE - 1.0::DOUBLE, 2)
      + pow(50.0::DOUBLE / ({fan})::DOUBLE - 1.0::DOUBLE, 2)))"""


CONTEXTS = f"""{PLANT}, ctx AS (
  SELECT site_id, ts, load_rt, power_kw, temp, CASE WHEN pump_hz IS NULL THEN NULL ELSE least(60.0, greatest(30.0, pump_hz)) END AS now_chw,
         CASE WHEN temp IS NULL THEN NULL ELSE least(60.0, greatest(30.0, temp)) END AS now_cw,
         CASE WHEN fan_hz IS NULL THEN NULL ELSE least(60.0, greatest(30.0, fan_hz)) END AS now_fan
  FROM plant)"""

NOW = ["now_chw", "now_cw", "now_fan"]


def contexts(spark, sf):
    p = plant(spark, sf)

    def bounded(c):
        return F.when(F.col(c).isNotNull(), F.least(F.lit(60.0), F.greatest(F.lit(30.0), F.col(c))))

    return p.select(
        "site_id", "ts", "load_rt", "power_kw", "temp", *[bounded(c).alias(n) for n, c in zip(NOW, ["pump_hz", "temp", "fan_hz"])]
    )


def scorer(s):
    return sp.analytic_power(s, F.col("load_rt"))


_RESULT = [f"best_{n}" for n in sp.SETPOINTS]

_BEST = f"""{CONTEXTS}, {_AX}, {_GRID}, scored AS (
  SELECT c.*, g.*, {_kw('chw', 'cw', 'fan')} AS kw FROM ctx c CROSS JOIN grid g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY kw, chw, cw, fan) AS rn FROM scored) WHERE rn = 1)"""

_SAVED = f"""SELECT site_id, ts, CASE WHEN kw IS NOT NULL THEN chw::DOUBLE END AS best_chw_pump_hz,
    CASE WHEN kw IS NOT NULL THEN cw::DOUBLE END AS best_cw_pump_hz, CASE WHEN kw IS NOT NULL THEN fan::DOUBLE END AS best_ct_fan_hz,
    round(kw, 6) AS best_kw, round(base, 6) AS baseline_kw, round(base - kw, 6) AS savings_kw,
    round(CASE WHEN base > 0 THEN (base - kw) / base * 100.0 ELSE 0.0 END, 6) AS savings_percent
  FROM (SELECT *, {_kw('coalesce(now_chw, 45.0)', 'coalesce(now_cw, 45.0)', 'coalesce(now_fan, 45.0)')} AS base FROM {{src}})"""


@query("setpoint_grid", f"WITH {_BEST} {_SAVED.format(src='best')}")
def setpoint_grid(spark, sf):
    out = sp.best_setpoints(contexts(spark, sf), scorer, AXES, NOW)
    return out.select("site_id", "ts", *_RESULT, *[r6(c) for c in ("best_kw", "baseline_kw", "savings_kw", "savings_percent")])


_REFINED = f"""{_BEST}, off AS (SELECT 1.0 * i AS d FROM generate_series(-2, 2) t(i)),
near AS (SELECT b.site_id, b.ts, b.load_rt, b.now_chw, b.now_cw, b.now_fan, greatest(30.0, least(60.0, b.chw + x.d)) AS chw,
           greatest(30.0, least(60.0, b.cw + y.d)) AS cw, greatest(30.0, least(60.0, b.fan + z.d)) AS fan
         FROM best b, off x, off y, off z),
near_kw AS (SELECT *, {_kw('chw', 'cw', 'fan')} AS kw FROM near),
fine AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY kw, chw, cw, fan) AS rn FROM near_kw) WHERE rn = 1)"""


@query("setpoint_refined", f"WITH {_REFINED} {_SAVED.format(src='fine')}")
def setpoint_refined(spark, sf):
    out = sp.best_setpoints(contexts(spark, sf), scorer, AXES, NOW, refine=1.0)
    return out.select("site_id", "ts", *_RESULT, *[r6(c) for c in ("best_kw", "baseline_kw", "savings_kw", "savings_percent")])


@query(
    "setpoint_constrained",
    f"""
WITH {CONTEXTS}, {_AX}, {_GRID}, scored AS (
  SELECT c.*, g.*, {_kw('chw', 'cw', 'fan')} AS kw FROM ctx c CROSS JOIN grid g WHERE chw + cw >= 80 AND fan <= temp AND load_rt IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY kw, chw, cw, fan) AS rn FROM scored) WHERE rn = 1)
SELECT c.site_id, c.ts, b.chw::DOUBLE AS best_chw_pump_hz, b.cw::DOUBLE AS best_cw_pump_hz, b.fan::DOUBLE AS best_ct_fan_hz, round(b.kw, 6) AS best_kw
FROM ctx c LEFT JOIN best b ON c.site_id = b.site_id AND c.ts = b.ts""",
)
def setpoint_constrained(spark, sf):
    out = sp.best_setpoints(
        contexts(spark, sf),
        scorer,
        AXES,
        NOW,
        feasible=lambda s: (s["chw_pump_hz"] + s["cw_pump_hz"] >= 80) & (s["ct_fan_hz"] <= F.col("temp")),
    )
    return out.select("site_id", "ts", *_RESULT, r6("best_kw"))


@query(
    "bound_violations",
    f"""
WITH {PLANT}
SELECT site_id, ts, concat_ws('; ', CASE WHEN pump_hz < 30 THEN 'CHW pump below minimum 30.0' END,
    CASE WHEN pump_hz > 60 THEN 'CHW pump above maximum 60.0' END, CASE WHEN fan_hz < 30 THEN 'CT fan below minimum 30.0' END,
    CASE WHEN fan_hz > 60 THEN 'CT fan above maximum 60.0' END) AS violations
FROM plant""",
)
def bound_violations(spark, sf):
    v = sp.bound_violations({"CHW pump": "pump_hz", "CT fan": "fan_hz"})
    return plant(spark, sf).select("site_id", "ts", F.array_join(v, "; ").alias("violations"))


_UNITS = """units AS (
  SELECT s_suppkey // 8 AS plant_no, s_nationkey, s_suppkey AS unit, floor(abs(s_acctbal)) + 1 AS cap,
         (floor(abs(s_acctbal)) + 1) * (60 + s_suppkey % 5 * 5) AS kw, s_suppkey % 3 % 2 AS now,
         (s_suppkey * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE AS eff
  FROM supplier)"""


def units(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    cap = F.floor(F.abs("s_acctbal")).cast("double") + 1
    return s.select(
        F.floor(key / 8).cast("long").alias("plant_no"),
        "s_nationkey",
        key.alias("unit"),
        cap.alias("cap"),
        (cap * (F.lit(60) + key % 5 * 5)).alias("kw"),
        (key % 3 % 2).alias("now"),
        ((key * 7919 % 1000).cast("double") / 1000.0).alias("eff"),
    )


@query(
    "unit_combinations",
    f"""
WITH {_UNITS}, u AS (SELECT *, row_number() OVER (PARTITION BY plant_no ORDER BY unit) - 1 AS idx FROM units),
n AS (SELECT plant_no, count(*) AS n, floor(sum(cap) / 2) AS target_rt FROM u GROUP BY 1),
m AS (SELECT plant_no, target_rt, unnest(generate_series(0::BIGINT, (1::BIGINT << n) - 1)) AS mask FROM n),
c AS (SELECT m.plant_no, m.mask, any_value(target_rt) AS target_rt, sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN cap ELSE 0 END) AS total_capacity,
        sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN kw ELSE 0 END) AS total_kw, bit_count(m.mask) AS n_on,
        sum(CASE WHEN ((m.mask >> idx) & 1) <> now THEN 1 ELSE 0 END) AS switches
      FROM m JOIN u USING (plant_no) GROUP BY ALL)
SELECT plant_no, mask, target_rt::DOUBLE AS target_rt, total_capacity::DOUBLE AS total_capacity,
       total_kw::DOUBLE AS total_kw, CAST(n_on AS INTEGER) AS n_on, CAST(switches AS INTEGER) AS switches,
       total_kw::DOUBLE + switches * 5.0::DOUBLE AS objective_kw
FROM c WHERE total_capacity >= target_rt""",
)
def unit_combinations(spark, sf):
    u = units(spark, sf)
    target = u.groupBy("plant_no").agg(F.floor(F.sum("cap") / 2).cast("double").alias("target_rt"))
    return sp.unit_combinations(u, "plant_no", "unit", "cap", "kw", target, current="now")


@query(
    "unit_combinations_twelve",
    f"""
WITH {_UNITS}, p AS (SELECT unit // 12 AS plant_no, unit, cap, kw FROM units),
u AS (SELECT *, row_number() OVER (PARTITION BY plant_no ORDER BY unit) - 1 AS idx FROM p),
n AS (SELECT plant_no, count(*) AS n, floor(sum(cap) * 0.8) AS target_rt FROM u GROUP BY 1),
m AS (SELECT plant_no, target_rt, unnest(generate_series(0::BIGINT, (1::BIGINT << n) - 1)) AS mask FROM n),
c AS (SELECT m.plant_no, m.mask, any_value(target_rt) AS target_rt, sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN cap ELSE 0 END) AS total_capacity,
        sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN kw ELSE 0 END) AS total_kw, bit_count(m.mask) AS n_on
      FROM m JOIN u USING (plant_no) WHERE m.mask & 3 <> 3 GROUP BY ALL)
SELECT plant_no, mask, target_rt::DOUBLE AS target_rt, total_capacity::DOUBLE AS total_capacity, total_kw::DOUBLE AS total_kw,
       CAST(n_on AS INTEGER) AS n_on, 0 AS switches, total_kw::DOUBLE AS objective_kw
FROM c WHERE total_capacity >= target_rt""",
)
def unit_combinations_twelve(spark, sf):
    """Plants of twelve units of which the first two exclude each other."""
    u = units(spark, sf).select(F.floor(F.col("unit") / 12).cast("long").alias("plant_no"), "unit", "cap", "kw")
    target = u.groupBy("plant_no").agg(F.floor(F.sum("cap") * 0.8).cast("double").alias("target_rt"))
    return sp.unit_combinations(u, "plant_no", "unit", "cap", "kw", target, mutex=lambda m: m.bitwiseAND(F.lit(3)) == 3)


@query(
    "cheapest_units",
    f"""
WITH {_UNITS}, p AS (SELECT unit // 12 AS plant_no, unit, cap, kw, now FROM units),
u AS (SELECT *, row_number() OVER (PARTITION BY plant_no ORDER BY unit) - 1 AS idx FROM p),
n AS (SELECT plant_no, count(*) AS n, floor(sum(cap) * 0.6) AS target_rt FROM u GROUP BY 1),
m AS (SELECT plant_no, target_rt, unnest(generate_series(0::BIGINT, (1::BIGINT << n) - 1)) AS mask FROM n),
c AS (SELECT m.plant_no, m.mask, any_value(target_rt) AS target_rt, sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN cap ELSE 0 END) AS total_capacity,
        sum(CASE WHEN (m.mask >> idx) & 1 = 1 THEN kw ELSE 0 END) AS total_kw,
        sum(CASE WHEN ((m.mask >> idx) & 1) <> now THEN 1 ELSE 0 END) AS switches
      FROM m JOIN u USING (plant_no) WHERE m.mask & 3 <> 3 GROUP BY ALL)
SELECT plant_no, any_value(target_rt)::DOUBLE AS target_rt, round(min(total_kw::DOUBLE + switches * 5.0::DOUBLE), 6) AS objective_kw, true AS carries
FROM c WHERE total_capacity >= target_rt GROUP BY 1""",
)
def cheapest_units(spark, sf):
    """The least objective over plants of twelve units, the first two of which exclude each other, from two trimmed halves."""
    no = F.floor(F.col("unit") / 12).cast("long")
    place = F.row_number().over(Window.partitionBy(no).orderBy("unit"))
    u = units(spark, sf).select(no.alias("plant_no"), "unit", "cap", "kw", "now", F.when(place <= 2, F.lit("first two")).alias("bound"))
    target = u.groupBy("plant_no").agg(F.floor(F.sum("cap") * 0.6).cast("double").alias("target_rt"))
    best = cheapest(u, "plant_no", "unit", "cap", "kw", target, current="now", group="bound")
    chosen = best.select("plant_no", F.explode("units").alias("name"))
    load = u.withColumn("name", F.col("unit").cast("string")).join(chosen, ["plant_no", "name"]).groupBy("plant_no").agg(F.sum("cap").alias("cap"))
    joined = best.join(load, "plant_no")
    return joined.select("plant_no", "target_rt", r6("objective_kw"), (F.col("cap") >= F.col("target_rt")).alias("carries"))


@query(
    "greedy_order",
    f"""
WITH {_UNITS}, t AS (SELECT s_nationkey, floor(sum(cap) * 0.4) AS target_rt FROM units GROUP BY 1),
r AS (SELECT *, sum(cap) OVER (PARTITION BY s_nationkey ORDER BY eff, unit ROWS UNBOUNDED PRECEDING) - cap AS capacity_before FROM units)
SELECT s_nationkey, unit, cap::DOUBLE AS cap, eff, target_rt::DOUBLE AS target_rt, capacity_before::DOUBLE AS capacity_before,
       capacity_before < target_rt AS is_on
FROM r JOIN t USING (s_nationkey)""",
)
def greedy_order(spark, sf):
    u = units(spark, sf).select("s_nationkey", "unit", "cap", "eff")
    target = u.groupBy("s_nationkey").agg(F.floor(F.sum("cap") * 0.4).cast("double").alias("target_rt"))
    return sp.greedy_order(u, "s_nationkey", "unit", "cap", "eff", target)


@query(
    "fallback_ladder",
    f"""
WITH {CONTEXTS}, {_AX}, {_GRID}, cand AS (
  SELECT c.site_id, c.ts, CASE WHEN chw + cw >= 75 AND fan <= c.temp / 2.0::DOUBLE THEN 0
           WHEN chw + cw >= 75 AND fan <= c.temp / 2.0::DOUBLE * 1.1::DOUBLE THEN 1 END AS level,
         {_kw('chw', 'cw', 'fan')} AS kw, chw::DOUBLE AS chw, cw::DOUBLE AS cw, fan::DOUBLE AS fan FROM ctx c CROSS JOIN grid g
  UNION ALL SELECT site_id, ts, CASE WHEN now_chw IS NOT NULL THEN 2 END, {_kw('50.0', '50.0', '50.0')}, 50.0, 50.0, 50.0 FROM ctx
  UNION ALL SELECT site_id, ts, 3, {_kw('now_chw', 'now_cw', 'now_fan')}, now_chw, now_cw, now_fan FROM ctx),
best AS (SELECT *, row_number() OVER (PARTITION BY site_id, ts ORDER BY level, kw NULLS FIRST, chw NULLS FIRST, cw NULLS FIRST, fan NULLS FIRST) AS rn
         FROM cand WHERE level IS NOT NULL)
SELECT site_id, ts, level, round(kw, 6) AS chosen_kw, round(chw, 6) AS chosen_chw_pump_hz, round(cw, 6) AS chosen_cw_pump_hz,
       round(fan, 6) AS chosen_ct_fan_hz
FROM best WHERE rn = 1""",
)
def fallback_ladder(spark, sf):
    out = sp.fallback_choice(
        contexts(spark, sf),
        scorer,
        AXES,
        lambda s: s["chw_pump_hz"] + s["cw_pump_hz"] >= 75,
        lambda s, relax: s["ct_fan_hz"] <= F.col("temp") / 2.0 * F.lit(1.0 + relax),
        {n: 50.0 for n in sp.SETPOINTS},
        NOW,
        greedy_usable=F.col("now_chw").isNotNull(),
    )
    return out.select("site_id", "ts", "level", r6("chosen_kw"), *[r6(f"chosen_{n}") for n in sp.SETPOINTS])


@query(
    "sensitivity",
    f"""
WITH {PLANT}, s AS (SELECT site_id, ts, load_rt AS l, temp / 2.0 AS w FROM plant)
SELECT site_id, ts, round(l * (0.55 + 0.012 * (w - 20.0)), 6) AS base_kw,
       round(l * (0.55 + 0.012 * (w - 1.0 - 20.0)) - l * (0.55 + 0.012 * (w - 20.0)), 6) AS wet_bulb_minus_1,
       round(l * (0.55 + 0.012 * (w + 1.0 - 20.0)) - l * (0.55 + 0.012 * (w - 20.0)), 6) AS wet_bulb_plus_1,
       round(l * 0.9 * (0.55 + 0.012 * (w - 20.0)) - l * (0.55 + 0.012 * (w - 20.0)), 6) AS load_minus_10,
       round(l * 1.1 * (0.55 + 0.012 * (w - 20.0)) - l * (0.55 + 0.012 * (w - 20.0)), 6) AS load_plus_10
FROM s""",
)
def sensitivity(spark, sf):
    shifts = {
        "wet_bulb_minus_1": ("wb", -1.0),
        "wet_bulb_plus_1": ("wb", 1.0),
        "load_minus_10": ("load", "x0.9"),
        "load_plus_10": ("load", "x1.1"),
    }
    out = sp.sensitivity(
        plant(spark, sf),
        lambda x: x["load"] * (F.lit(0.55) + F.lit(0.012) * (x["wb"] - F.lit(20.0))),
        {"load": F.col("load_rt"), "wb": F.col("temp") / 2.0},
        shifts,
    )
    return out.select("site_id", "ts", r6("base_kw"), *[r6(n) for n in shifts])


@query(
    "pareto_front",
    """
SELECT p_partkey, p_brand, p_retailprice, p_size FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_retailprice <= p.p_retailprice AND q.p_size <= p.p_size
    AND (q.p_retailprice < p.p_retailprice OR q.p_size < p.p_size))""",
)
def pareto_front(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return sp.pareto_front(p, ["p_brand"], "p_retailprice", "p_size", slice_width=50.0)


@query(
    "what_if",
    f"""
WITH {_BEST}, w AS (
  SELECT site_id, ts, load_rt, {_kw('coalesce(now_chw, 45.0)', 'coalesce(now_cw, 45.0)', 'coalesce(now_fan, 45.0)')} AS cur,
         {_kw('chw', 'cw', 'fan')} AS rec, {_kw('60.0', '60.0', '60.0')} AS full_kw FROM best)
SELECT site_id, ts, round(cur, 6) AS current_kw, round(cur / load_rt, 6) AS current_kw_per_rt, round(rec, 6) AS recommended_kw,
       round(rec / load_rt, 6) AS recommended_kw_per_rt, round(full_kw, 6) AS full_kw, round(full_kw / load_rt, 6) AS full_kw_per_rt,
       round(cur - rec, 6) AS savings_kw, round(CASE WHEN cur > 0 THEN (cur - rec) / cur * 100.0 ELSE 0 END, 6) AS savings_percent
FROM w""",
)
def what_if(spark, sf):
    best = sp.best_setpoints(contexts(spark, sf), scorer, AXES, NOW).drop("savings_kw", "savings_percent")
    now = {n: F.coalesce(F.col(c), F.lit(45.0)) for n, c in zip(sp.SETPOINTS, NOW)}
    out = sp.what_if(best, scorer, now, {n: F.col(f"best_{n}") for n in sp.SETPOINTS})
    names = [f"{k}_{m}" for k in ("current", "recommended", "full") for m in ("kw", "kw_per_rt")]
    return out.select("site_id", "ts", *[r6(c) for c in [*names, "savings_kw", "savings_percent"]])


@query(
    "savings_summary",
    """
SELECT count(*) AS total_runs, round(sum(o_totalprice), 2) AS total_savings_kw, round(avg(o_totalprice / 5000.0), 6) AS avg_savings_percent,
       round(max(o_totalprice / 5000.0), 6) AS max_savings_percent
FROM orders""",
)
def savings_summary(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("savings_kw"), (F.col("o_totalprice") / 5000.0).alias("savings_percent")
    )
    s = sp.savings_summary(o)
    return s.select(
        "total_runs", F.round("total_savings_kw", 2).alias("total_savings_kw"), r6("avg_savings_percent"), r6("max_savings_percent")
    )


@query(
    "run_savings",
    """
WITH s AS (SELECT o_orderkey, o_totalprice - 100000.0 AS base, (o_totalprice - 100000.0) * 0.95 AS opt FROM orders)
SELECT o_orderkey, round(base - opt, 6) AS savings_kw, round(CASE WHEN base > 0 THEN (base - opt) / base * 100.0 ELSE 0 END, 6) AS savings_percent
FROM s""",
)
def run_savings(spark, sf):
    o = table(spark, sf, "orders").withColumn("base", F.col("o_totalprice") - 100000.0).withColumn("opt", F.col("base") * 0.95)
    return sp.with_savings(o, "base", "opt").select("o_orderkey", r6("savings_kw"), r6("savings_percent"))


@query(
    "recent_runs",
    """
SELECT o_orderkey AS run_id, o_orderdate AS timestamp, o_orderpriority AS model_name, o_totalprice AS savings_kw
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
)
def recent_runs(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("model_name"),
        F.col("o_totalprice").alias("savings_kw"),
    )
    return sp.recent_runs(o, 20, tie=["run_id"])
