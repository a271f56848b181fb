"""Queries for equipment states, interlock rules and run times."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import equipment as eq
from plantspark.queries.registry import PLANT, READINGS, plant, query, readings, table

_STATE = """CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN event_type IN ('purchase', 'signup') THEN
    CASE WHEN value > 10 THEN 'ON' WHEN value < 2 THEN 'OFF' ELSE 'TRANSITION' END
  WHEN event_type IN ('view', 'click') THEN CASE WHEN value > 35 THEN 'ON' WHEN value < 5 THEN 'OFF' ELSE 'TRANSITION' END
  ELSE 'UNKNOWN' END"""

STATES = f"""{READINGS}, states AS (SELECT *, {_STATE} AS state FROM readings)"""

TYPES = {"purchase": "power_meter", "signup": "chiller", "view": "pump", "click": "fan"}


def states(spark, sf):
    ptype = F.lit("other")
    for e, t in TYPES.items():
        ptype = F.when(F.col("event_type") == e, t).otherwise(ptype)
    return readings(spark, sf).withColumn("state", eq.equipment_state("value", ptype))


@query("equipment_states", f"WITH {STATES} SELECT row_no, event_type, value, state FROM states")
def equipment_states(spark, sf):
    return states(spark, sf).select("row_no", "event_type", "value", "state")


_ISLANDS = f"""{STATES}, c AS (
  SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER w THEN 0 ELSE 1 END AS chg FROM states
  WINDOW w AS (PARTITION BY site_id, sensor ORDER BY ts, row_no)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS isle FROM c),
segs AS (SELECT site_id, sensor, isle, any_value(state) AS state, min(ts) AS seg_start, max(ts) AS seg_end, count(*) AS n_rows,
           date_diff('microsecond', min(ts), max(ts))::DOUBLE / 60000000::DOUBLE AS minutes
         FROM g GROUP BY 1, 2, 3)"""


@query(
    "state_segments",
    f"WITH {_ISLANDS} SELECT site_id, sensor, state, seg_start, seg_end, n_rows, minutes FROM segs",
)
def state_segments(spark, sf):
    return eq.state_segments(states(spark, sf))


@query(
    "min_runtime",
    f"""
WITH {_ISLANDS}
SELECT site_id, sensor, state, seg_start, seg_end, n_rows, minutes,
       CASE state WHEN 'ON' THEN 'MIN_RUNTIME_VIOLATION' ELSE 'MIN_DOWNTIME_VIOLATION' END AS violation,
       CASE state WHEN 'ON' THEN 600.0::DOUBLE ELSE 15.0::DOUBLE END AS required_minutes
FROM segs WHERE (state = 'ON' AND minutes < 600) OR (state = 'OFF' AND minutes < 15)""",
)
def min_runtime(spark, sf):
    return eq.runtime_violations(eq.state_segments(states(spark, sf)), min_run=600.0)


@query(
    "start_events",
    f"""
WITH {STATES}, p AS (SELECT *, lag(state) OVER (PARTITION BY site_id, sensor ORDER BY ts, row_no) AS prev FROM states)
SELECT site_id, sensor, ts, row_no FROM p WHERE state = 'ON' AND prev IS DISTINCT FROM 'ON'""",
)
def start_events(spark, sf):
    return eq.start_events(states(spark, sf)).select("site_id", "sensor", "ts", "row_no")


@query(
    "startup_sequence",
    f"""
WITH {STATES}, nxt AS (
  SELECT *, lag(state) OVER (PARTITION BY site_id ORDER BY ts, row_no) AS prev FROM states WHERE event_type = 'signup'),
both_ AS (
  SELECT site_id, ts, 0 AS is_start, row_no, state AS prior FROM states WHERE event_type = 'view'
  UNION ALL SELECT site_id, ts, 1, row_no, NULL FROM nxt WHERE state = 'ON' AND prev IS DISTINCT FROM 'ON'),
asof_ AS (SELECT *, last_value(prior IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts, is_start, row_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior_state FROM both_)
SELECT site_id, ts, row_no, prior_state, NOT coalesce(prior_state = 'ON', false) AS violated FROM asof_ WHERE is_start = 1""",
)
def startup_sequence(spark, sf):
    s = states(spark, sf).select("site_id", "ts", "row_no", "state", F.col("event_type").alias("device"))
    return eq.startup_sequence(s, "view", "signup")


RULES = [
    eq.Rule("chiller_needs_pump", "requires", ["load_rt"], ["pump_on"], on_above=20.0),
    eq.Rule("chiller_needs_both", "requires", ["load_rt"], ["pump_on", "fan_on"], on_above=20.0, need="all"),
    eq.Rule("pump_or_fan", "mutex", ["pump_on", "fan_on"]),
    eq.Rule("temp_range", "range", column="temp", low=5.0, high=90.0),
    eq.Rule("low_load", "threshold", ["pump_on"], column="load_rt", rated=200.0, low=0.2),
]

RULE_ROWS = f"""{PLANT}, st AS (
  SELECT *, CASE WHEN pump_hz > 60 THEN 1 ELSE 0 END AS pump_on, CASE WHEN fan_hz > 60 THEN 1 ELSE 0 END AS fan_on FROM plant),
chk AS (
  SELECT *, coalesce(load_rt > 20, false) AND NOT pump_on = 1 AS chiller_needs_pump,
    coalesce(load_rt > 20, false) AND NOT (pump_on = 1 AND fan_on = 1) AS chiller_needs_both,
    pump_on + fan_on > 1 AS pump_or_fan, coalesce(temp < 5 OR temp > 90, false) AS temp_range,
    coalesce(load_rt / 200.0 < 0.2, false) AND pump_on = 1 AS low_load
  FROM st)"""


def rule_table(spark, sf):
    return plant(spark, sf).withColumns(
        {
            "pump_on": F.when(F.col("pump_hz") > 60, 1).otherwise(0),
            "fan_on": F.when(F.col("fan_hz") > 60, 1).otherwise(0),
        }
    )


def _row_check(name: str, rule_ids: list[str]) -> None:
    rules = [r for r in RULES if r.rule_id in rule_ids]

    @query(name, f"WITH {RULE_ROWS} SELECT site_id, ts, {', '.join(rule_ids)} FROM chk")
    def check(spark, sf):
        return rule_table(spark, sf).select("site_id", "ts", *[r.violated().alias(r.rule_id) for r in rules])


_row_check("requires_check", ["chiller_needs_pump", "chiller_needs_both"])
_row_check("mutex_check", ["pump_or_fan"])
_row_check("range_check", ["temp_range"])
_row_check("ratio_check", ["low_load"])


@query(
    "running_at_zero_hz",
    """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND floor(l_quantity / 10) = 0""",
)
def running_at_zero_hz(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_linestatus") == "O").cast("int").alias("status"),
        F.floor(F.col("l_quantity") / 10).alias("hz"),
    )
    return d.where(eq.running_at_zero_hz("status", "hz")).select("l_orderkey", "l_linenumber")


@query(
    "constraint_audit",
    f"""
WITH {RULE_ROWS}, a AS (
  SELECT count(*) AS n, count(*) FILTER (chiller_needs_pump) AS chiller_needs_pump, count(*) FILTER (chiller_needs_both) AS chiller_needs_both,
         count(*) FILTER (pump_or_fan) AS pump_or_fan, count(*) FILTER (temp_range) AS temp_range, count(*) FILTER (low_load) AS low_load
  FROM chk),
u AS (SELECT * FROM a UNPIVOT (violations FOR rule_id IN (chiller_needs_pump, chiller_needs_both, pump_or_fan, temp_range, low_load)))
SELECT rule_id, CASE rule_id WHEN 'pump_or_fan' THEN 'mutex' WHEN 'temp_range' THEN 'range' WHEN 'low_load' THEN 'threshold'
         ELSE 'requires' END AS kind,
       violations, n AS total_rows, round(violations * 100.0 / n, 2) AS rate_percent,
       CASE WHEN violations * 100.0 / n > 5 THEN 'HIGH' WHEN violations * 100.0 / n >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM u""",
)
def constraint_audit(spark, sf):
    return eq.audit_rules(rule_table(spark, sf), RULES)


_FLAG_NAMES = ["REQUIRES_VIOLATION", "MUTEX_VIOLATION", "PHYSICAL_IMPOSSIBLE", "LOGIC_CONSTRAINT_VIOLATION"]

_FLAG_ROWS = f"""{RULE_ROWS}, fl AS (
  SELECT site_id, ts, chiller_needs_pump OR chiller_needs_both AS requires_violation, pump_or_fan AS mutex_violation,
         temp_range AS physical_impossible, low_load AS logic_constraint_violation FROM chk)"""


@query(
    "violation_summary",
    f"""
WITH {_FLAG_ROWS}, s AS (
  SELECT count(*) AS total_rows,
    count(*) FILTER (requires_violation OR mutex_violation OR physical_impossible OR logic_constraint_violation) AS violation_rows,
    count(*) FILTER (requires_violation) AS requires_violation, count(*) FILTER (mutex_violation) AS mutex_violation,
    count(*) FILTER (physical_impossible) AS physical_impossible,
    count(*) FILTER (logic_constraint_violation) AS logic_constraint_violation FROM fl)
SELECT *, round(violation_rows * 100.0 / total_rows, 2) AS rate_percent,
       CASE WHEN violation_rows * 100.0 / total_rows > 5 THEN 'HIGH' WHEN violation_rows * 100.0 / total_rows >= 1 THEN 'MEDIUM'
            ELSE 'LOW' END AS severity
FROM s""",
)
def violation_summary(spark, sf):
    return eq.violation_summary(eq.apply_rules(rule_table(spark, sf), RULES), _FLAG_NAMES)


@query(
    "violation_samples",
    f"""
WITH {_FLAG_ROWS}, u AS (
  SELECT * FROM fl UNPIVOT (hit FOR flag IN (requires_violation, mutex_violation, physical_impossible, logic_constraint_violation))),
r AS (SELECT site_id, ts, upper(flag) AS flag, row_number() OVER (PARTITION BY site_id, flag ORDER BY ts) AS sample_no FROM u WHERE hit)
SELECT site_id, ts, flag, CAST(sample_no AS INTEGER) AS sample_no FROM r WHERE sample_no <= 3""",
)
def violation_samples(spark, sf):
    return eq.violation_samples(eq.apply_rules(rule_table(spark, sf), RULES), ["site_id"])


@query(
    "constraint_conflicts",
    """
WITH p AS (SELECT DISTINCT l_returnflag AS flag, 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem),
req AS (SELECT 'req_' || a || '_' || b AS requires_rule, least(a, b) AS device_a, greatest(a, b) AS device_b FROM p WHERE flag = 'R'),
mut AS (SELECT 'mut_' || a || '_' || b AS mutex_rule, least(a, b) AS device_a, greatest(a, b) AS device_b FROM p WHERE flag = 'A')
SELECT requires_rule, mutex_rule, device_a, device_b FROM req JOIN mut USING (device_a, device_b)""",
)
def constraint_conflicts(spark, sf):
    p = table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"),
    )
    p = p.where(F.col("l_returnflag").isin("R", "A")).distinct()
    is_req = F.col("l_returnflag") == "R"
    rules = p.select(
        F.concat_ws("_", F.when(is_req, "req").otherwise("mut"), "a", "b").alias("rule_id"),
        F.when(is_req, "requires").otherwise("mutex").alias("kind"),
        F.when(is_req, F.array("a")).otherwise(F.array("a", "b")).alias("trigger"),
        F.when(is_req, F.array("b")).alias("required"),
    )
    return eq.rule_conflicts(rules)

