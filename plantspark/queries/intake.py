"""Queries for report intake, names and sensor classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.operators import sensors as sn
from plantspark.queries.registry import READINGS, query, r6, readings, table
from plantspark.sources import reports

POINTS = {"view": 1, "click": 2, "purchase": 3, "error": 4, "signup": 5}


def report_lines(spark, sf):
    """Report files written from ``events``: preamble, header, a separator and one line per event."""
    e = table(spark, sf, "events").withColumn(
        "source_file", F.concat(F.lit("report_"), (F.col("user_id") % 5).cast("string"), F.lit(".csv"))
    )
    head = ["  free text without points"] + [f'"Point_{i}:","{n}-VALUE.{i}","","1 hour"' for n, i in POINTS.items()]
    head += ['"<>Date","Time",' + ",".join(f'"Point_{i}"' for i in POINTS.values())]
    preamble = e.select("source_file").distinct().select(
        "source_file", F.posexplode(F.array(*[F.lit(x) for x in head])).alias("line_no", "line")
    )
    cells = [F.when(F.col("event_type") == n, F.col("value").cast("string")).otherwise("") for n in POINTS]
    data = e.select(
        "source_file",
        (F.col("event_id") * 2 + 100).alias("line_no"),
        F.concat_ws(",", F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss"), *cells).alias("line"),
    )
    bars = e.where(F.col("event_type") == "error").select(
        "source_file", (F.col("event_id") * 2 + 101).alias("line_no"), F.lit('"**********"').alias("line")
    )
    return preamble.select("source_file", F.col("line_no").cast("long"), "line").unionByName(data).unionByName(bars)


@query(
    "report_roundtrip",
    """
SELECT 'report_' || (user_id % 5) || '.csv' AS source_file, event_id * 2 + 100 AS row_no, date_trunc('second', ts) AS ts,
       CASE event_type WHEN 'view' THEN 'view_VALUE_1' WHEN 'click' THEN 'click_VALUE_2' WHEN 'purchase' THEN 'purchase_VALUE_3'
         WHEN 'error' THEN 'error_VALUE_4' ELSE 'signup_VALUE_5' END AS sensor, value
FROM events""",
)
def report_roundtrip(spark, sf):
    return reports.parse_reports(report_lines(spark, sf), drop_null_values=True).drop("site_id")


@query(
    "report_points",
    """
SELECT 'report_' || f || '.csv' AS source_file, 'Point_' || p AS point_id, n || '-VALUE.' || p AS sensor
FROM (SELECT DISTINCT user_id % 5 AS f FROM events)
CROSS JOIN (VALUES ('view', 1), ('click', 2), ('purchase', 3), ('error', 4), ('signup', 5)) t(n, p)""",
)
def report_points(spark, sf):
    lines = report_lines(spark, sf)
    return reports.point_map(lines, reports.find_headers(lines))


@query(
    "names_standardised",
    r"""
WITH n AS (SELECT DISTINCT p_type || ' No.' || p_size || '(kW)' AS name FROM part UNION SELECT DISTINCT p_size || '_' || p_brand FROM part),
a AS (SELECT name, regexp_replace(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g') AS s FROM n),
b AS (SELECT name, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'),
        '^([0-9])', 'col_\1'), '_$', '')), '(^|_)k_(wh|w|pa|var|va|v|j)(_|$)', '\1k\2\3', 'g') AS standard FROM a)
SELECT name, standard, count(*) OVER (PARTITION BY standard) AS n_names, regexp_matches(standard, '^[a-z][a-z0-9_]*$') AS is_valid FROM b""",
)
def names_standardised(spark, sf):
    p = table(spark, sf, "part")
    long = F.concat("p_type", F.lit(" No."), F.col("p_size").cast("string"), F.lit("(kW)"))
    short = F.concat_ws("_", F.col("p_size").cast("string"), "p_brand")
    return sn.standardise_names(p.select(F.explode(F.array(long, short)).alias("name")))


NAME_FORMS = [
    "CH_{}_RT", "CHP_{}_VFD_OUT", "SCP_{}_HZ", "CHW_TEMP_{}", "CHW_PRESSURE_{}", "CHW_FLOW_{}", "CWP_{}_VFD_OUT",
    "CW_SUPPLY_{}", "CW_HEAD_{}", "COND_FLOW_{}", "CT_{}_VFD_OUT", "OAT_{}", "PLANT_{}_TOTAL_KW", "CH_{}_ALARM", "PUMP_KW_{}",
]

_NAME_SQL = "CASE p_partkey % 15 " + " ".join(
    f"WHEN {i} THEN '{a}' || p_partkey || '{b}'" for i, (a, b) in enumerate(f.split("{}") for f in NAME_FORMS)
) + " END"

SENSOR_NAMES = f"names AS (SELECT p_partkey AS position, p_brand AS brand, {_NAME_SQL} AS sensor FROM part)"


def sensor_names(spark, sf):
    """Sensor names of every catalogued part, in fifteen naming forms."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    name = F.lit(None).cast("string")
    for i, f in enumerate(NAME_FORMS):
        a, b = f.split("{}")
        name = F.when(F.col("p_partkey") % 15 == i, F.concat(F.lit(a), key, F.lit(b))).otherwise(name)
    return p.select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("brand"), name.alias("sensor"))


def _like_any(parts):
    return "(" + " OR ".join(f"contains(upper(sensor), '{p}')" for p in parts) + ")"


_CLASS_SQL = " UNION ALL ".join(
    f"SELECT position, sensor, '{cat}' AS category FROM names WHERE {_like_any(parts)} AND NOT {_like_any(sn.EXCLUDED_ANYWHERE)}"
    + (f" AND NOT {_like_any(sn.EXCLUDED_FROM[cat])}" if cat in sn.EXCLUDED_FROM else "")
    for cat, parts in sn.NAME_PARTS.items()
)


@query("classify_sensors", f"WITH {SENSOR_NAMES} {_CLASS_SQL}")
def classify_sensors(spark, sf):
    return sn.classify_by_parts(sensor_names(spark, sf).select("position", "sensor"))


@query(
    "classify_glob",
    f"""
WITH {SENSOR_NAMES}
SELECT position, sensor, 'chiller' AS category, false AS is_custom FROM names WHERE sensor GLOB 'CH_*_RT'
UNION ALL SELECT position, sensor, 'cw_pump', false FROM names WHERE sensor GLOB 'C[WH]P_?*_VFD_OUT'
UNION ALL SELECT position, sensor, 'outdoor', true FROM names WHERE sensor GLOB 'OAT_[!1-5]*' OR sensor GLOB 'CHW_TEMP*'""",
)
def classify_glob(spark, sf):
    globs = {"chiller": "CH_*_RT", "cw_pump": ["C[WH]P_?*_VFD_OUT"], "outdoor": ["OAT_[!1-5]*", "CHW_TEMP*"]}
    return sn.classify_by_glob(sensor_names(spark, sf).select("position", "sensor"), globs)


_PRIORITY = """CASE WHEN contains(upper(sensor), 'COP') THEN 1
    WHEN contains(upper(sensor), 'KW_RT') OR contains(upper(sensor), 'KW/RT') OR contains(upper(sensor), 'KW_PER_RT')
      OR contains(upper(sensor), 'EFFICIENCY') THEN 2
    WHEN contains(upper(sensor), 'TOTAL') AND contains(upper(sensor), 'KW') THEN 3
    WHEN upper(sensor) LIKE '%!_KW' ESCAPE '!' THEN 4 END"""


@query(
    "target_pick",
    f"""
WITH {SENSOR_NAMES}, r AS (SELECT *, {_PRIORITY} AS p FROM names),
k AS (SELECT brand, sensor, row_number() OVER (PARTITION BY brand ORDER BY p, position) AS rn FROM r WHERE p IS NOT NULL)
SELECT brand, sensor AS target, CASE WHEN contains(upper(sensor), 'COP') OR contains(upper(sensor), 'EFFICIENCY')
    OR contains(upper(sensor), 'KW_RT') OR contains(upper(sensor), 'KW/RT') THEN 'efficiency' ELSE 'power' END AS target_metric
FROM k WHERE rn = 1""",
)
def target_pick(spark, sf):
    return sn.pick_target(sensor_names(spark, sf), keys=["brand"])


@query(
    "pump_pick",
    f"""
WITH {SENSOR_NAMES}
SELECT brand, arg_min(sensor, position) FILTER (contains(lower(sensor), 'hz') OR contains(lower(sensor), 'frequency')
         OR contains(lower(sensor), 'pump_freq')) AS freq_col,
       arg_min(sensor, position) FILTER (contains(lower(sensor), 'pump_kw') OR contains(lower(sensor), 'chwp_kw')
         OR contains(lower(sensor), 'cwp_kw') OR contains(lower(sensor), 'pump_power')) AS power_col
FROM names GROUP BY 1""",
)
def pump_pick(spark, sf):
    return sn.pick_pump_columns(sensor_names(spark, sf), keys=["brand"])


_MAPPED = """mapped AS (
  SELECT DISTINCT 'view_' || (c_custkey % 7) AS sensor, CASE c_custkey % 7 WHEN 0 THEN 'chiller' WHEN 6 THEN 'system_level'
    WHEN 5 THEN 'chiller' ELSE 'environment' END AS category FROM customer
  UNION SELECT DISTINCT 'click_' || (c_custkey % 7), 'cw_pump' FROM customer)"""


@query(
    "mapping_coverage",
    f"""
WITH {READINGS}, {_MAPPED}, act AS (SELECT DISTINCT sensor FROM readings)
SELECT m.sensor, m.category, CASE WHEN a.sensor IS NOT NULL THEN 'matched'
         WHEN m.category IN ('chiller', 'system_level') THEN 'missing_required' ELSE 'missing_optional' END AS status
FROM mapped m LEFT JOIN act a USING (sensor)
UNION ALL SELECT sensor, NULL, 'unmapped' FROM act WHERE sensor NOT IN (SELECT sensor FROM mapped)""",
)
def mapping_coverage(spark, sf):
    return sn.mapping_coverage(_mapping(spark, sf), readings(spark, sf))


def _mapping(spark, sf):
    k = F.col("c_custkey") % 7
    cat = F.when(k.isin(0, 5), "chiller").when(k == 6, "system_level").otherwise("environment")
    c = table(spark, sf, "customer")
    return c.select(F.concat_ws("_", F.lit("view"), k.cast("string")).alias("sensor"), cat.alias("category")).unionByName(
        c.select(F.concat_ws("_", F.lit("click"), k.cast("string")).alias("sensor"), F.lit("cw_pump").alias("category"))
    )


@query(
    "mapping_match_rate",
    f"""
WITH {READINGS}, {_MAPPED}
SELECT round(avg(CASE WHEN sensor IN (SELECT sensor FROM readings) THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM mapped""",
)
def mapping_match_rate(spark, sf):
    return sn.match_rate(sn.mapping_coverage(_mapping(spark, sf), readings(spark, sf))).select(r6("match_rate"))


@query(
    "annotation_gaps",
    f"""
WITH {READINGS}, act AS (SELECT DISTINCT sensor FROM readings),
dim AS (SELECT DISTINCT event_type || '_' || (user_id % 7) AS sensor FROM events WHERE user_id % 7 <> 4)
SELECT sensor, 'unannotated' AS gap FROM act WHERE sensor NOT IN (SELECT sensor FROM dim)
UNION ALL SELECT sensor, 'orphan' FROM dim WHERE sensor NOT IN (SELECT sensor FROM act)""",
)
def annotation_gaps(spark, sf):
    k = F.col("user_id") % 7
    dim = table(spark, sf, "events").where(k != 4).select(F.concat_ws("_", "event_type", k.cast("string")).alias("sensor"))
    return sn.annotation_gaps(readings(spark, sf), dim.distinct())
