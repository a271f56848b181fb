"""Queries for damaged reports, text contracts, annotations and scoring rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantspark.functions import text as tx
from plantspark.functions.timefx import parse_text_timestamp
from plantspark.operators import features, flags, inheritance, sensors
from plantspark.operators import setpoints as sp
from plantspark.queries.registry import PLANT, plant, query, r6, table
from plantspark.sources import reports


def dirty_lines(spark, sf):
    """Reports made from ``events`` with what goes wrong in them.

    Odd files have local headers and quoted cells (some with commas and units), even ones plain cells; cells hold null
    words, rows are short or long, file 4 has no header, file 3 marks and NULs.
    """
    e = table(spark, sf, "events").withColumn("f", F.col("user_id") % 5)
    e = e.withColumn("source_file", F.concat(F.lit("dirty_"), F.col("f").cast("string")))
    plain = '"<>Date","Time","A, first","B"'
    head = F.when(F.col("f") % 2 == 1, F.lit('"<>Date",時間,"A, first",B')).otherwise(F.lit(plain))
    heads = e.select("source_file", "f").distinct().where("f <> 4").select("source_file", F.lit(5).cast("long").alias("line_no"), head.alias("line"))
    value = F.col("value").cast("string")
    k = F.col("event_id") % 6
    a = F.when(k == 0, "NA").when(k == 1, "").when(k == 2, "OFF").otherwise(value)
    a = F.when(F.col("f") % 2 == 1, F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)
    b = F.when(k == 3, F.lit('"1,5"')).otherwise(F.col("event_id").cast("string"))
    cells = F.when(k == 4, F.array(a)).when(k == 5, F.array(a, b, F.lit("more"), F.lit("x,y"))).otherwise(F.array(a, b))
    mark = F.when((F.col("f") == 3) & (k == 0), F.lit("\u0000")).when((F.col("f") == 3) & (k == 1), F.lit("﻿")).otherwise("")
    start = F.concat_ws(",", F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss"))
    line = F.concat(F.concat_ws(",", start, F.array_join(cells, ",")), mark)
    return heads.unionAll(e.select("source_file", (F.col("event_id") + 100).alias("line_no"), line.alias("line")))


_DIRTY = """d AS (SELECT 'dirty_' || (user_id % 5) AS source_file, user_id % 5 AS f, event_id, event_id % 6 AS k, value,
  date_trunc('second', ts) AS ts FROM events)"""


@query(
    "report_dirty",
    f"""
WITH {_DIRTY}
SELECT source_file, event_id + 100 AS row_no, ts, 'A__first' AS sensor, value FROM d WHERE f <> 4 AND k NOT IN (0, 1, 2) AND NOT (f = 3 AND k = 1)
UNION ALL SELECT source_file, event_id + 100, ts, 'B', event_id::DOUBLE FROM d WHERE f <> 4 AND k IN (0, 1, 2, 5) AND NOT (f = 3 AND k = 1)""",
)
def report_dirty(spark, sf):
    """Readings of the damaged reports: null words, short and long rows, quoted commas and marks become nulls or are left out."""
    r = reports.parse_reports(dirty_lines(spark, sf), drop_null_values=True).drop("site_id")
    return r.withColumn("sensor", F.regexp_replace("sensor", "[^A-Za-z]+", "__"))


@query(
    "report_errors",
    "SELECT 'dirty_4' AS source_file, 'no header row' AS reason FROM (SELECT DISTINCT 1 FROM events WHERE user_id % 5 = 4)",
)
def report_errors(spark, sf):
    lines = dirty_lines(spark, sf)
    return reports.ingest_errors(lines, reports.parse_reports(lines, drop_null_values=True))


@query(
    "report_hygiene",
    f"""
WITH {_DIRTY}
SELECT source_file, CAST(sum((f = 3 AND k = 1)::INT) AS BIGINT) AS n_bom, CAST(sum((f = 3 AND k = 0)::INT) AS BIGINT) AS n_nul FROM d GROUP BY 1""",
)
def report_hygiene(spark, sf):
    return reports.text_hygiene(dirty_lines(spark, sf))


@query(
    "report_first_files",
    f"WITH {_DIRTY} SELECT source_file, count(*) + max((f <> 4)::INT) AS n_lines FROM d WHERE f < 2 GROUP BY 1",
)
def report_first_files(spark, sf):
    return reports.first_k_files(dirty_lines(spark, sf), 2).groupBy("source_file").agg(F.count("*").alias("n_lines"))


@query(
    "null_tokens",
    """
WITH c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' NA ' WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN ' ' || o_orderpriority
             ELSE o_totalprice || ' kW' END AS cell FROM orders)
SELECT o_orderkey, CASE WHEN trim(cell) NOT IN ('', 'NA', 'null') THEN trim(cell) END AS cell,
       CASE WHEN o_orderkey % 5 = 4 THEN replace(cell, ' kW', '')::DOUBLE END AS number FROM c""",
)
def null_tokens(spark, sf):
    k = F.col("o_orderkey") % 5
    price = F.concat(F.col("o_totalprice").cast("string"), F.lit(" kW"))
    cell = F.when(k == 0, " NA ").when(k == 1, "").when(k == 2, "null").when(k == 3, F.concat(F.lit(" "), "o_orderpriority")).otherwise(price)
    o = table(spark, sf, "orders").select("o_orderkey", cell.alias("cell"))
    return o.select("o_orderkey", tx.null_if_token("cell").alias("cell"), F.when(k == 4, tx.scrub_number("cell")).alias("number"))


@query(
    "text_timestamps",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 HOUR END AS at
FROM orders""",
)
def text_timestamps(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T05:00:00"))).otherwise(F.concat(F.lit("on "), day))
    return table(spark, sf, "orders").select("o_orderkey", parse_text_timestamp(said).alias("at"))


_NOTES = """notes AS (SELECT p_partkey AS position, p_type AS sensor, p_brand AS equipment_id, CASE p_size % 3 WHEN 0 THEN 'power' WHEN 1 THEN 'temp' END AS physical_type,
  CASE p_size % 2 WHEN 0 THEN 'primary' ELSE 'backup' END AS device_role FROM part)"""


def notes(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"),
        F.col("p_type").alias("sensor"),
        F.col("p_brand").alias("equipment_id"),
        F.when(size % 3 == 0, "power").when(size % 3 == 1, "temp").alias("physical_type"),
        F.when(size % 2 == 0, "primary").otherwise("backup").alias("device_role"),
    )


@query(
    "sensors_without_annotation",
    "SELECT DISTINCT 'part ' || l_partkey AS sensor FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0)",
)
def sensors_without_annotation(spark, sf):
    r = table(spark, sf, "lineitem").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("sensor"))
    dim = table(spark, sf, "part").where(F.col("p_size") % 3 == 0).select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("sensor"))
    return sensors.without_annotation(r, dim)


@query("sensor_groups", f"WITH {_NOTES} SELECT position, sensor FROM notes WHERE physical_type = 'power'")
def sensor_groups(spark, sf):
    return sensors.equipment_groups(notes(spark, sf))["electrical"]().select("position", "sensor")


@query(
    "inherited_annotations",
    f"""
WITH {_NOTES}, base AS (SELECT position, physical_type, device_role FROM notes WHERE position % 3 > 0),
site AS (SELECT position, CASE WHEN position % 2 = 0 THEN 'hz' END AS physical_type FROM notes WHERE position % 5 > 0)
SELECT coalesce(b.position, s.position) AS position, coalesce(s.physical_type, b.physical_type) AS physical_type, b.device_role
FROM base b FULL JOIN site s ON b.position = s.position""",
)
def inherited_annotations(spark, sf):
    n = notes(spark, sf)
    base = n.where("position % 3 > 0").select("position", "physical_type", "device_role")
    site = n.where("position % 5 > 0").select("position", F.when(F.col("position") % 2 == 0, "hz").alias("physical_type"))
    return sensors.inherit_annotations(base, site, "position")


#: Chains of forty parts each; in every tenth the root inherits from its seventh descendant.
_CHAINS = """links AS (
  SELECT p_partkey AS node, CASE WHEN p_partkey % 40 <> 0 THEN p_partkey - 1 WHEN p_partkey // 40 % 10 = 3 THEN p_partkey + 7 END AS parent FROM part),
own AS (
  SELECT p_partkey AS node, 's' || (p_size % 6) AS sensor, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS physical_type,
         CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS device_role FROM part WHERE p_partkey % 4 > 0),
known AS (SELECT node, CASE WHEN parent IN (SELECT node FROM links) THEN parent END AS parent FROM links),
up(node, here, dist, seen, loops) AS (
  SELECT node, node, 0, [node], false FROM known
  UNION ALL
  SELECT u.node, k.parent, dist + 1, list_append(seen, k.parent), list_contains(seen, k.parent)
  FROM up u JOIN known k ON k.node = u.here WHERE k.parent IS NOT NULL AND NOT loops)"""


def chains(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    parent = F.when(key % 40 != 0, key - 1).when(F.floor(key / 40) % 10 == 3, key + 7)
    notes = p.where(key % 4 > 0).select(
        key.alias("node"),
        F.concat(F.lit("s"), (F.col("p_size") % 6).cast("string")).alias("sensor"),
        F.when(key % 3 == 0, F.col("p_type")).alias("physical_type"),
        F.when(key % 5 == 0, F.col("p_brand")).alias("device_role"),
    )
    return notes, p.select(key.alias("node"), parent.alias("parent"))


@query(
    "inherited_chains",
    f"""
WITH RECURSIVE {_CHAINS}
SELECT u.node, o.sensor, arg_min(o.physical_type, dist) AS physical_type, arg_min(o.device_role, dist) AS device_role
FROM up u JOIN own o ON o.node = u.here
WHERE u.node NOT IN (SELECT node FROM up WHERE loops) GROUP BY 1, 2""",
)
def inherited_chains(spark, sf):
    return inheritance.inherit_chains(*chains(spark, sf), on_circle="report")[0]


@query(
    "inheritance_circles",
    f"""
WITH RECURSIVE {_CHAINS}
SELECT node, CASE WHEN here = node THEN 'circle' ELSE 'below_circle' END AS problem, 'E407' AS code FROM up WHERE loops
UNION ALL SELECT node, 'unknown_parent', NULL FROM links WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM links)""",
)
def inheritance_circles(spark, sf):
    return inheritance.inheritance_problems(chains(spark, sf)[1])


@query(
    "feature_labels",
    f"""
WITH {_NOTES}
SELECT l_orderkey, l_linenumber, coalesce(physical_type, 'derived') AS physical_type
FROM lineitem LEFT JOIN notes ON l_partkey = position AND position % 4 > 0""",
)
def feature_labels(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("position"))
    return sensors.label_features(li, notes(spark, sf).where("position % 4 > 0"), "position").drop("position")


@query(
    "feature_hash",
    """
SELECT l_orderkey, sha256(string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag)) AS hash FROM lineitem GROUP BY 1""",
)
def feature_hash(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return lines.select("l_orderkey", features.feature_hash_column(F.transform("x", lambda r: r["l_returnflag"])).alias("hash"))


@query(
    "flag_set_difference",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE '' END AS unknown, CASE WHEN o_orderstatus = 'O' THEN 'P' WHEN o_orderstatus = 'P' THEN 'O' ELSE 'O,P' END AS unused,
       '["' || o_orderstatus || '"]' AS as_json
FROM orders""",
)
def flag_set_difference(spark, sf):
    d = flags.vocabulary_diff(F.array("o_orderstatus"), ["O", "P"])
    o = table(spark, sf, "orders").select("o_orderkey", *[F.array_join(c, ",").alias(n) for n, c in d.items()], F.array("o_orderstatus").alias("as_json"))
    return flags.flags_to_json(o, "as_json")


@query(
    "scoring_rows",
    f"""
WITH {PLANT}
SELECT site_id, ts, round(load_rt / 2.0, 6) AS CH_1_RT, round(pump_hz, 6) AS CHP_1_HZ, round(fan_hz, 6) AS CT_1_HZ,
       round(temp, 6) AS CH_1_SWT, round(temp + 5.0, 6) AS CH_1_RWT, 25.0::DOUBLE AS OAT
FROM plant""",
)
def scoring_rows(spark, sf):
    p = plant(spark, sf)
    s = {"chw_pump_hz": F.col("pump_hz"), "cw_pump_hz": F.col("pump_hz"), "ct_fan_hz": F.col("fan_hz")}
    row = sp.scoring_row(
        s, {"load_rt": F.col("load_rt"), "chw_supply_temp_setpoint": F.col("temp")}, ["CH_1_RT", "CH_2_RT"], ["CHP_1_HZ"], (), ["CT_1_HZ"], ["CH_1_SWT", "CH_1_RWT", "OAT"]
    )
    names = ["CH_1_RT", "CHP_1_HZ", "CT_1_HZ", "CH_1_SWT", "CH_1_RWT", "OAT"]
    return p.withColumns(row).select("site_id", "ts", *[r6(n) if n != "OAT" else F.col(n) for n in names])
