"""Report intake on small files of every known shape."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantspark.functions.text import glob_to_regex, scrub_number, snake_case, standard_header
from plantspark.functions.timefx import parse_text_timestamp, text_to_utc
from plantspark.schema import NULL_TOKENS
from plantspark.sources import reports

HEAD = '"<>Date","Time","Point_1","Point_2"'
FILES = {
    "baseline.csv": [' "Point_1","Sensor_A"', '"Point_2","Sensor_B"', HEAD, "2024/01/01,00:00:00,1,2", "2024/01/01,00:15:00,3,4"],
    "no_header.csv": ['"Point_1","Sensor_A"', "2024/01/01,00:00:00,1,2"],
    "ragged.csv": [HEAD, "2024/01/01,00:00:00,10", "2024/01/01,00:15:00,11,12,13", "2024/01/01"],
    "empty.csv": ['"Point_1","Sensor_A"', HEAD],
    "garbage.csv": ["some text", "more text, with a comma", '"<>Date","Time","Point_1"', "2024/01/01,00:00:00,5.5"],
    "separator.csv": [HEAD, "2024/01/01,00:00:00,1,2", '"**********"', "2024/01/01,00:15:00,NA,null", "bad,date,1,2"],
    "colon.csv": ['"Point_1:","AHWP-3.KWH","","1 hour"', '"<>Date","Time","Point_1"', '"2024/01/01","00:00:00","1.5"'],
    "comma.csv": ['"Point_1","A, B"', '"<>Date","Time","Point_1"', '"2024/01/01","00:00:00","2,5"'],
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("reports")
    for name, lines in FILES.items():
        (d / name).write_text("\r\n".join(lines) + "\r\n", encoding="utf-8")
    readings, errors = reports.read_reports(spark, str(d), glob="*.csv")
    name = F.element_at(F.split("source_file", "/"), -1)
    return readings.withColumn("source_file", name).cache(), errors.withColumn("source_file", name).cache()


def of(parsed, name):
    return [
        (r.ts, r.sensor, r.value)
        for r in parsed[0].where(F.col("source_file") == name).orderBy("ts", "sensor").collect()
    ]


T0, T15 = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 15)


def test_baseline(parsed):
    assert of(parsed, "baseline.csv") == [(T0, "Sensor_A", 1.0), (T0, "Sensor_B", 2.0), (T15, "Sensor_A", 3.0), (T15, "Sensor_B", 4.0)]


def test_ragged(parsed):
    assert of(parsed, "ragged.csv") == [(T0, "Point_1", 10.0), (T0, "Point_2", None), (T15, "Point_1", 11.0), (T15, "Point_2", 12.0)]


def test_separator_null_tokens_and_bad_dates(parsed):
    assert of(parsed, "separator.csv") == [(T0, "Point_1", 1.0), (T0, "Point_2", 2.0), (T15, "Point_1", None), (T15, "Point_2", None)]


def test_names(parsed):
    assert of(parsed, "garbage.csv") == [(T0, "Point_1", 5.5)]
    assert of(parsed, "colon.csv") == [(T0, "AHWP_3_KWH", 1.5)]
    assert of(parsed, "comma.csv") == [(T0, "A, B", None)]


def test_errors(parsed, rows):
    assert rows(parsed[1]) == [("empty.csv", "no data rows"), ("no_header.csv", "no header row")]


def test_row_order_follows_the_file(spark, tmp_path):
    n = 60_000
    text = ['"Point_1","S"', '"<>Date","Time","Point_1"'] + [f"2024/01/01,00:00:00,{i}" for i in range(n)]
    (tmp_path / "big.csv").write_text("\n".join(text))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
        spark.conf.set("spark.sql.files.openCostInBytes", 65_536)
        lines = reports.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        r = reports.parse_reports(lines)
        assert r.count() == n
        from pyspark.sql.window import Window

        w = Window.orderBy("row_no")
        wrong = r.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") != F.col("value"))
        assert wrong.count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    "codec,read_as", [("big5", "cp950"), ("cp950", "cp950"), ("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("utf-16-be", "utf-16-be")]
)
def test_encodings(spark, tmp_path, codec, read_as):
    body = '"Point_1","冰水泵"\n"<>Date","Time","Point_1"\n2024/01/01,00:00:00,7\n'
    (tmp_path / "f.csv").write_bytes(body.encode(codec))
    r, e = reports.read_reports(spark, str(tmp_path), encoding=read_as)
    assert [(x.sensor, x.value) for x in r.collect()] == [("冰水泵", 7.0)]
    assert e.count() == 0


def test_encoding_detection(spark, tmp_path):
    body = '"Point_1","冰水泵"\n"<>Date","Time","Point_1"\n2024/01/01,00:00:00,7\n'
    for name, codec in {"a": "utf-8", "b": "cp950", "c": "utf-8-sig", "d": "utf-16"}.items():
        (tmp_path / f"{name}.csv").write_bytes(body.encode(codec))
    found = {r.source_file[-5]: r.encoding for r in reports.detect_encodings(spark, str(tmp_path)).collect()}
    assert found == {"a": "utf-8", "b": "cp950", "c": "utf-8", "d": "utf-16-le"}
    r, _ = reports.read_reports(spark, str(tmp_path), encoding="auto", glob="[abc].csv")
    assert [x.sensor for x in r.collect()] == ["冰水泵"] * 3


def test_header_by_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report Date, Time\n備註\n日期,時間,溫度_1,溫度_2\n2024/01/01,00:00:00,1,2\n")
    (tmp_path / "b.csv").write_text("nothing,here\n1,2\n")
    (tmp_path / "c.csv").write_text("DateTime,a,b,c\nx,1,2,3\n")
    lines = reports.read_lines(spark, str(tmp_path))
    h = reports.find_headers_by_words(lines)
    got = {r.source_file.rsplit("/", 1)[1]: r.header for r in h.collect()}
    assert got == {"a.csv": "日期,時間,溫度_1,溫度_2", "c.csv": "DateTime,a,b,c"}
    r = reports.parse_reports(lines, headers=h.where(F.col("header").startswith("日期")))
    assert sorted((x.sensor, x.value) for x in r.collect()) == [("溫度_1", 1.0), ("溫度_2", 2.0)]


def test_numeric_null_token(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"<>Date","Time","P","Q"\n2024/01/01,00:00:00,-999,5\n2024-01-01,00:05:00,1,1\n')
    r, _ = reports.read_reports(spark, str(tmp_path), null_tokens=["", "-999"])
    assert sorted((x.sensor, x.value) for x in r.collect()) == [("P", None), ("Q", 5.0)]
    dirty, _ = reports.read_reports(spark, str(tmp_path), scrub=True)
    assert sorted((x.sensor, x.value) for x in dirty.collect()) == [("P", -999.0), ("Q", 5.0)]


def test_first_k_files(spark, tmp_path):
    for i in (3, 1, 2):
        (tmp_path / f"{i}.csv").write_text(f'"<>Date","Time","P"\n2024/01/0{i},00:00:00,{i}\n')
    r, _ = reports.read_reports(spark, str(tmp_path), first_files=2)
    assert sorted(x.value for x in r.collect()) == [1.0, 2.0]


def test_nothing_readable(spark, tmp_path):
    (tmp_path / "x.csv").write_text("no header\n")
    r, e = reports.read_reports(spark, str(tmp_path))
    assert e.count() == 1
    with pytest.raises(reports.NoReadableReport):
        reports.require_readings(r)


def test_hygiene(spark):
    lines = spark.createDataFrame([("f", 1, "a﻿b"), ("f", 2, "c\x00"), ("f", 3, "d")], "source_file string, line_no long, line string")
    assert tuple(reports.text_hygiene(lines).first()) == ("f", 1, 1)


def test_scrub(spark):
    df = spark.createDataFrame([("25.3 C",), ("100%",), ("---",), ("Error",), ("1.5e3 kW",), ("OFFLINE",)], "c string")
    assert [r[0] for r in df.select(scrub_number("c", NULL_TOKENS)).collect()] == [25.3, 100.0, None, None, 1500.0, None]
    assert [r[0] for r in df.select(scrub_number("c")).collect()][:4] == [25.3, 100.0, None, None]


def test_names_standard(spark):
    cases = {
        "Chiller 1 Temp": "chiller_1_temp", "power(kW)": "power_kw", "sensor-A": "sensor_a", "HTTPRequest": "http_request",
        "Total_Power": "total_power", "123_sensor": "col_123_sensor", "Temp..Value": "temp_value", "class": "class_col", "***": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = dict(zip(cases, [r[0] for r in df.select(snake_case("c")).collect()]))
    assert got == cases


def test_header_words(spark):
    df = spark.createDataFrame([('"<>Date"',), ("  Time  ",), ("日期",), ("溫度_1",)], "c string")
    assert [r[0] for r in df.select(standard_header("c")).collect()] == ["Date", "Time", "Date", "溫度_1"]


def test_time_text(spark):
    df = spark.createDataFrame([("2026-02-13 08:00:00",), ("2026-02-13T08:00:00+08:00",), ("junk",), ("2026-02-13 00:00:00Z",)], "c string")
    t = datetime(2026, 2, 13)
    assert [r[0] for r in df.select(text_to_utc("c")).collect()] == [t, t, None, t]
    assert df.select(parse_text_timestamp("c")).first()[0] == datetime(2026, 2, 13, 8)


@pytest.mark.parametrize("glob,yes,no", [("*_RT", "CH_0_RT", "CH_0_RTX"), ("C?P", "CHP", "CHHP"), ("[!a]x", "bx", "ax"), ("a.b", "a.b", "acb"), ("a[", "a[", "a")])
def test_glob(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "c string")
    assert [r[0] for r in df.select(F.col("c").rlike(glob_to_regex(glob))).collect()] == [True, False]
