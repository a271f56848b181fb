"""UTF-16 decoded by built-in expressions, also damaged lines, against Python's decoder."""

import random

import pytest
from pyspark.sql import functions as F

from plantspark.sources.reports import decode_utf16, read_lines


@pytest.mark.parametrize("big", [False, True])
def test_lines_as_python_decodes_them(spark, big):
    codec, rnd = ("utf-16-be" if big else "utf-16-le"), random.Random(6)
    units = ["a".encode(codec), "溫".encode(codec), "😀".encode(codec), "\ud800".encode(codec, "surrogatepass"), "\udc00".encode(codec, "surrogatepass"), "퟿".encode(codec), "".encode(codec)]
    lines = [b"", b"x", None, "Date,Time,<>冷卻水".encode(codec)] + [b"".join(rnd.choices(units, k=rnd.randrange(12))) + b"z" * rnd.randrange(2) for _ in range(400)]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(lines)], "i int, raw binary").repartition(3)
    got = {r.i: r.t for r in df.select("i", decode_utf16(F.col("raw"), big).alias("t")).collect()}
    for i, raw in enumerate(lines):
        assert got[i] == (None if raw is None else raw.decode(codec, "replace")), raw


@pytest.mark.parametrize("codec", ["utf-16-le", "utf-16-be", "utf-16", "utf-8"])
def test_files_are_read_without_a_python_worker(spark, tmp_path, codec):
    text = "Date,Time,<>溫度 😀\r\n2024/01/01,00:00:00,7.5\r\n"
    (tmp_path / "a.csv").write_bytes(text.encode(codec))
    df = read_lines(spark, str(tmp_path), encoding=codec)
    assert [r.line for r in df.orderBy("line_no").collect()] == ["Date,Time,<>溫度 😀", "2024/01/01,00:00:00,7.5"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_line_is_repaired_in_linear_time(spark):
    raw = ("漢" * 200_000).encode("utf-16-le") + b"\x00\xd8"
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary")
    assert df.select(decode_utf16(F.col("raw"), False).alias("t")).first().t == raw.decode("utf-16-le", "replace")
