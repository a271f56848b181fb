"""Automation-system report files to the long ``readings`` table.

A report is text: preamble lines that name the points, a header line, then one line per time.
Files are read line by line (never whole), so a file of any size is split over tasks. Each line
keeps an order number; header and point names shrink to one row per file and meet the data lines
in a join whose oversized partitions are split, so one file holding most of the lines does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.text import null_if_token, sanitise_sensor, scrub_number, standard_header, to_double
from plantspark.functions.timefx import parse_date_time
from plantspark.plans.joins import key_join
from plantspark.plans.ordered import windowed
from plantspark.schema import BASIC_NULL_TOKENS

# ---------------------------------------------------------------- fixed values
HEADER_STARTS = ['"<>Date', '<>Date']
DATE_WORDS = ["Date", "日期"]
TIME_WORDS = ["Time", "時間", "时间"]
DATETIME_WORDS = ["DateTime", "Timestamp"]
#: Lines of a file that are put in order together when its header is looked for.
SCAN_SLICE = 100_000

#: A field after its comma: plain runs and quoted parts, each taken once and never given back.
_FIELD = ',((?:[^",]++|"[^"]*+"?)*+)'


class NoReadableReport(ValueError):
    """None of the files held a header and data."""


# ------------------------------------------------------------------ lines


def read_lines(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """``source_file, line_no, line`` of text files.

    ``line_no`` orders the lines of a file: the byte offset of the split, then the position in it.
    ``encoding`` is any Python codec name (``utf-8``, ``utf-8-sig``, ``cp950``, ``utf-16-le`` ...)
    or ``auto``: UTF-8, and cp950 for lines that are no valid UTF-8 (see :func:`detect_encodings`
    for UTF-16). A byte-order mark is removed. Damaged bytes become replacement characters.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    codec = encoding.lower().replace("_", "-")
    wide = codec.startswith("utf-16")
    if wide:
        # The separator is two bytes in UTF-16; little-endian unless stated otherwise.
        codec = "utf-16-be" if codec.endswith("be") else "utf-16-le"
        java = "UTF-16BE" if codec.endswith("be") else "UTF-16LE"
        reader = reader.option("lineSep", "\n").option("encoding", java)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    in_split = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    line_no = F.shiftleft(F.shiftright(F.col("_block"), 12), 33).bitwiseOR(in_split)
    value = F.col("value")
    if codec == "auto":
        valid = F.is_valid_utf8(value)
        text = F.when(valid, value).otherwise(_decoder("cp950")(F.when(~valid, value.cast("binary"))))
    elif wide:
        text = decode_utf16(value.cast("binary"), codec.endswith("be"))
    else:
        text = value if codec in ("utf-8", "utf-8-sig") else _decoder(codec)(value.cast("binary"))
    text = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r$", "")
    return raw.select("source_file", line_no.alias("line_no"), text.alias("line"))


def detect_encodings(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``source_file, encoding``: UTF-16 by its byte-order mark, UTF-8 if every line is valid, else
    cp950. The UTF-8 mark is dropped by the line reader, so such files count as plain UTF-8."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    order = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("source_file"), order.alias("_o"), "value")
    per_file = raw.groupBy("source_file").agg(
        F.min_by(F.hex(F.substring(F.col("value").cast("binary"), 1, 3)), "_o").alias("_start"),
        F.bool_and(F.is_valid_utf8("value")).alias("_valid"),
    )
    start = F.col("_start")
    found = (
        F.when(start.startswith("FFFE"), "utf-16-le")
        .when(start.startswith("FEFF"), "utf-16-be")
        .when(F.col("_valid"), "utf-8")
        .otherwise("cp950")
    )
    return per_file.select("source_file", found.alias("encoding"))


def decode_utf16(raw: Column, big_endian: bool) -> Column:
    """Text of UTF-16 bytes, in built-in expressions; half surrogates and a lone last byte become replacement characters.

    Only damaged lines pay for the repair: it works on the bytes as hexadecimal text, unit by unit.
    """
    name = "UTF-16BE" if big_endian else "UTF-16LE"

    def unit(first: str) -> str:
        """A unit whose upper byte begins with ``first``."""
        return f"{first}[0-9A-F][0-9A-F]{{2}}" if big_endian else f"[0-9A-F]{{2}}{first}[0-9A-F]"

    # The upper byte's first digit, then its second: D8-DB open a pair, DC-DF close it.
    def upper(digits: str) -> str:
        return f"{digits}[0-9A-F]{{2}}" if big_endian else f"[0-9A-F]{{2}}{digits}"

    plain = f"(?:{unit('[0-9A-CEF]')}|{upper('D[0-7]')})"
    sound = f"(?:{plain}|{upper('D[89AB]')}{upper('D[C-F]')})"
    lost = "FFFD" if big_endian else "FDFF"
    digits = F.hex(raw)
    whole = F.regexp_replace(digits, f"\\G((?:{sound})*+)(?:{upper('D[89AB]')}[0-9A-F]{{2}}$|{upper('D[89A-F]')}|[0-9A-F]{{2}}$)", f"$1{lost}")
    repaired = F.when(digits.rlike(f"^(?:{sound})*+$"), raw).otherwise(F.unhex(whole))
    return F.decode(repaired, name)


def _decoder(codec: str):
    """A small vectorised helper: bytes of one line to text."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(codec, errors="replace"))

    return decode


def raw_fields(line: Column) -> Column:
    """Comma-separated fields as they stand; commas inside quotes stay, an open quote reaches to the line's end."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), 1)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def bare(field: Column) -> Column:
    """A field without surrounding blanks and quotes."""
    x = F.trim(field)
    return F.when(x.contains('"'), F.regexp_replace(x, '^"|"$', "")).otherwise(x)


def split_fields(line: Column) -> Column:
    return F.transform(raw_fields(line), bare)


# ------------------------------------------------------------------ header and points


def _is_header() -> Column:
    return F.col("line").startswith(HEADER_STARTS[0]) | F.col("line").startswith(HEADER_STARTS[1])


def _is_point() -> Column:
    return F.col("line").rlike('^[ "]*Point_')


def find_headers(lines: DataFrame) -> DataFrame:
    """The first line of each file that starts with ``<>Date``: ``source_file, header_no, header``."""
    return lines.where(_is_header()).groupBy("source_file").agg(
        F.min("line_no").alias("header_no"), F.min_by("line", "line_no").alias("header")
    )


def _words(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def find_headers_by_words(lines: DataFrame) -> DataFrame:
    """The best header candidate of each file by key words, among all of its lines; ties go to the first.

    Date and time words give 2, a date-time word 2, more than three fields 1. A candidate whose
    number of separators differs by more than one from the next line is no header. The next line is looked up in
    slices of the line number, so a file of any size is spread over tasks.
    """
    c = F.col("line")
    delims = F.length(c) - F.length(F.regexp_replace(c, "[,\t;]", ""))
    score = (
        F.when(_words(c, DATE_WORDS) & _words(c, TIME_WORDS), 2).otherwise(0)
        + F.when(_words(c, DATETIME_WORDS), 2).otherwise(0)
        + F.when(delims + 1 > 3, 1).otherwise(0)
    )
    likely = _words(c, DATE_WORDS) | _words(c, DATETIME_WORDS)
    counted = lines.select("source_file", "line_no", delims.alias("_d"), F.when(likely, score).alias("_score"), F.when(likely, c).alias("line"))
    backwards = counted.withColumn("_from_end", -F.col("line_no"))
    paired = windowed(
        backwards, ["source_file"], ["_from_end"], 1, {"_next": lambda w: F.lag("_d").over(w)}, F.floor(F.col("line_no") / SCAN_SLICE)
    )
    scored = paired.where((F.col("_score") >= 2) & (F.abs(F.col("_d") - F.col("_next")) <= 1))
    best = F.struct((-F.col("_score")).alias("s"), "line_no")
    return scored.groupBy("source_file").agg(
        F.min_by("line_no", best).alias("header_no"), F.min_by("line", best).alias("header")
    )


def point_map(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """``source_file, point_id, sensor`` from the preamble; a repeated point keeps its last name."""
    parts = split_fields(F.trim("line"))
    pre = key_join(lines.where(_is_point()), headers.select("source_file", "header_no"), ["source_file"], "inner").where(
        F.col("line_no") < F.col("header_no")
    )
    named = pre.select(
        "source_file",
        "line_no",
        F.regexp_replace(F.get(parts, F.lit(0)), ":", "").alias("point_id"),
        F.get(parts, F.lit(1)).alias("sensor"),
    ).where(F.col("point_id").startswith("Point_") & (F.col("sensor") != ""))
    return named.groupBy("source_file", "point_id").agg(F.max_by("sensor", "line_no").alias("sensor"))


def preamble(lines: DataFrame) -> DataFrame:
    """``source_file, header_no, header, points`` in one pass: the first header line and the point lines of each file."""
    line = F.struct("line_no", "line")
    return lines.where(_is_header() | _is_point()).groupBy("source_file").agg(
        F.min(F.when(_is_header(), line)).alias("_h"), F.collect_list(F.when(_is_point(), line)).alias("points")
    ).where("_h IS NOT NULL").select("source_file", F.col("_h.line_no").alias("header_no"), F.col("_h.line").alias("header"), "points")


def _with_points(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The same for headers found by other means."""
    points = lines.where(_is_point()).groupBy("source_file").agg(F.collect_list(F.struct("line_no", "line")).alias("points"))
    none = F.array().cast("array<struct<line_no: bigint, line: string>>")
    return key_join(headers.select("source_file", "header_no", "header"), points, ["source_file"]).withColumn("points", F.coalesce("points", none))


def file_layout(heads: DataFrame) -> DataFrame:
    """One row per file: ``header_no``, ``date_pos``, ``time_pos`` and ``layout``, the value columns as (position, sensor).

    Columns without a name in the preamble keep their header text; of a repeated point the last line before the
    header counts. The layout is as wide as the header line it comes from, and made within the file's row.
    """

    def point(p: Column) -> Column:
        parts = split_fields(F.trim(p["line"]))
        return F.struct(F.regexp_replace(F.get(parts, F.lit(0)), ":", "").alias("id"), F.get(parts, F.lit(1)).alias("sensor"))

    before = F.array_sort(F.filter("points", lambda p: p["line_no"] < F.col("header_no")))
    named = F.filter(F.transform(before, point), lambda p: p["id"].startswith("Point_") & (p["sensor"] != ""))
    row = heads.select(
        "source_file", "header_no", named.alias("_points"), F.transform(split_fields(F.col("header")), standard_header).alias("_header")
    )

    def name(h: Column) -> Column:
        own = F.filter("_points", lambda p: p["id"] == h)
        return F.coalesce(sanitise_sensor(F.get(own, F.size(own) - 1)["sensor"]), h)

    row = row.withColumn("_names", F.transform("_header", name))

    def at(word: str) -> Column:
        place = F.array_position("_names", word)
        return F.when(place > 0, (place - 1).cast("int"))

    places = F.transform("_names", lambda n, i: F.struct(i.alias("pos"), n.alias("sensor")))
    return row.select(
        "source_file",
        "header_no",
        at("Date").alias("date_pos"),
        at("Time").alias("time_pos"),
        F.filter(places, lambda c: ~c["sensor"].isin("Date", "Time", "")).alias("layout"),
    )


# ------------------------------------------------------------------ parsing


def parse_reports(
    lines: DataFrame,
    site_id: Column | str = "site",
    headers: DataFrame | None = None,
    null_tokens: Sequence[str] = tuple(BASIC_NULL_TOKENS),
    scrub: bool = False,
    drop_null_values: bool = False,
) -> DataFrame:
    """Lines of many reports to ``readings``.

    Short rows give nulls, extra fields are ignored, separator rows (``****``) and rows without a
    valid date and time are dropped, bad cells become null. Files without a header give nothing;
    :func:`ingest_errors` names them. ``scrub=True`` also strips unit text from the cells.
    """
    site = F.lit(site_id) if isinstance(site_id, str) else site_id
    layout = file_layout(preamble(lines) if headers is None else _with_points(lines, headers))
    start = F.ltrim("line")
    body = lines.where(~start.startswith("*") & ~start.startswith('"*') & (start != ""))
    data = key_join(body, layout, ["source_file"], "inner").where(F.col("line_no") > F.col("header_no"))
    fields = data.withColumn("_f", raw_fields(F.col("line")))
    # Text tokens become null in the casts below by themselves; only numbers need the comparison.
    numeric = [t for t in null_tokens if _is_number(t)]

    def cell(pos: Column) -> Column:
        text = F.trim(F.replace(F.get("_f", pos), F.lit('"'), F.lit("")))
        return null_if_token(text, numeric) if numeric else text

    timed = fields.withColumn("ts", parse_date_time(cell(F.col("date_pos")), cell(F.col("time_pos")))).where(F.col("ts").isNotNull())

    def reading(c: Column) -> Column:
        raw = cell(c["pos"])
        return F.struct(c["sensor"].alias("sensor"), (scrub_number(raw) if scrub else to_double(raw)).alias("value"))

    # Only what becomes a reading is multiplied, not the line's fields.
    read = F.transform("layout", reading)
    read = F.filter(read, lambda c: c["value"].isNotNull()) if drop_null_values else read
    long = timed.select("source_file", "line_no", "ts", F.explode(read).alias("_c"))
    return long.select(
        site.alias("site_id"), "source_file", F.col("line_no").alias("row_no"), "ts", F.col("_c.sensor").alias("sensor"), F.col("_c.value").alias("value")
    )


def _is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def ingest_errors(lines: DataFrame, readings: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Files that gave no readings, with the reason; headers come with the pass that lists the files."""
    found = F.max(_is_header().cast("int")) == 1
    files = lines.groupBy("source_file").agg(found.alias("_found"))
    if headers is not None:
        known = headers.select("source_file", F.lit(True).alias("_found"))
        files = key_join(files.select("source_file"), known, ["source_file"]).withColumn("_found", F.coalesce("_found", F.lit(False)))
    silent = key_join(files, readings.select("source_file").distinct(), ["source_file"], "left_anti")
    return silent.select("source_file", F.when(F.col("_found"), "no data rows").otherwise("no header row").alias("reason"))


def text_hygiene(lines: DataFrame) -> DataFrame:
    """Lines per file that still hold a byte-order mark or a NUL character."""
    from plantspark.functions.text import has_bom, has_nul

    return lines.groupBy("source_file").agg(
        F.sum(has_bom("line").cast("long")).alias("n_bom"), F.sum(has_nul("line").cast("long")).alias("n_nul")
    )


def read_reports(
    spark: SparkSession,
    path: str | Sequence[str],
    site_id: str = "site",
    encoding: str = "utf-8",
    glob: str | None = None,
    first_files: int | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Readings of all files and the list of files that gave none. Bad files never stop the rest.

    ``first_files`` keeps the first files by name, as a trial run wants.
    """
    lines = read_lines(spark, path, encoding, glob)
    if first_files is not None:
        lines = first_k_files(lines, first_files)
    readings = parse_reports(lines, site_id, **options)
    return readings, ingest_errors(lines, readings)


def require_readings(readings: DataFrame) -> DataFrame:
    if readings.isEmpty():
        raise NoReadableReport("no file was read successfully")
    return readings


def first_k_files(lines: DataFrame, k: int, file: str = "source_file") -> DataFrame:
    """Rows of the first ``k`` files by name; only the ``k`` names are joined back."""
    names = lines.select(file).distinct().orderBy(file).limit(k)
    return key_join(lines, names, [file], "left_semi")
