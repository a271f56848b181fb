"""Slices of nearly equal row counts: splitters per series from counts of ever narrower buckets of the order columns.

A slice of fixed length holds as many rows as fall into it: one sensor that writes most of its year
within an hour still goes to one task. Here rows are counted per series and coarse time bucket; where a
bucket holds too many, its rows alone are counted again in buckets 256 times narrower, down to the last
microsecond and then through the further whole-number order columns; widths that would split none of them are skipped. The buckets that are small enough, in
order, are gathered into slices. Every row finds its slice by an equi join on its bucket, and only series
longer than a slice appear in the joined tables at all.

The counts are written to the checkpoint folder, so a recomputed task meets the same slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plantspark.functions.timefx import epoch_micros
from plantspark.plans.joins import key_join
from plantspark.plans.stored import stored

#: Rows of a slice at most, unless more share all their times and whole numbers.
MAX_ROWS = 1_000_000
#: A bucket of the first level is 2**32 microseconds long, some 72 minutes.
FIRST_SHIFT = {"time": 32, "number": 56}
STEP = 8
#: Where null order values stand: first.
LOWEST = -(2**63)


def order_code(df: DataFrame, column: str) -> tuple[str, Column] | None:
    """Kind and whole number that rises as the column does; None for a column that is neither a time nor a whole number."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return "time", epoch_micros(column)
    if isinstance(kind, T.TimestampType):
        return "time", F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return "time", F.unix_date(column).cast("bigint") * F.lit(86_400_000_000)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "number", F.col(column).cast("bigint")
    return None


@dataclass(frozen=True)
class Level:
    """Buckets by all codes before the last, whole, and the last without its ``shift`` lowest bits."""

    depth: int
    shift: int

    def buckets(self, codes: Sequence[Column]) -> dict[str, Column]:
        out = {}
        for i, c in enumerate(codes):
            out[f"_b{i}"] = c if i < self.depth else F.shiftright(c, self.shift) if i == self.depth else F.lit(0).cast("bigint")
        return out

    def splits(self) -> Column:
        """Whether the smallest and the largest code of a bucket's rows lie in different buckets of this level."""
        return F.shiftright(F.col(f"_lo{self.depth}"), self.shift) != F.shiftright(F.col(f"_hi{self.depth}"), self.shift)

    def start(self, n: int) -> Column:
        """The smallest codes of a bucket."""
        parts = [F.col(f"_b{i}") if i < self.depth else F.shiftleft(F.col(f"_b{i}"), self.shift) if i == self.depth else F.lit(LOWEST) for i in range(n)]
        return F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])


def levels(kinds: Sequence[str]) -> list[Level]:
    return [Level(i, s) for i, k in enumerate(kinds) for s in range(FIRST_SHIFT[k], -1, -STEP)]


@dataclass(frozen=True)
class Slices:
    """Slices of the series that are longer than ``max_rows``; every other series is one slice.

    ``table`` has a row per slice of a long series: ``keys, _slice`` (from 0), ``_rows``, ``_before`` (rows of the
    series before it). ``tables`` has the buckets of each level with their slice.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    max_rows: int
    table: DataFrame | None = None
    tables: tuple[tuple[Level, DataFrame], ...] = ()

    @property
    def is_single(self) -> bool:
        return self.table is None

    @property
    def reach(self) -> int:
        """Rows that any two neighbouring slices hold at least, unless they begin or end the series."""
        return max(1, self.max_rows // 2)

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_slice``; a left join for each level on the bucket of a row. Null keys are keys."""
        if self.is_single:
            return df.withColumn("_slice", F.lit(0).cast("bigint"))
        out, found = df, []
        codes = _codes(df, self.order)
        for i, (level, table) in enumerate(self.tables):
            named = level.buckets([c for _, c in codes])
            out = key_join(out.withColumns(named), table.withColumnRenamed("_slice", f"_s{i}"), [*self.keys, *named])
            out = out.drop(*named)
            found.append(F.col(f"_s{i}"))
        out = out.withColumn("_slice", F.coalesce(*found, F.lit(0).cast("bigint")))
        return out.drop(*[f"_s{i}" for i in range(len(found))])


def _codes(df: DataFrame, order: Sequence[str]) -> list[tuple[str, Column]]:
    out = []
    for c in order:
        code = order_code(df, c)
        if code is None:
            break
        out.append((code[0], F.coalesce(code[1], F.lit(LOWEST))))
    return out


def fit_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_ROWS) -> Slices:
    """Slices of at most ``max_rows`` rows for every series of ``df``, contiguous in ``order``.

    One read of the keys; where a series is longer, one of keys and order columns, and one more of the full buckets' rows
    for each further level that splits any of them. The counts are combined before the shuffle. Order columns count up to the first that is neither
    a time nor a whole number; rows that agree in all of these stay together, whatever their number. Null keys
    are keys, null order values come first. An empty table, or one of short series only, needs no slices.
    """
    codes = _codes(df, order)
    single = Slices(tuple(keys), tuple(order), max_rows)
    if not codes:
        return single
    longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if longest is None or longest <= max_rows:
        return single
    half, n = max(1, max_rows // 2), len(codes)
    cols = [c for _, c in codes]
    names = [f"_b{i}" for i in range(n)]
    todo = levels([k for k, _ in codes])
    slim = df.select(*keys, *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
    own = [F.col(f"_c{i}") for i in range(n)]
    ends = [f(c).alias(f"_{k}{i}") for i, c in enumerate(own) for k, f in (("lo", F.min), ("hi", F.max))]
    rows, leaves, level = slim, [], todo[0]
    while level is not None:
        counts = rows.withColumns(level.buckets(own)).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"), *ends)
        if level == todo[0]:
            whole = F.sum("_n").over(Window.partitionBy(*keys))
            counts = counts.withColumn("_all", whole).where(F.col("_all") > max_rows).drop("_all")
        counts = stored(counts, "slice-counts")
        full, rest = F.col("_n") > half, todo[todo.index(level) + 1 :]
        told = counts.agg(F.count(F.lit(1)), F.count_if(full), *[F.max(full & finer.splits()) for finer in rest]).first()
        if told[0] == 0:
            break
        finer = next((x for x, splits in zip(rest, told[2:], strict=True) if splits), None)
        if finer is None:
            full = F.lit(False)
        if finer is None or told[1] < told[0]:
            leaves.append((level, counts.where(~full)))
        heavy = counts.where(full).select(*keys, *names)
        # Buckets lie within those of the level before, so the last heavy ones alone choose the rows.
        rows = key_join(slim.withColumns(level.buckets(own)), heavy, [*keys, *names], "left_semi").drop(*names)
        level = finer
    if not leaves:
        return single
    each = reduce(
        DataFrame.unionByName,
        [t.select(*keys, *names, "_n", level.start(n).alias("_start"), F.lit(k).alias("_level")) for k, (level, t) in enumerate(leaves)],
    )
    upto = Window.partitionBy(*keys).orderBy("_start", "_level").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)).cast("bigint"))
    placed = placed.withColumn("_turn", F.floor(F.col("_before") / F.lit(half)))
    ordered = Window.partitionBy(*keys).orderBy("_turn")
    placed = stored(placed.withColumn("_slice", (F.dense_rank().over(ordered) - 1).cast("bigint")).drop("_start", "_turn"), "slice-places")
    tables = tuple((level, placed.where(F.col("_level") == k).select(*keys, *names, "_slice")) for k, (level, _) in enumerate(leaves))
    table = placed.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_rows"), F.min("_before").alias("_before"))
    return Slices(tuple(keys), tuple(order), max_rows, table, tables)
