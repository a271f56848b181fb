"""Ordered (per-series) operators that never need a whole series in one task.

A plain ``Window.partitionBy(series).orderBy(ts)`` sorts a series in a single task, which fails
when one sensor holds a large share of all rows. Here a series is cut into time slices. Each
slice is one window partition, so the full-size work spreads over the cluster, and only a few
rows per slice (its edges, or one summary row) are ordered over the whole series. Results equal
the plain window exactly.

The slice column is a pure function of the row: a time slice of fixed length
(``functions.timefx.time_chunk``, for data whose rows per time are known) or a measured one
(``plans.slices``, for any data). A recomputed task after an executor loss meets the same slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plantspark.functions.timefx import time_chunk
from plantspark.plans.joins import key_join
from plantspark.plans.slices import Slices, fit_slices

#: Slices by a column, measured ones, or None for one window per series.
Chunk = Column | Slices | None
WindowExpr = Callable[[WindowSpec], Column]


def chunk_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | Slices | None) -> Chunk:
    """Slices of a fixed number of seconds, the given ones, or (None) slices measured now, which reads ``df`` once."""
    if isinstance(slices, int):
        return time_chunk(order[0], slices)
    return slices if slices is not None else fit_slices(df, keys, order)


def _sliced(df: DataFrame, chunk: Column | Slices) -> DataFrame:
    return chunk.add(df) if isinstance(chunk, Slices) else df.withColumn("_slice", chunk)


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    exprs: dict[str, WindowExpr],
    chunk: Chunk,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back.

    ``exprs`` maps a name to a function of the ordered window spec, e.g.
    ``lambda w: F.lag("value").over(w)``; it may set a row frame inside ``[-lookback, 0]``.
    ``chunk=None`` asks for one window per key (for series of known small size).

    Rows past the first ``lookback`` of a slice see all they need inside the slice. The first
    ``lookback`` rows are evaluated again over head and tail rows, which hold every row they can
    reach: over those of all slices, or for measured slices, of which any two neighbours hold
    enough rows, over the slice's head and the tails of the two slices before it, so that no task
    gets more than three times ``lookback`` rows. Both branches read one shuffle.
    """
    w_series = Window.partitionBy(*keys).orderBy(*order)
    if chunk is None or isinstance(chunk, Slices) and chunk.is_single:
        return df.withColumns({n: f(w_series) for n, f in exprs.items()})
    w_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    sliced = _sliced(df, chunk)
    # By rank, not by row number: rows with equal order columns share a rank, so both branches
    # split the slice at the same place whatever order a sort gives to such rows.
    is_head = F.rank().over(w_slice) <= lookback
    is_tail = F.lead(F.lit(1), lookback).over(w_slice).isNull()
    near = isinstance(chunk, Slices) and lookback <= chunk.reach
    if near:
        is_head = is_head & (F.col("_slice") > 0)
    inner = sliced.withColumns({"_head": is_head, **{n: f(w_slice) for n, f in exprs.items()}}).where(~F.col("_head"))
    ends = sliced.withColumns({"_head": is_head, "_tail": is_tail}).where(F.col("_head") | F.col("_tail"))
    if near:
        own = F.when(F.col("_head"), F.array("_slice")).otherwise(F.array().cast("array<bigint>"))
        later = F.when(F.col("_tail"), F.array(F.col("_slice") + 1, F.col("_slice") + 2)).otherwise(F.array().cast("array<bigint>"))
        ends = ends.withColumn("_target", F.explode(F.concat(own, later)))
        w_target = Window.partitionBy(*keys, "_target").orderBy(*order)
        edge = ends.withColumns({n: f(w_target) for n, f in exprs.items()}).where(F.col("_head") & (F.col("_target") == F.col("_slice"))).drop("_target")
    else:
        edge = ends.withColumns({n: f(w_series) for n, f in exprs.items()}).where(F.col("_head"))
    return inner.unionByName(edge.drop("_tail")).drop("_slice", "_head")


_WITHIN = {
    "sum": lambda c, w: F.sum(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
}


def _slice_total(col: str, kind: str, order: Sequence[str]) -> Column:
    if kind == "last":
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(*order)))
    return getattr(F, kind)(F.col(col))


def _merge(carry: Column, local: Column, kind: str) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    if kind == "min":
        return F.least(carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    return F.coalesce(local, carry)


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: dict[str, tuple[str, str]],
    chunk: Column | Slices,
    include_current: bool = True,
) -> DataFrame:
    """Running ``sum``, ``min``, ``max`` or non-null ``last`` from the start of the series.

    ``exprs`` maps an output name to ``(column, kind)``. Each slice is reduced to one summary row;
    the running value over those rows is joined back to the slices by an equi join on the
    partitioning the slices already have. ``include_current=False`` stops at the previous row.
    """
    part = [*keys, "_slice"]
    stop = 0 if include_current else -1
    w_slice = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    w_carry = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = _sliced(df, chunk)
    totals = sliced.groupBy(*part).agg(*[_slice_total(c, k, order).alias(f"_t_{n}") for n, (c, k) in exprs.items()])
    carry = totals.select(*part, *[_WITHIN[k](F.col(f"_t_{n}"), w_carry).alias(f"_c_{n}") for n, (_, k) in exprs.items()])
    local = sliced.withColumns({f"_l_{n}": _WITHIN[k](F.col(c), w_slice) for n, (c, k) in exprs.items()})
    joined = key_join(local, carry, part)
    kept = [c for c in df.columns if c not in exprs]
    return joined.select(
        *kept, *[_merge(F.col(f"_c_{n}"), F.col(f"_l_{n}"), k).alias(n) for n, (_, k) in exprs.items()]
    )


def segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, chunk: Column | Slices
) -> DataFrame:
    """Gaps and islands: one row per run of equal ``state`` with start, end and row count.

    The first column of ``order`` is the time. Inside a slice only the first and last row of each
    run are kept, which one sort settles; the runs, far fewer than the rows, are shuffled once.
    Only the first and last run of a slice can continue in a neighbour, so only those (two rows
    per slice) are ordered over the whole series.
    """
    part = [*keys, "_slice"]
    ts = order[0]
    w = Window.partitionBy(*part).orderBy(*order, state)
    ends = (
        _sliced(df.select(*keys, *order, state), chunk)
        .withColumns(
            {
                "_rn": F.row_number().over(w),
                "_prev": F.lag(state).over(w),
                "_next": F.lead(state).over(w),
                "_last": F.lead(F.lit(1)).over(w).isNull(),
            }
        )
        .withColumn("_opens", (F.col("_rn") == 1) | ~F.col("_prev").eqNullSafe(F.col(state)))
        .withColumn("_closes", F.col("_last") | ~F.col("_next").eqNullSafe(F.col(state)))
        .where(F.col("_opens") | F.col("_closes"))
    )
    single = F.col("_closes")
    runs = (
        ends.withColumns({"_ts2": F.lead(ts).over(w), "_rn2": F.lead("_rn").over(w), "_last2": F.lead("_last").over(w)})
        .where(F.col("_opens"))
        .select(
            *part,
            state,
            "_rn",
            F.col(ts).alias("seg_start"),
            F.when(single, F.col(ts)).otherwise(F.col("_ts2")).alias("seg_end"),
            F.when(single, F.lit(1)).otherwise(F.col("_rn2") - F.col("_rn") + 1).cast("bigint").alias("n_rows"),
            F.when(single, F.col("_last")).otherwise(F.col("_last2")).alias("_last"),
        )
        .repartition(*part)
    )
    at_edge = (F.col("_rn") == 1) | F.col("_last")
    cols = [*keys, state, "seg_start", "seg_end", "n_rows"]
    closed = runs.where(~at_edge).select(*cols)
    w_series = Window.partitionBy(*keys).orderBy("_slice", "_rn")
    contact = F.when(F.col("_rn") == 1, F.lag(state).over(w_series).eqNullSafe(F.col(state))).otherwise(False)
    merged = (
        runs.where(at_edge)
        .withColumn("_new", F.when(F.row_number().over(w_series) == 1, 1).when(contact, 0).otherwise(1))
        .withColumn("_isle", F.sum("_new").over(w_series.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_isle", state)
        .agg(
            F.min_by("seg_start", F.struct("_slice", "_rn")).alias("seg_start"),
            F.max_by("seg_end", F.struct("_slice", "_rn")).alias("seg_end"),
            F.sum("n_rows").alias("n_rows"),
        )
        .select(*cols)
    )
    return closed.unionByName(merged)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key.

    An aggregate, not a window: copies of one key are reduced before the shuffle, however many.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def fit_slice_seconds(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target_rows: int = 1_000_000,
    lengths: Sequence[int] = (86_400 * 30, 86_400, 3_600, 60),
) -> int:
    """The longest slice length for which no series has more than ``target_rows`` rows in a slice,
    or the shortest length if none fits.

    One read: rows are counted at the shortest length (combined before the shuffle), the counts are
    summed up for the longer ones, and one maximum per length comes back.
    """
    shortest = min(lengths)
    base = df.groupBy(*keys, time_chunk(ts, shortest).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    levels = base.withColumn("_len", F.explode(F.array(*[F.lit(x) for x in lengths])))
    per_slice = levels.groupBy(*keys, "_len", F.floor(F.col("_s") * shortest / F.col("_len")).alias("_g")).agg(
        F.sum("_n").alias("_n")
    )
    worst = {r["_len"]: r["_n"] for r in per_slice.groupBy("_len").agg(F.max("_n").alias("_n")).collect()}
    fitting = [x for x in lengths if worst.get(x, 0) <= target_rows]
    return max(fitting) if fitting else shortest
