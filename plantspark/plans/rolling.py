"""Rolling windows of any width from blocks of rows: the end of one block, whole blocks, the start of another.

A window function over the last ``n`` rows reads all of them again for each row. Here the rows of a series are
numbered and cut into blocks; a block gives each of its rows what stands before it in the block (from the front)
and what follows from it on (from the back), both running values. The window of row p is then the end of
the block of row p - n, whole blocks, and the start of p's own block. Running states merge: counts, sums, least,
most, and mean with squared deviations, which unlike a difference of running sums lose no digits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plantspark.plans.joins import key_join
from plantspark.plans.slices import MAX_ROWS, Slices

#: Name of a result: its column, ``mean``, ``std``, ``min`` or ``max``, and the values that its window needs at least.
Wanted = Mapping[str, tuple[str, str, int]]
PARTS = {"mean": ("sum",), "min": ("min",), "max": ("max",), "std": ("avg", "m2")}


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Slices | Column | None) -> DataFrame:
    """``df`` with ``_pos``, the number of a row in its series from 0.

    Rows with equal order columns are numbered by ``values``, so a number names the same values however often it is
    made. With measured slices a row is numbered within its slice and moved by the rows before the slice; with a
    slice column those rows are counted here.
    """
    within = [*order, *[v for v in values if v not in order]]
    if chunk is None or isinstance(chunk, Slices) and chunk.is_single:
        return df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*within)).cast("bigint") - 1)
    if isinstance(chunk, Slices):
        sliced, before = chunk.add(df), chunk.table.select(*keys, "_slice", "_before")
    else:
        sliced = df.withColumn("_slice", chunk)
        upto = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        before = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_slice", F.sum("_n").over(upto).alias("_before"))
    local = sliced.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*within)).cast("bigint") - 1)
    placed = key_join(local, before, [*keys, "_slice"])
    return placed.withColumn("_pos", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_slice", "_local", "_before")


def _states(needs: Mapping[str, set[str]], tag: str, w: WindowSpec | None) -> dict[str, Column]:
    """Columns with the state of each value over a window (or of a group)."""
    out = {}
    for i, (c, parts) in enumerate(needs.items()):
        v = F.col(c).cast("double")
        made = {"n": F.count(v), "sum": F.sum(v), "min": F.min(c), "max": F.max(c), "avg": F.avg(v), "m2": F.var_pop(v) * F.count(v)}
        if w is not None:
            made |= {k: m.over(w) for k, m in made.items() if k != "m2"}
            made["m2"] = F.var_pop(v).over(w) * F.count(v).over(w)
        out |= {f"_{tag}{i}_{k}": made[k] for k in ("n", *sorted(parts))}
    return out


def _merged(tags: Sequence[str], i: int, part: str) -> Column:
    def of(tag: str, p: str) -> Column:
        return F.col(f"_{tag}{i}_{p}")

    if part in ("min", "max"):
        each = [of(t, part) for t in tags]
        return each[0] if len(each) == 1 else (F.least if part == "min" else F.greatest)(*each)
    if part in ("n", "sum"):
        return reduce(lambda a, b: a + b, [F.coalesce(of(t, part), F.lit(0)) for t in tags])
    zero = F.lit(0.0)
    n, avg, m2 = F.coalesce(of(tags[0], "n"), F.lit(0)), F.coalesce(of(tags[0], "avg"), zero), F.coalesce(of(tags[0], "m2"), zero)
    for t in tags[1:]:
        k, mean, dev = F.coalesce(of(t, "n"), F.lit(0)), F.coalesce(of(t, "avg"), zero), F.coalesce(of(t, "m2"), zero)
        both, apart = n + k, mean - avg
        m2 = m2 + dev + F.coalesce(F.try_divide(apart * apart * n * k, both), zero)
        avg = F.coalesce(F.try_divide(n * avg + k * mean, both), zero)
        n = both
    return m2


def _result(tags: Sequence[str], i: int, agg: str, need: int) -> Column:
    n = _merged(tags, i, "n")
    if agg == "mean":
        value = F.try_divide(_merged(tags, i, "sum"), n.cast("double"))
    elif agg == "std":
        value = F.when(n > 1, F.sqrt(F.try_divide(_merged(tags, i, "m2"), (n - 1).cast("double"))))
    else:
        value = _merged(tags, i, agg)
    return F.when(n >= need, value)


def rolling_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: Mapping[int, Wanted],
    chunk: Slices | Column | None = None,
    max_block: int = MAX_ROWS,
) -> DataFrame:
    """``df`` with a column per wanted result over the ``n`` rows before each row, for every ``n`` in ``wanted``.

    Blocks have ``n`` rows, at most ``max_block``: no task sorts more rows of a series than that at a time. Beyond
    ``max_block`` the whole blocks in between, one row each, are aggregated along the series. Each width costs one
    shuffle of the rows by block, one of the values by row number, and a join on the number, which no hot series
    can skew. Null values do not count, a null key is a key, null order values come first; near the start of a
    series the window holds the rows there are, and a result is null below the values it needs. Which of several rows
    with equal order columns comes first follows from the wanted columns' values, so rows equal in these too are
    interchangeable.
    """
    columns = list(dict.fromkeys(c for w in wanted.values() for c, _, _ in w.values()))
    out = numbered(df, keys, order, columns, chunk)
    for n, results in wanted.items():
        needs: dict[str, set[str]] = {}
        for c, agg, _ in results.values():
            needs.setdefault(c, set()).update(PARTS[agg])
        block = min(n, max_block)
        whole, rest = divmod(n, block)
        held = out.withColumn("_block", F.floor(F.col("_pos") / F.lit(block)))
        part = Window.partitionBy(*keys, "_block")
        front = part.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
        back = part.orderBy(F.desc("_pos")).rowsBetween(Window.unboundedPreceding, 0)
        ends = held.select(*keys, "_pos", "_block", *needs).select(*keys, (F.col("_pos") + n).alias("_pos"), *[c.alias(k) for k, c in _states(needs, "e", back).items()])
        joined = key_join(held.withColumns(_states(needs, "f", front)), ends, [*keys, "_pos"])
        tags = ["e", "f"]
        if whole > 1 or rest:
            sums = held.groupBy(*keys, "_block").agg(*[c.alias(k) for k, c in _states(needs, "b", None).items()])
            along = Window.partitionBy(*keys).orderBy("_block")
            few = _along(sums, needs, "m", along, whole - 1)
            many = _along(few, needs, "l", along, whole) if rest else few
            joined = key_join(joined, many.drop(*_states(needs, "b", None)), [*keys, "_block"])
            # p - n lies in the block `whole` before p's, or one further if p stands before `rest` in its block.
            far = F.col("_pos") % F.lit(block) < rest
            if rest:
                joined = joined.withColumns({c.replace("_m", "_w", 1): F.when(far, F.col(c.replace("_m", "_l", 1))).otherwise(F.col(c)) for c in _states(needs, "m", None)})
            tags = ["e", "w" if rest else "m", "f"]
        index = {c: i for i, c in enumerate(needs)}
        made = joined.withColumns({name: _result(tags, index[c], agg, need) for name, (c, agg, need) in results.items()})
        out = made.select(*out.columns, *results)
    return out.drop("_pos")


def _along(sums: DataFrame, needs: Mapping[str, set[str]], tag: str, along: WindowSpec, blocks: int) -> DataFrame:
    """``sums`` with the merged state of the ``blocks`` blocks before each; none for 0."""
    out = {}
    frame = along.rowsBetween(-blocks, -1)
    for i, (c, parts) in enumerate(needs.items()):
        def of(p: str, i=i) -> Column:
            return F.col(f"_b{i}_{p}")

        n = F.sum(of("n")).over(frame)
        made = {"n": n}
        if "sum" in parts:
            made["sum"] = F.sum(of("sum")).over(frame)
        if "min" in parts:
            made["min"] = F.min(of("min")).over(frame)
        if "max" in parts:
            made["max"] = F.max(of("max")).over(frame)
        if "m2" in parts:
            # Deviations within the blocks and of their means from the mean of all.
            avg = F.try_divide(F.sum(of("avg") * of("n")).over(frame), n)
            listed = F.collect_list(F.struct(of("n").alias("n"), F.coalesce(of("avg"), F.lit(0.0)).alias("avg"), F.coalesce(of("m2"), F.lit(0.0)).alias("m2"))).over(frame)
            made["avg"] = avg
            made["m2"] = F.aggregate(listed, F.lit(0.0), lambda a, x: a + x["m2"] + x["n"] * (x["avg"] - F.coalesce(avg, F.lit(0.0))) * (x["avg"] - F.coalesce(avg, F.lit(0.0))))
        none = {p: F.lit(0 if p == "n" else None).cast("bigint" if p == "n" else "double") for p in made}
        out |= {f"_{tag}{i}_{p}": (v if blocks > 0 else none[p]) for p, v in made.items()}
    return sums.withColumns(out)
