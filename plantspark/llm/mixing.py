"""Mixing sources to target weights: a proportionally fair order of source blocks."""

from __future__ import annotations

from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.llm.common import columns

#: Slots of one round of a rounded schedule (``round_slots``), before each source gets at least one.
ROUND = 1000
BLOCK = 32
#: Rows of a source are ranked in this many hash ranges.
RANGES = 65_536


def natural_weights(docs: DataFrame, root: bool = True) -> DataFrame:
    """``source``, ``weight``: the square root of its rows (rounded up), which lifts small sources; or its rows."""
    n = columns(docs, "source").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", (F.ceil(F.sqrt("n")) if root else F.col("n")).cast("long").alias("weight"))


def _all_sources(weights: DataFrame, round_slots: int) -> DataFrame:
    """One row with the sources by name and their slots of a round: their share of ``round_slots`` rounded down, one at least."""
    rows = F.sort_array(F.collect_list(F.struct("source", F.col("weight").cast("long").alias("weight"))))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    quota = F.transform(
        "all", lambda x: F.greatest(F.lit(1).cast("long"), F.floor(F.try_divide(x["weight"] * round_slots, F.col("total"))))
    )
    one = weights.where(F.col("weight") > 0).agg(rows.alias("all")).where(F.size("all") > 0)
    return (
        one.withColumn("total", total)
        .select(F.transform("all", lambda x: x["source"]).alias("names"), quota.cast("array<bigint>").alias("quota"))
        .withColumn("slots", F.aggregate("quota", F.lit(0).cast("long"), lambda a, x: a + x))
    )


def _release(i: Column, quota: Column, slots: Column) -> Column:
    return F.floor(i * slots / quota).cast("long")


def _deadline(i: Column, quota: Column, slots: Column) -> Column:
    return F.ceil((i + 1) * slots / quota).cast("long")


def schedule(weights: DataFrame, round_slots: int = ROUND) -> DataFrame:
    """One round as rows ``slot, source, quota, slots, nth``: ``nth`` block (from 0) of the source runs in this slot.

    Block i of a source with q of Q slots may not run before floor(i Q / q) and must end by ceil((i + 1) Q / q).
    In each slot the released block with the earliest deadline runs; this meets all deadlines since the shares
    add up to Q, so at any time each source is less than one block from its exact share. Only the list of
    sources and its fixed round pass through the one row this is computed in, never rows of the corpus.
    """
    every = _all_sources(weights, round_slots)
    n = F.size("names")

    def step(acc: Column, t: Column) -> Column:
        def ready(k: Column) -> Column:
            q = F.get("quota", k)
            done = F.get(acc["done"], k)
            return F.when(
                (done < q) & (_release(done, q, F.col("slots")) <= t),
                F.struct(_deadline(done, q, F.col("slots")).alias("deadline"), (-q).alias("rank"), k.alias("k")),
            )

        pick = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), ready))["k"]
        return F.transform(
            F.array(pick),
            lambda p: F.struct(
                F.transform(acc["done"], lambda d, k: F.when(k == p, d + 1).otherwise(d)).alias("done"),
                F.concat(acc["order"], F.array(p)).alias("order"),
            ),
        )[0]

    start = F.struct(F.transform("quota", lambda q: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), start, step, lambda acc: acc["order"])
    laid = every.withColumn("order", order).select("names", "quota", "slots", F.posexplode("order").alias("slot", "k"))
    # The round is short by construction (``round_slots`` plus a slot for each further source).
    nth = F.row_number().over(Window.partitionBy("k").orderBy("slot")) - 1
    return laid.select(
        F.col("slot").cast("long").alias("slot"),
        F.get("names", F.col("k")).alias("source"),
        F.get("quota", F.col("k")).alias("quota"),
        "slots",
        nth.cast("long").alias("nth"),
    )


def rank_in_source(docs: DataFrame, ranges: int = RANGES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source``, the carried columns and ``rank`` (from 0) in the order of md5(doc_id): counts of hash ranges give each range its first rank.

    So the rows of one source are never sorted in one task, however large its share.
    """
    d = columns(docs, "doc_id", "source", *carry).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("part", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int"))
    sizes = d.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("h", "doc_id")) - 1
    ranked = d.select("doc_id", "source", *carry, "part", inside.alias("inside"))
    joined = ranked.join(first, ranked["source"].eqNullSafe(first["s"]) & (ranked["part"] == first["p"]))
    return joined.select("doc_id", "source", *carry, (F.col("first") + F.col("inside")).cast("long").alias("rank"))


def fair_slots(weights: list[int], lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``source, nth block, slot, release, deadline`` with source k due ``weights[k]`` of each ``sum(weights)`` slots, exactly.

    The rule is that of :func:`schedule`, over the first ``lengths[k]`` blocks of each source; slots in which none
    of them is released stay free. Numbers are whole, so no share is rounded.
    """
    total = sum(weights)
    done = [0] * len(weights)
    waiting = [(0, k) for k, n in enumerate(lengths) if n]
    heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out, t = [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            k = heappop(waiting)[1]
            heappush(ready, (-(-(done[k] + 1) * total // weights[k]), -weights[k], k))
        deadline, _, k = heappop(ready)
        out.append((k, done[k], t, done[k] * total // weights[k], deadline))
        done[k] += 1
        t += 1
        if done[k] < lengths[k]:
            heappush(waiting, (done[k] * total // weights[k], k))
    return out


def whole_numbers(weights: list[str]) -> list[int]:
    """The smallest whole numbers in the proportions of decimal numbers over 0."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    whole = [int(x * scale) for x in exact]
    common = gcd(*whole)
    return [w // common for w in whole]


def exact_schedule(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """``source, nth, quota, slots, slot, release, deadline`` for ``source, weight, n`` (its rows), from unrounded weights.

    One round of as many slots as the whole weights add up to, or, where all blocks are fewer, all blocks once
    (``slots`` is 0 then and ``quota`` the source's blocks). Only the sources and these slots pass through the
    driver; with natural weights a round has at most the root of sources times rows.
    """
    rows = weights.select("source", F.col("weight").cast("string").alias("weight"), F.ceil(F.col("n") / block).cast("long").alias("blocks")).orderBy("source").toArrow()
    blocks = rows["blocks"].to_pylist()
    whole = whole_numbers(rows["weight"].to_pylist()) if blocks else []
    total = sum(whole)
    quota, slots = (whole, total) if total <= sum(blocks) else (blocks, 0)
    k, nth, slot, release, deadline = (pa.array(c, pa.int64()) for c in (zip(*fair_slots(whole, quota), strict=True) if blocks else ((),) * 5))
    table = {"source": rows["source"].take(k), "nth": nth, "quota": pa.array(quota, pa.int64()).take(k), "slots": pa.array([slots] * len(k), pa.int64())}
    out = weights.sparkSession.createDataFrame(pa.table(table | {"slot": slot, "release": release, "deadline": deadline}))
    return out.withColumn("source", F.col("source").cast(weights.schema["source"].dataType))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, round_slots: int | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, source, block, release, deadline, slot, position`` for every row of ``docs``, with the columns to carry.

    Blocks of ``block`` rows of a source, in the order of a hash of ``doc_id``, follow the schedule, round after
    round; reading by ``position`` gives each source its weight while it lasts, to less than one block at any
    length, and the others keep their proportions afterwards. Nothing is dropped or repeated: sources that
    ``weights`` (``source``, ``weight`` over 0, whole or fractional) doesn't name come with a weight of 1. With
    ``round_slots`` the weights are first rounded down to slots of such a round, one at least, and the deviation
    is from those. A null source is a source, a null ``doc_id`` sorts as an empty one; rows alike in both differ
    only in position. An empty table gives an empty result.
    """
    found = natural_weights(docs)
    if weights is not None:
        given = columns(weights, "source", "weight").select(F.col("source").alias("g"), F.col("weight").alias("w")).where("w > 0")
        given = given.groupBy("g").agg(F.max("w").alias("w"))
        found = found.join(given, F.col("source").eqNullSafe(F.col("g")), "left").select("source", F.coalesce("w", F.lit(1)).alias("weight"))
    ranked = rank_in_source(docs, carry=carry).withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    if round_slots is None:
        sizes = columns(docs, "source").groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
        plan = exact_schedule(found.join(sizes, F.col("source").eqNullSafe(F.col("s"))).drop("s"), block)
    else:
        plan = schedule(found.withColumn("weight", F.greatest(F.lit(1), F.col("weight"))), round_slots)
        due = [f(F.col("nth"), F.col("quota"), F.col("slots")).alias(n) for f, n in ((_release, "release"), (_deadline, "deadline"))]
        plan = plan.select("*", *due)
    quotas = plan.where("nth = 0").select(F.col("source").alias("qs"), "quota", "slots")
    ranked = ranked.join(quotas, F.col("source").eqNullSafe(F.col("qs"))).drop("qs")
    slots = plan.select(F.col("source").alias("ps"), "nth", F.col("slot").alias("at"), F.col("release").alias("from"), F.col("deadline").alias("to"))
    placed = ranked.join(slots, F.col("source").eqNullSafe(F.col("ps")) & (F.col("block") % F.col("quota") == F.col("nth")))
    before = F.floor(F.col("block") / F.col("quota")).cast("long") * F.col("slots")
    return placed.select(
        "doc_id",
        "source",
        *carry,
        "block",
        (before + F.col("from")).alias("release"),
        (before + F.col("to")).alias("deadline"),
        (before + F.col("at")).alias("slot"),
        ((before + F.col("at")) * block + F.col("rank") % block).alias("position"),
    )
