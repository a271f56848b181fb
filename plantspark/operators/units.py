"""The cheapest set of units to run for plants of many units: two halves, each trimmed, met by a range search.

Listing every on/off combination doubles with each unit. Here the units of a plant are dealt into two halves; the
combinations of a half are the square root as many. Of these only the useful ones stay: a combination goes if another
carries at least as much for at most the cost. The best partner of a combination is then the cheapest of the other half
that carries the rest, which a running minimum over both halves in falling order of capacity gives to all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantspark.operators.setpoints import SWITCH_PENALTY_KW
from plantspark.plans.joins import key_join
from plantspark.plans.stored import stored

#: States of a half beyond which the search would no longer fit a task.
MOST_STATES_LOG2 = 24


def _options(units: DataFrame, plant: str, unit: str, capacity: str, power: str, current: str | None, group: str | None, penalty: float) -> DataFrame:
    """``plant, block, options``: groups of units of which at most one runs, with what each choice adds."""
    now = F.coalesce(F.col(current).cast("int"), F.lit(0)) if current else F.lit(0)
    own = F.concat(F.lit("unit "), F.col(unit).cast("string"))
    block = F.coalesce(F.concat(F.lit("group "), F.col(group).cast("string")), own) if group else own
    rows = units.select(
        F.col(plant).alias("plant"), block.alias("block"), F.col(unit).cast("string").alias("unit"),
        F.coalesce(F.col(capacity).cast("double"), F.lit(0.0)).alias("cap"), F.coalesce(F.col(power).cast("double"), F.lit(0.0)).alias("kw"), now.alias("now"),
    )
    packed = rows.groupBy("plant", "block").agg(F.array_sort(F.collect_list(F.struct("unit", "cap", "kw", "now"))).alias("us"))
    running = F.aggregate("us", F.lit(0), lambda a, u: a + u["now"])

    def choice(cap: Column, kw: Column, names: Column, switches: Column) -> Column:
        costs = switches if current else F.lit(0)
        return F.struct(cap.alias("cap"), (kw + costs * F.lit(float(penalty))).alias("cost"), kw.alias("kw"), costs.cast("int").alias("switches"), names.alias("units"))

    none = choice(F.lit(0.0), F.lit(0.0), F.array().cast("array<string>"), running)
    each = F.transform("us", lambda u: choice(u["cap"], u["kw"], F.array(u["unit"]), running + 1 - 2 * u["now"]))
    return packed.select("plant", "block", F.concat(F.array(none), each).alias("options"))


def _trimmed(states: DataFrame) -> DataFrame:
    """Combinations of a half that no other beats in capacity and cost; of equal ones the first by name."""
    falling = Window.partitionBy("plant", "half").orderBy(F.desc("cap"), "cost", "units")
    best = F.min("cost").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    return states.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("cost") < F.col("_best"))).drop("_best")


def cheapest_units(
    units: DataFrame,
    plant: str,
    unit: str,
    capacity: str,
    power: str,
    targets: DataFrame,
    current: str | None = None,
    group: str | None = None,
    penalty: float = SWITCH_PENALTY_KW,
) -> DataFrame:
    """``plant, target_rt, units, n_on, total_capacity, total_kw, switches, objective_kw``: the cheapest set that carries the target.

    ``targets`` has a row per plant with ``target_rt``. The objective is the power of the running units and, with the 0/1
    column ``current``, a ``penalty`` for each unit switched; ``group`` names units of which at most one may run (null: free).
    A plant that cannot carry its target has no row, nor one with a null target; null capacities and powers are 0.
    Of equally good sets one comes. Each half of a plant may have up to 2**24 combinations (some 48 free units, more where
    groups bind them); a larger plant is an error, and ``greedy_order`` the caller's choice. Plants are spread over the
    tasks; within a half combinations are made block by block, trimmed after every four, and never gathered in an array.
    """
    options = stored(_options(units, plant, unit, capacity, power, current, group, penalty), "unit-options")
    bits = F.log2(F.size("options").cast("double"))
    upto = Window.partitionBy("plant").orderBy(F.desc(F.size("options")), "block").rowsBetween(Window.unboundedPreceding, 0)
    dealt = options.withColumns({"_upto": F.sum(bits).over(upto), "_all": F.sum(bits).over(Window.partitionBy("plant"))})
    dealt = dealt.withColumn("half", (F.col("_upto") > F.col("_all") / 2 + 1e-9).cast("int"))
    sizes = dealt.groupBy("plant", "half").agg(F.sum(bits).alias("_bits"), F.array_sort(F.collect_list(F.struct("block", "options"))).alias("blocks"))
    asked_for = targets.select(F.col(plant).alias("plant"), F.col("target_rt").cast("double").alias("target_rt")).where("target_rt IS NOT NULL").distinct()
    wanted = key_join(sizes, asked_for.select("plant"), ["plant"], "left_semi")
    limit = F.when(F.col("_bits") <= MOST_STATES_LOG2, F.col("blocks")).otherwise(F.raise_error(F.lit("a plant has too many units for a full search; use greedy_order")).cast(sizes.schema["blocks"].dataType))
    halves = stored(wanted.select("plant", "half", limit.alias("blocks")).repartition("plant", "half"), "unit-halves")
    most = halves.agg(F.max(F.size("blocks"))).first()[0] or 0
    zero = {"cap": F.lit(0.0), "cost": F.lit(0.0), "kw": F.lit(0.0), "switches": F.lit(0), "units": F.array().cast("array<string>")}
    states = halves.withColumns(zero)
    for i in range(most):
        added = F.when(F.size("blocks") > i, F.get("blocks", F.lit(i))["options"]).otherwise(F.array(F.struct(*[v.alias(k) for k, v in zero.items()])))
        states = states.withColumn("_o", F.explode(added)).select(
            "plant", "half", "blocks",
            *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in ("cap", "cost", "kw", "switches")],
            F.concat("units", "_o.units").alias("units"),
        )
        if i % 4 == 3:
            states = _trimmed(states)
    states = stored(_trimmed(states).drop("blocks"), "unit-states")
    plants = states.select("plant").distinct()

    def side(half: int) -> DataFrame:
        own = states.where(F.col("half") == half)
        # A plant of one block has one half; the other holds the empty set.
        lacking = key_join(plants, own.select("plant"), ["plant"], "left_anti")
        return own.drop("half").unionByName(lacking.withColumns(zero))

    left, right = side(0), side(1)
    left, right = (key_join(x, asked_for, ["plant"], "inner") for x in (left, right))
    pack = F.struct("cost", "cap", "kw", "switches", "units")
    nothing = F.lit(None).cast(states.select(pack.alias("p")).schema["p"].dataType)
    asked = left.select("plant", "target_rt", (F.col("target_rt") - F.col("cap")).alias("at"), F.lit(1).alias("asks"), pack.alias("a"), nothing.alias("b"))
    given = right.select("plant", "target_rt", F.col("cap").alias("at"), F.lit(0).alias("asks"), nothing.alias("a"), pack.alias("b"))
    # Summing in another order may miss a target by the last bit.
    slack = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs("target_rt"))
    place = F.when(F.col("asks") == 1, F.col("at") - slack).otherwise(F.col("at"))
    falling = Window.partitionBy("plant", "target_rt").orderBy(F.desc(place), "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(given).withColumn("b", F.min("b").over(falling)).where((F.col("asks") == 1) & F.col("b").isNotNull())
    best = met.groupBy("plant", "target_rt").agg(F.min_by(F.struct("a", "b"), F.struct((F.col("a.cost") + F.col("b.cost")).alias("cost"), "a", "b")).alias("s"))

    def total(field: str) -> Column:
        return F.col(f"s.a.{field}") + F.col(f"s.b.{field}")

    chosen = F.array_sort(F.concat("s.a.units", "s.b.units"))
    return best.select(
        F.col("plant").alias(plant), "target_rt", chosen.alias("units"), F.size(chosen).alias("n_on"),
        total("cap").alias("total_capacity"), total("kw").alias("total_kw"), total("switches").alias("switches"), total("cost").alias("objective_kw"),
    )
