"""Set-point search, unit commitment and what-if questions for whole tables of contexts.

A context is one row (a site at one time). Its candidates are a fixed grid of a few hundred
set-points, so they are generated and judged inside the row: no cross join and no shuffle.
Only a fitted model, which scores rows, needs the candidates as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantspark.plans.joins import key_join
from plantspark.plans.ordered import prefix
from plantspark.plans.stored import stored

Scorer = Callable[[Mapping[str, Column]], Column]

SETPOINTS = ["chw_pump_hz", "cw_pump_hz", "ct_fan_hz"]
HZ_RANGE = (30.0, 60.0)
#: Bits of an on/off combination that one task lists for a row; the bits above are listed first and dealt out.
LOW_BITS = 10
SWITCH_PENALTY_KW = 5.0


def hz_steps(lo: float = HZ_RANGE[0], hi: float = HZ_RANGE[1], step: float = 5.0) -> list[float]:
    n = int(round((hi - lo) / step))
    return [lo + i * step for i in range(n + 1)]


def grid_column(axes: Mapping[str, Sequence[float]]) -> Column:
    """All combinations of the axes as one array-of-structs column, first axis slowest."""
    size = grid_size(axes)
    strides, left = {}, size
    for name, values in axes.items():
        left //= len(values)
        strides[name] = left

    def point(i: Column) -> Column:
        fields = []
        for name, values in axes.items():
            axis = F.array(*[F.lit(float(x)) for x in values])
            at = F.floor(i / F.lit(strides[name])).cast("int") % F.lit(len(values))
            fields.append(F.get(axis, at).alias(name))
        return F.struct(*fields)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), point)


def grid_size(axes: Mapping[str, Sequence[float]]) -> int:
    return prod(len(v) for v in axes.values())


def analytic_power(s: Mapping[str, Column], load: Column, low_flow_weight: float = 1.0) -> Column:
    """Plant power from load and drive speeds: cubic drives plus a penalty for starving the
    chillers of water, which gives the optimum an interior."""
    pump = (s["chw_pump_hz"] + s["cw_pump_hz"]) / F.lit(2.0)
    lack_chw = F.lit(50.0) / s["chw_pump_hz"] - F.lit(1.0)
    lack_cw = F.lit(50.0) / s["cw_pump_hz"] - F.lit(1.0)
    lack_fan = F.lit(50.0) / s["ct_fan_hz"] - F.lit(1.0)
    return (
        F.lit(0.7) * load
        + F.lit(10.0) * F.pow(pump / F.lit(50.0), F.lit(3.0))
        + F.lit(5.0) * F.pow(s["ct_fan_hz"] / F.lit(50.0), F.lit(3.0))
        + F.lit(low_flow_weight) * load * (lack_chw * lack_chw + lack_cw * lack_cw + lack_fan * lack_fan)
    )


def best_setpoints(
    contexts: DataFrame,
    scorer: Scorer,
    axes: Mapping[str, Sequence[float]],
    current: Sequence[str] | None = None,
    feasible: Callable[[Mapping[str, Column]], Column] | None = None,
    refine: float | None = None,
    bounds: tuple[float, float] = HZ_RANGE,
) -> DataFrame:
    """Add the set-points of least power, that power, the baseline power and the savings.

    ``scorer`` maps set-point columns to a power column and may use the context's columns.
    ``current`` names the columns with today's settings (default: the middle of the range).
    ``refine`` searches once more around the winner with steps of that size. Ties go to the
    lower set-points. Without a feasible candidate the result columns are null.
    """
    names = list(axes)

    def argmin(points: Column) -> Column:
        pts = F.filter(points, lambda p: feasible({n: p[n] for n in names})) if feasible else points
        scored = F.transform(
            pts, lambda p: F.struct(scorer({n: p[n] for n in names}).alias("kw"), *[p[n].alias(n) for n in names])
        )
        return F.array_min(F.filter(scored, lambda p: p["kw"].isNotNull()))

    out = contexts.withColumn("_best", argmin(grid_column(axes)))
    if refine:
        offsets = grid_column({n: [-2 * refine, -refine, 0.0, refine, 2 * refine] for n in names})
        lo, hi = F.lit(bounds[0]), F.lit(bounds[1])
        near = F.transform(
            offsets, lambda o: F.struct(*[F.greatest(lo, F.least(hi, F.col("_best")[n] + o[n])).alias(n) for n in names])
        )
        out = out.withColumn("_best", F.coalesce(argmin(near), F.col("_best")))
    mid = (bounds[0] + bounds[1]) / 2
    now = {n: F.coalesce(F.col(c), F.lit(mid)) for n, c in zip(names, current)} if current else {n: F.lit(mid) for n in names}
    out = out.withColumns(
        {**{f"best_{n}": F.col("_best")[n] for n in names}, "best_kw": F.col("_best")["kw"], "baseline_kw": scorer(now)}
    )
    return with_savings(out.drop("_best"), "baseline_kw", "best_kw")


def with_savings(df: DataFrame, baseline: str, optimal: str) -> DataFrame:
    """``savings_kw`` and ``savings_percent`` (0 where the baseline is not positive)."""
    save = F.col(baseline) - F.col(optimal)
    pct = F.when(F.col(baseline) > 0, save / F.col(baseline) * F.lit(100.0)).otherwise(F.lit(0.0))
    return df.withColumn("savings_kw", save).withColumn("savings_percent", pct)


def scoring_row(
    s: Mapping[str, Column],
    context: Mapping[str, Column],
    load_cols: Sequence[str] = (),
    chw_pump_cols: Sequence[str] = (),
    cw_pump_cols: Sequence[str] = (),
    fan_cols: Sequence[str] = (),
    temp_cols: Sequence[str] = (),
    other: Mapping[str, Column] | None = None,
) -> dict[str, Column]:
    """Model inputs for one candidate: load split evenly, drive speed copied to each unit, supply
    temperature at its set-point, return 5 degrees above, other temperatures 25."""
    out = {c: context["load_rt"] / F.lit(float(len(load_cols))) for c in load_cols}
    out |= {c: s["chw_pump_hz"] for c in chw_pump_cols}
    out |= {c: s["cw_pump_hz"] for c in cw_pump_cols}
    out |= {c: s["ct_fan_hz"] for c in fan_cols}
    supply = context.get("chw_supply_temp_setpoint", F.lit(7.0))
    for c in temp_cols:
        out[c] = supply if "SWT" in c else supply + F.lit(5.0) if "RWT" in c else F.lit(25.0)
    return out | dict(other or {})


def best_setpoints_by_model(
    contexts: DataFrame,
    context_id: str,
    model,
    inputs: Callable[[Mapping[str, Column]], Mapping[str, Column]],
    axes: Mapping[str, Sequence[float]],
    current: Sequence[str] | None = None,
    feasible: Callable[[Mapping[str, Column]], Column] | None = None,
    bounds: tuple[float, float] = HZ_RANGE,
    refine: float | None = None,
) -> DataFrame:
    """As :func:`best_setpoints` with a fitted model: the context's columns, the winner, baseline and savings.

    ``context_id`` names each context once. The grid and, as one marked point, the current setting are exploded inside
    the task that holds the context, scored once, and reduced to one row per context before anything is shuffled.
    ``refine`` scores a second, finer grid around the winner, kept where it is better. ``violations`` lists set-points
    outside ``bounds``; ``success`` is true where a candidate was found and it has none. A context without a candidate
    keeps null results.
    """
    names = list(axes)
    mid = F.lit((bounds[0] + bounds[1]) / 2)
    now = F.struct(*[(F.coalesce(F.col(c).cast("double"), mid) if c else mid).alias(n) for n, c in zip(names, current or [None] * len(names))])

    def allowed(points: Column) -> Column:
        return F.filter(points, lambda p: feasible({n: p[n] for n in names})) if feasible else points

    def marked(points: Column, is_now: bool) -> Column:
        return F.transform(points, lambda p: F.struct(*[p[n].alias(n) for n in names], F.lit(is_now).alias("_now")))

    def scored(rows: DataFrame, points: Column) -> DataFrame:
        rows = rows.withColumn("_p", F.explode(points))
        rows = rows.withColumns({n: F.col("_p")[n] for n in names}).withColumn("_now", F.col("_p")["_now"]).drop("_p")
        rows = rows.withColumns(dict(inputs({n: F.col(n) for n in names})))
        best = F.min(F.when(~F.col("_now"), F.struct(F.col("prediction").alias("kw"), *names))).alias("_b")
        return model.score(rows).groupBy(context_id).agg(best, F.min(F.when(F.col("_now"), F.col("prediction"))).alias("baseline_kw"))

    points = F.concat(marked(allowed(grid_column(axes)), False), marked(F.array(now), True))
    found = key_join(contexts, scored(contexts, points), [context_id])
    if refine:
        found = stored(found, "coarse-setpoints")
        offsets = grid_column({n: [-2 * refine, -refine, 0.0, refine, 2 * refine] for n in names})
        lo, hi = F.lit(bounds[0]), F.lit(bounds[1])
        near = F.transform(offsets, lambda o: F.struct(*[F.greatest(lo, F.least(hi, F.col("_b")[n] + o[n])).alias(n) for n in names]))
        finer = scored(found.where(F.col("_b").isNotNull()).drop("baseline_kw"), marked(allowed(near), False)).select(context_id, F.col("_b").alias("_finer"))
        found = key_join(found, finer, [context_id]).withColumn("_b", F.least("_b", "_finer")).drop("_finer")
    out = found.withColumns({**{f"best_{n}": F.col("_b")[n] for n in names}, "best_kw": F.col("_b")["kw"]}).drop("_b")
    broken = bound_violations({n: f"best_{n}" for n in names}, *bounds)
    judged = out.withColumn("violations", broken).withColumn("success", F.col("best_kw").isNotNull() & (F.size("violations") == 0))
    return with_savings(judged, "baseline_kw", "best_kw")


def bound_violations(columns: Mapping[str, str], low: float = HZ_RANGE[0], high: float = HZ_RANGE[1]) -> Column:
    """Messages for set-points outside the allowed range, as an array (empty when all are fine)."""
    checks = []
    for label, c in columns.items():
        v = F.col(c)
        checks.append(F.when(v < low, F.concat(F.lit(f"{label} below minimum "), F.format_number(F.lit(low), 1))))
        checks.append(F.when(v > high, F.concat(F.lit(f"{label} above maximum "), F.format_number(F.lit(high), 1))))
    return F.array_compact(F.array(*checks))


# ------------------------------------------------------------------ units on and off


def unit_combinations(
    units: DataFrame,
    plant: str,
    unit: str,
    capacity: str,
    power: str,
    targets: DataFrame,
    current: str | None = None,
    mutex: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every on/off combination whose capacity carries the plant's ``target_rt``.

    The combinations double with each unit; a plant whose combinations have no number (over 62 units) is an
    error, and :func:`greedy_order` the caller's choice for large ones. The upper bits are listed first and dealt out over
    tasks, then the lower ones. ``current`` is a 0/1 column: each switched unit costs ``SWITCH_PENALTY_KW``.
    """
    now = F.col(current).cast("int") if current else F.lit(0)
    packed = (
        units.groupBy(plant)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.col(unit).alias("unit"),
                        F.col(capacity).alias("cap"),
                        F.col(power).alias("kw"),
                        now.alias("now"),
                    )
                )
            ).alias("_u")
        )
    )
    packed = key_join(packed, targets, [plant], "inner")
    n = F.when(F.size("_u") <= 62, F.size("_u")).otherwise(F.raise_error(F.lit("a plant has over 62 units; use greedy_order")).cast("int"))
    one, low = F.lit(1).cast("long"), F.least(F.lit(LOW_BITS), n)

    def up_to(bits: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", one, bits) - 1))

    dealt = packed.withColumn("_high", up_to(n - low)).repartition(plant, "_high").withColumn("_low", up_to(low))

    def total(field: str) -> Column:
        return F.aggregate(
            F.transform("_u", lambda u, i: u[field] * F.getbit(F.col("mask"), i).cast("double")),
            F.lit(0.0),
            lambda a, x: a + x,
        )

    switches = F.aggregate(
        F.transform("_u", lambda u, i: F.when(u["now"] != F.getbit(F.col("mask"), i).cast("int"), 1).otherwise(0)),
        F.lit(0),
        lambda a, x: a + x,
    )
    combos = dealt.withColumn("mask", F.call_function("shiftleft", F.col("_high"), low).bitwiseOR(F.col("_low"))).withColumns({"total_capacity": total("cap"), "total_kw": total("kw")})
    if mutex is not None:
        combos = combos.where(~mutex(F.col("mask")))
    return (
        combos.where(F.col("total_capacity") >= F.col("target_rt"))
        .withColumn("n_on", F.bit_count("mask"))
        .withColumn("switches", switches if current else F.lit(0))
        .withColumn("objective_kw", F.col("total_kw") + F.col("switches") * F.lit(SWITCH_PENALTY_KW))
        .drop("_u", "_high", "_low")
    )


def greedy_order(
    units: DataFrame, plant: str, unit: str, capacity: str, kw_per_rt: str, targets: DataFrame, slice_width: float = 0.05
) -> DataFrame:
    """Merit order: the most efficient units first until the target load is met.

    Adds ``capacity_before`` (of better units) and ``is_on``. The running sum is cut into slices
    of efficiency, so a plant of any size stays distributed.
    """
    cut = F.floor(F.col(kw_per_rt) / F.lit(slice_width)).cast("bigint")
    run = prefix(units, [plant], [kw_per_rt, unit], {"_cum": (capacity, "sum")}, cut)
    return (
        key_join(run, targets, [plant], "inner")
        .withColumn("capacity_before", F.col("_cum") - F.col(capacity))
        .withColumn("is_on", F.col("capacity_before") < F.col("target_rt"))
        .drop("_cum")
    )


def fallback_choice(
    contexts: DataFrame,
    scorer: Scorer,
    axes: Mapping[str, Sequence[float]],
    hard: Callable[[Mapping[str, Column]], Column],
    soft: Callable[[Mapping[str, Column], float], Column],
    greedy: Mapping[str, float],
    current: Sequence[str],
    relax: float = 0.1,
    greedy_usable: Column | None = None,
) -> DataFrame:
    """The best candidate of the first rung that has any: 0 all rules, 1 soft rules relaxed,
    2 the greedy setting if usable and within the hard rules, 3 the current setting."""
    names = list(axes)

    def rung(p) -> Column:
        s = {n: p[n] for n in names}
        return F.when(hard(s) & soft(s, 0.0), 0).when(hard(s) & soft(s, relax), 1)

    searched = F.transform(
        grid_column(axes),
        lambda p: F.struct(rung(p).alias("level"), scorer({n: p[n] for n in names}).alias("kw"), *[p[n].alias(n) for n in names]),
    )
    g = {n: F.lit(float(v)) for n, v in greedy.items()}
    c = {n: F.col(x) for n, x in zip(names, current)}
    fixed = F.array(
        F.struct(F.when(hard(g) if greedy_usable is None else hard(g) & greedy_usable, 2).alias("level"), scorer(g).alias("kw"), *[g[n].alias(n) for n in names]),
        F.struct(F.lit(3).alias("level"), scorer(c).alias("kw"), *[c[n].cast("double").alias(n) for n in names]),
    )
    best = F.array_min(F.filter(F.concat(searched, fixed), lambda p: p["level"].isNotNull()))
    return (
        contexts.withColumn("_b", best)
        .withColumns({"level": F.col("_b")["level"], "chosen_kw": F.col("_b")["kw"], **{f"chosen_{n}": F.col("_b")[n] for n in names}})
        .drop("_b")
    )


# ------------------------------------------------------------------ questions around a result


def sensitivity(
    contexts: DataFrame, power: Callable[[Mapping[str, Column]], Column], inputs: Mapping[str, Column], shifts: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """Change of power when one input moves. ``shifts`` maps a result name to ``(input, change)``;
    a change given as ``'x0.9'`` multiplies instead of adding."""
    base = power(inputs)
    cols = {"base_kw": base}
    for name, (which, change) in shifts.items():
        moved = inputs[which] * F.lit(float(change[1:])) if isinstance(change, str) else inputs[which] + F.lit(float(change))
        cols[name] = power({**inputs, which: moved}) - base
    return contexts.withColumns(cols)


def pareto_front(
    df: DataFrame, keys: Sequence[str], first: str, second: str, slice_width: float
) -> DataFrame:
    """Rows no other row of the key beats in both objectives (smaller is better; ties stay).

    Rows shrink to the least ``second`` per ``first`` before the shuffle; a running minimum over
    slices of ``first`` then decides, and an equi join fetches the rows.
    """
    least = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(*keys, first).agg(F.min(second).alias(second))
    with_key = least.withColumn("_value", F.col(second))
    cut = F.floor(F.col(first) / F.lit(slice_width)).cast("bigint")
    before = prefix(with_key, keys, [first], {"_before": ("_value", "min")}, cut, include_current=False)
    front = before.where(F.col("_before").isNull() | (F.col(second) < F.col("_before"))).select(*keys, first, second)
    return key_join(df, front, [*keys, first, second], "left_semi")


def what_if(
    contexts: DataFrame,
    scorer: Scorer,
    current: Mapping[str, Column],
    recommended: Mapping[str, Column],
    full: float = HZ_RANGE[1],
    load: str = "load_rt",
) -> DataFrame:
    """Power and kW/RT of the current, the recommended and the all-full setting, with savings."""
    cols: dict[str, Column] = {}
    settings = {"current": current, "recommended": recommended, "full": {n: F.lit(full) for n in current}}
    for name, s in settings.items():
        cols[f"{name}_kw"] = scorer(s)
        cols[f"{name}_kw_per_rt"] = F.try_divide(scorer(s), F.col(load))
    return with_savings(contexts.withColumns(cols), "current_kw", "recommended_kw")


# ------------------------------------------------------------------ recorded runs


def savings_summary(runs: DataFrame, savings: str = "savings_kw", percent: str = "savings_percent") -> DataFrame:
    """Runs, total kW, mean and best percentage; zeros for an empty table."""
    zero = F.lit(0.0)
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum(savings), zero).alias("total_savings_kw"),
        F.coalesce(F.avg(percent), zero).alias("avg_savings_percent"),
        F.coalesce(F.max(percent), zero).alias("max_savings_percent"),
    )


def recent_runs(runs: DataFrame, n: int = 20, ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` runs (a distributed top-n, no full sort)."""
    return runs.orderBy(F.desc(ts), *[F.desc(t) for t in tie]).limit(n)
