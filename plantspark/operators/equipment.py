"""Equipment states, interlock rules, run-time analysis and their audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.timefx import minutes_between
from plantspark.operators.flags import with_flags
from plantspark.plans.ordered import chunk_of, prefix, segments, windowed
from plantspark.plans.slices import Slices
from plantspark.plans.stored import stored
from plantspark.schema import SERIES

ON, OFF, TRANSITION, UNKNOWN = "ON", "OFF", "TRANSITION", "UNKNOWN"

# ---------------------------------------------------------------- fixed values
#: (ON above, OFF below) by physical type: kW for machines and meters, Hz for drives.
STATE_LIMITS = {
    "chiller": (10.0, 2.0),
    "power_meter": (10.0, 2.0),
    "pump": (35.0, 5.0),
    "fan": (35.0, 5.0),
}

KIND_FLAG = {
    "requires": "REQUIRES_VIOLATION",
    "mutex": "MUTEX_VIOLATION",
    "sequence": "SEQUENCE_VIOLATION",
    "range": "PHYSICAL_IMPOSSIBLE",
    "threshold": "LOGIC_CONSTRAINT_VIOLATION",
    "min_runtime": "MIN_RUNTIME_VIOLATION",
    "min_downtime": "MIN_DOWNTIME_VIOLATION",
}


def equipment_state(value: Column | str, physical_type: Column | str, limits: dict = STATE_LIMITS) -> Column:
    """ON, OFF, TRANSITION between the two limits, UNKNOWN for null or an unhandled type."""
    v = F.col(value) if isinstance(value, str) else value
    t = F.lit(physical_type) if isinstance(physical_type, str) else physical_type
    out = F.lit(UNKNOWN)
    for name, (hi, lo) in limits.items():
        state = F.when(v > hi, ON).when(v < lo, OFF).otherwise(TRANSITION)
        out = F.when((t == name) & v.isNotNull(), state).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """One equipment rule over a wide table. ``kind`` decides which fields are used.

    requires: any ``trigger`` on while the ``required`` devices are not (``need='any'``: none of
    them on; ``need='all'``: at least one off). mutex: more than one of ``trigger`` on.
    range: ``column`` outside ``low..high``. threshold: ``column / rated`` below ``low`` or above
    ``high``, while a trigger (if given) is on.
    """

    rule_id: str
    kind: str
    trigger: Sequence[str] = ()
    required: Sequence[str] = ()
    column: str | None = None
    low: float | None = None
    high: float | None = None
    rated: float = 1.0
    on_above: float = 0.5
    need: str = "any"
    critical: bool = False
    soft: bool = False

    def is_on(self, column: str) -> Column:
        return F.coalesce(F.col(column) > F.lit(self.on_above), F.lit(False))

    def violated(self) -> Column:
        any_on = F.lit(False)
        for c in self.trigger:
            any_on = any_on | self.is_on(c)
        if self.kind == "requires":
            # The trigger may be analog (a valve position); required devices are 0/1 states.
            held = [F.coalesce(F.col(c) > F.lit(0.5), F.lit(False)) for c in self.required]
            if self.need == "any":
                met = F.lit(False)
                for h in held:
                    met = met | h
            else:
                met = F.lit(True)
                for h in held:
                    met = met & h
            return any_on & ~met
        if self.kind == "mutex":
            return sum((self.is_on(c).cast("int") for c in self.trigger), F.lit(0)) > 1
        if self.kind in ("range", "threshold"):
            v = F.col(self.column) / F.lit(float(self.rated))
            bad = F.lit(False)
            if self.low is not None:
                bad = bad | (v < F.lit(self.low))
            if self.high is not None:
                bad = bad | (v > F.lit(self.high))
            return F.coalesce(bad, F.lit(False)) & (any_on if self.trigger else F.lit(True))
        raise ValueError(f"{self.kind} is no row rule; see the ordered checks of this module")

    @property
    def is_hard(self) -> bool:
        """Critical, requires and sequence rules are hard; rules marked soft and mutexes are soft."""
        if self.critical or self.kind in ("requires", "sequence"):
            return True
        return not self.soft and self.kind != "mutex"

    def relaxed(self, share: float = 0.1) -> Rule:
        """The rule with its limits loosened, as the second rung of the fallback ladder uses it."""
        from dataclasses import replace

        low = None if self.low is None else self.low * (1 - share)
        high = None if self.high is None else self.high * (1 + share)
        return replace(self, low=low, high=high)


def running_at_zero_hz(status: str, hz: str) -> Column:
    return (F.col(status) == 1) & (F.col(hz) == 0)


def apply_rules(df: DataFrame, rules: Sequence[Rule], flags: str = "quality_flags") -> DataFrame:
    """Append the flag of every violated rule; all rules are evaluated in one pass over the row."""
    by_flag: dict[str, Column] = {}
    for r in rules:
        f = KIND_FLAG[r.kind]
        by_flag[f] = by_flag[f] | r.violated() if f in by_flag else r.violated()
    return with_flags(df, by_flag, flags)


def audit_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per rule: violations, rate and severity, from one conditional aggregate."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(r.violated().cast("long")).alias(r.rule_id) for r in rules]
    )
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.kind)])
    return wide.unpivot(["_n"], [r.rule_id for r in rules], "rule_id", "violations").select(
        "rule_id",
        kinds[F.col("rule_id")].alias("kind"),
        F.coalesce("violations", F.lit(0).cast("long")).alias("violations"),
        F.col("_n").alias("total_rows"),
        F.round(_rate(F.coalesce("violations", F.lit(0)), F.col("_n")), 2).alias("rate_percent"),
        severity(_rate(F.coalesce("violations", F.lit(0)), F.col("_n"))).alias("severity"),
    )


def audit_record(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row for a batch's audit trail: the rules applied, violations found and their counts."""
    by_rule = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "violations"))))
    return audit_rules(df, rules).agg(
        F.array_sort(F.collect_list("rule_id")).alias("constraints_applied"),
        F.sum("violations").alias("violations_detected"),
        by_rule.alias("violation_details"),
    )


def _rate(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), total.cast("double")), F.lit(0.0))


def severity(rate_percent: Column) -> Column:
    return F.when(rate_percent > 5, "HIGH").when(rate_percent >= 1, "MEDIUM").otherwise("LOW")


def violation_summary(flagged: DataFrame, flag_names: Sequence[str], flags: str = "quality_flags") -> DataFrame:
    """One row: rows checked, rows with any violation, rate, severity, count per flag."""
    hit = F.arrays_overlap(flags, F.array(*[F.lit(f) for f in flag_names]))
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(hit.cast("long")).alias("violation_rows"),
        *[F.sum(F.array_contains(flags, f).cast("long")).alias(f.lower()) for f in flag_names],
    ).withColumn("rate_percent", F.round(_rate(F.col("violation_rows"), F.col("total_rows")), 2)).withColumn(
        "severity", severity(_rate(F.col("violation_rows"), F.col("total_rows")))
    )


def violation_samples(
    flagged: DataFrame, keys: Sequence[str], ts: str = "ts", flags: str = "quality_flags", n: int = 3
) -> DataFrame:
    """The first ``n`` timestamps per key and flag (the top-n cut happens before the shuffle)."""
    from pyspark.sql.window import Window

    rows = flagged.select(*keys, ts, F.explode(flags).alias("flag"))
    w = Window.partitionBy(*keys, "flag").orderBy(ts)
    return rows.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= n)


def state_segments(
    df: DataFrame,
    slices: int | Slices | None = None,
    state: str = "state",
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = ("ts", "row_no"),
) -> DataFrame:
    """Runs of equal state with start, end, row count and minutes."""
    return segments(df, keys, order, state, chunk_of(df, keys, order, slices)).withColumn(
        "minutes", minutes_between("seg_start", "seg_end")
    )


def runtime_violations(segs: DataFrame, min_run: float = 30.0, min_down: float = 15.0, state: str = "state") -> DataFrame:
    """Runs shorter than the minimum run time and stops shorter than the minimum down time."""
    run = (F.col(state) == ON) & (F.col("minutes") < F.lit(min_run))
    down = (F.col(state) == OFF) & (F.col("minutes") < F.lit(min_down))
    return (
        segs.where(run | down)
        .withColumn("violation", F.when(run, KIND_FLAG["min_runtime"]).otherwise(KIND_FLAG["min_downtime"]))
        .withColumn("required_minutes", F.when(run, F.lit(float(min_run))).otherwise(F.lit(float(min_down))))
    )


def start_events(
    df: DataFrame,
    slices: int | Slices | None = None,
    state: str = "state",
    keys: Sequence[str] = tuple(SERIES),
    order: Sequence[str] = ("ts", "row_no"),
) -> DataFrame:
    """Rows at which a device turns ON; the first row of a series counts when it is ON."""
    prev = windowed(df, keys, order, 1, {"_prev": lambda w: F.lag(state).over(w)}, chunk_of(df, keys, order, slices))
    return prev.where((F.col(state) == ON) & ~F.col("_prev").eqNullSafe(F.lit(ON))).drop("_prev")


def startup_sequence(
    states: DataFrame,
    first_device: str,
    next_device: str,
    slices: int | None = None,
    site: Sequence[str] = ("site_id",),
    device: str = "device",
    state: str = "state",
    order: Sequence[str] = ("ts", "row_no"),
) -> DataFrame:
    """Every start of ``next_device`` with the state of ``first_device`` at that moment. ``slices``: seconds, or None to measure.

    ``violated`` is true unless that state is ON. The as-of lookup is one ordered pass over both
    streams (last known state up to each start), not a range join.
    """
    keys = list(site)
    following = states.where(F.col(device) == next_device)
    chunk = chunk_of(following, [*keys, device], order, slices) if slices is None else slices
    starts = start_events(following, chunk, state, [*keys, device], order)
    # Long series: the starts, few of their rows, are kept, as the slices of both devices are measured over them.
    nxt = stored(starts.select(*keys, *order), "starts") if isinstance(chunk, Slices) and not chunk.is_single else starts
    pre = states.where(F.col(device) == first_device)
    null_state = F.lit(None).cast("string")
    both = pre.select(*keys, *order, F.lit(0).alias("_is_start"), F.col(state).alias("prior_state")).unionByName(
        nxt.select(*keys, *order, F.lit(1).alias("_is_start"), null_state.alias("prior_state"))
    )
    # A prerequisite reading at the very same time counts as known, so it sorts first.
    both_order = [order[0], "_is_start", *order[1:]]
    asof = prefix(both, keys, both_order, {"prior_state": ("prior_state", "last")}, chunk_of(both, keys, both_order, slices))
    return (
        asof.where(F.col("_is_start") == 1)
        .drop("_is_start")
        .withColumn("violated", ~F.coalesce(F.col("prior_state") == ON, F.lit(False)))
    )


@dataclass(frozen=True)
class RuleTable:
    """Rules as data, for checks on the rule set itself."""

    rules: Sequence[Rule] = field(default_factory=tuple)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.rule_id, r.kind, list(r.trigger), list(r.required)) for r in self.rules]
        return spark.createDataFrame(rows, "rule_id string, kind string, trigger array<string>, required array<string>")


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of rules that contradict: A requires B while A and B exclude each other.

    Both sides become unordered device pairs and meet in an equi join on the pair.
    """
    def pair(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("device_a"), F.greatest(a, b).alias("device_b")]

    req = (
        rules.where(F.col("kind") == "requires")
        .select("rule_id", F.explode("trigger").alias("_t"), "required")
        .select("rule_id", "_t", F.explode("required").alias("_r"))
        .select(F.col("rule_id").alias("requires_rule"), *pair(F.col("_t"), F.col("_r")))
    )
    mut = (
        rules.where(F.col("kind") == "mutex")
        .select("rule_id", "trigger", F.posexplode("trigger").alias("_i", "_t"))
        .select("rule_id", "_t", F.explode(F.slice("trigger", F.col("_i") + 2, F.size("trigger"))).alias("_r"))
        .select(F.col("rule_id").alias("mutex_rule"), *pair(F.col("_t"), F.col("_r")))
    )
    return req.join(mut, ["device_a", "device_b"]).where(F.col("device_a") != F.col("device_b")).distinct()
