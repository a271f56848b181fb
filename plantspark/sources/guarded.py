"""Guards on a write: measured while the rows are written anyway, then the batch is committed or turned away.

A guard that counts first runs the whole plan once more. Here the counts are observations on top of the rows being
written; when the write has ended they are known, and only then a small commit names the attempt. Readers see
committed attempts only, so a batch that breaks a guard is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plantspark.functions.timefx import naive_literal

SUSPICIOUS = "DATA_SUSPICIOUS"


class BatchRejected(RuntimeError):
    """A guard turned the batch away; ``metrics`` has what was measured."""

    def __init__(self, problems: Sequence[str], metrics: Mapping) -> None:
        super().__init__("; ".join(problems))
        self.metrics = dict(metrics)


@dataclass(frozen=True)
class Guard:
    """What to measure, which rows to leave out, and what the measures must hold.

    ``metrics`` are aggregates over the rows before any is left out; ``excluded`` marks rows not to be written;
    ``check`` returns a problem, or None; with ``tag`` a problem tags the batch instead of turning it away.
    """

    name: str
    metrics: Mapping[str, Column]
    check: Callable[[Mapping], str | None]
    excluded: Column | None = None
    tag: str | None = None


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def invalid_share(invalid: Column, max_share: float = 0.3, on_trip: str = "reject") -> Guard:
    """Circuit breaker: too many invalid rows turn the batch away, or (``tag``) mark it ``DATA_SUSPICIOUS``."""

    def check(m: Mapping) -> str | None:
        share = m["invalid_rows"] / m["rows_in"] if m["rows_in"] else 0.0
        return f"{share:.1%} of the rows are invalid, limit {max_share:.1%}" if share > max_share else None

    return Guard("invalid_share", {"invalid_rows": _count(invalid)}, check, tag=SUSPICIOUS if on_trip == "tag" else None)


def minimum_samples(features: Sequence[str], label: str, minimum: int = 10, top: int = 5) -> Guard:
    """Complete rows, and the columns with the most nulls if there are too few of them. NaN is no value either."""
    columns = list(dict.fromkeys([*features, label]))

    def lacking(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(F.col(c).try_cast("double")).eqNullSafe(F.lit(True))

    any_lacking = F.lit(False)
    for c in columns:
        any_lacking = any_lacking | lacking(c)

    def check(m: Mapping) -> str | None:
        if m["complete_rows"] >= minimum:
            return None
        worst = sorted(((c, m[f"lacking_{c}"]) for c in columns), key=lambda x: (-x[1], x[0]))[:top]
        return f"{m['complete_rows']} complete rows, {minimum} needed; most nulls: {worst}"

    return Guard("minimum_samples", {"complete_rows": _count(~any_lacking)} | {f"lacking_{c}": _count(lacking(c)) for c in columns}, check)


def no_leakage(cutoff: datetime, ts: str = "ts", exclude: bool = False) -> Guard:
    """Rows after the cut-off turn the batch away, or with ``exclude`` are left out and counted. A null time is not after it."""
    late = F.coalesce(F.col(ts) > naive_literal(cutoff), F.lit(False))

    def check(m: Mapping) -> str | None:
        return f"{m['rows_after_cutoff']} rows after {cutoff.isoformat()}" if m["rows_after_cutoff"] and not exclude else None

    return Guard("no_leakage", {"rows_after_cutoff": _count(late)}, check, excluded=late if exclude else None)


def report(filled: Column, failed: Column, steady: Column) -> Guard:
    """The cleaning report, measured only: rows filled, rows failed, rows steady (an unknown verdict is steady)."""
    counts = {"rows_filled": _count(filled), "rows_failed": _count(failed), "rows_steady": F.count_if(F.coalesce(steady, F.lit(True)))}
    return Guard("report", counts, lambda m: None)


@dataclass(frozen=True)
class Committed:
    attempt: str
    metrics: dict
    problems: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)


def write_guarded(df: DataFrame, path: str, guards: Sequence[Guard], partition_by: Sequence[str] = ()) -> Committed:
    """Write ``df`` below ``path`` in one pass, judge it by the guards, commit it or raise :class:`BatchRejected`.

    The metrics are observed above all other work and below nothing but the filter of excluded rows, so the plan of
    the write reads its input once, and a task that is run again is counted once. A rejected attempt stays in
    ``path``/data without a commit. Appending is safe with several writers: every attempt and every commit has its own name.
    """
    names = [n for g in guards for n in g.metrics]
    if len(set(names)) != len(names):
        raise ValueError("two guards measure the same name")
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    seen = Observation(f"guards-{attempt}")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows_in"), *[c.alias(n) for g in guards for n, c in g.metrics.items()])
    for g in guards:
        if g.excluded is not None:
            watched = watched.where(~g.excluded)
    out = watched.write.partitionBy(*partition_by) if partition_by else watched.write
    out.parquet(f"{path}/data/attempt={attempt}")
    metrics = dict(seen.get)
    found = [(g, p) for g in guards if (p := g.check(metrics))]
    fatal = [p for g, p in found if g.tag is None]
    if fatal:
        raise BatchRejected(fatal, metrics)
    tags = sorted({g.tag for g, _ in found})
    body = json.dumps({"attempt": attempt, "metrics": metrics, "problems": [p for _, p in found], "tags": tags}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{path}/commits/{attempt}")
    return Committed(attempt, metrics, [p for _, p in found], tags)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``attempt, metrics, problems, tags`` of all committed attempts."""
    text = spark.read.option("recursiveFileLookup", "true").text(f"{path}/commits")
    schema = "attempt string, metrics map<string, bigint>, problems array<string>, tags array<string>"
    return text.select(F.from_json("value", schema).alias("c")).select("c.*")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the committed attempts with their ``batch_tags``; others are not listed. An error if nothing is committed yet."""
    tags = {r.attempt: ",".join(r.tags) for r in commits(spark, path).select("attempt", "tags").collect()}
    frames = [spark.read.parquet(f"{path}/data/attempt={a}").withColumn("batch_tags", F.lit(t)) for a, t in sorted(tags.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_leakage(df: DataFrame, cutoff: datetime, keys: Sequence[str], ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to the cut-off, and per key how many were left out, from when to when. A null time stays."""
    late = F.coalesce(F.col(ts) > naive_literal(cutoff), F.lit(False))
    gone = df.where(late).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_excluded"), F.min(ts).alias("first_excluded"), F.max(ts).alias("last_excluded"))
    return df.where(~late), gone
