"""Near-duplicates: compressed min-hash registers propose pairs, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.common import columns, cut
from plantspark.llm.graph import components
from plantspark.llm.shingles import Words, mix, shingle_set

#: Bits of a register below its leading-zero count (six bits), and probes for an empty register.
MANTISSA = 10
PROBES = 1024
SHINGLE = 5
#: Rows that a task turns into sets at a time.
SLICE_ROWS = 500


@dataclass(frozen=True)
class Banding:
    """``bands`` bands of ``rows`` registers: a pair at similarity s shares none with (1 - s^rows)^bands."""

    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def banding(percent: int) -> Banding:
    """Bands that miss a pair at the limit less than once in 100,000 (85: 9e-7; 80: 3e-6)."""
    return Banding(36, 7) if percent >= 85 else Banding(42, 6)


def _probe_table(m: int) -> np.ndarray:
    seeds = np.arange(PROBES * m, dtype=np.uint64) + np.uint64(1)
    return (mix(seeds) % np.uint64(m)).astype(np.int64).reshape(PROBES, m)


def registers(sets: list[np.ndarray], m: int, probes: np.ndarray) -> np.ndarray:
    """A row of ``m`` 16-bit registers for each non-empty set.

    A code falls into one bucket; the bucket keeps the leading zeros and the next bits of its smallest scrambled
    code. An empty bucket borrows from the first filled one of its own fixed sequence, so registers of small
    sets agree as often as those of large ones.
    """
    sizes = np.array([len(s) for s in sets])
    if not len(sets):
        return np.zeros((0, m), np.uint16)
    code = np.concatenate(sets)
    bucket = ((code >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    least = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(len(sets)) * m, sizes) + bucket.astype(np.int64), mix(code ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    empty = least == np.iinfo(np.uint64).max
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    bits -= (least >> np.clip(bits - 1, 0, 63).astype(np.uint64)) == 0
    bits = np.clip(bits, MANTISSA + 1, 64)
    mantissa = (least >> (bits - 1 - MANTISSA).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    reg = (((64 - bits).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).reshape(-1, m)
    filled = ~empty.reshape(-1, m)
    out = reg.copy()
    row, at = np.nonzero(~filled)
    for probe in probes:
        if not len(row):
            break
        source = probe[at]
        ok = filled[row, source]
        out[row[ok], at[ok]] = reg[row[ok], source[ok]]
        row, at = row[~ok], at[~ok]
    for r, a in zip(row.tolist(), at.tolist(), strict=True):  # hardly ever: the next filled bucket around
        out[r, a] = np.roll(reg[r], -a)[np.argmax(np.roll(filled[r], -a))]
    return out


def signatures(docs: DataFrame, band: Banding, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_shingles, cls, regs``: a 128-bit hash of the sorted set and the registers (null without words)."""
    d = columns(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table(band.registers)
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, len(b), SLICE_ROWS)):
            words = Words()
            sets = [shingle_set(words.codes(t.as_py()), shingle) for t in batch.column("text")]
            regs = iter(registers([s for s in sets if len(s)], band.registers, probes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "cls", "regs"],
            )

    schema = T.StructType(
        [d.schema["doc_id"], d.schema["text_hash"], T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("regs", T.BinaryType())]
    )
    return d.mapInArrow(scan, schema)


def sets_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``cls, codes``: the full shingle set of every row that has one."""
    d = columns(docs, "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), SLICE_ROWS):
                words = Words()
                sets = [s for t in batch.column("text").slice(start, SLICE_ROWS) if len(s := shingle_set(words.codes(t.as_py()), shingle))]
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                ends = np.cumsum([0, *(len(s) for s in sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    names=["cls", "codes"],
                )

    return d.mapInArrow(scan, "cls binary, codes array<bigint>")


def _size_fits(percent: int) -> Column:
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def expected_collisions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets agree, at ``x`` and ``y`` codes a bucket: both minima in one cell."""
    total = np.zeros(len(x))
    z = x + y
    for i in range(64):
        cell = 2.0 ** -(i + 1 + MANTISSA)
        total += cell * x * y / z * (np.exp(-z * 2.0 ** -(i + 1)) - np.exp(-z * 2.0**-i))
    return np.minimum(total, 0.5)


def estimated(pairs: DataFrame, band: Banding, percent: int) -> DataFrame:
    """The pairs whose estimated similarity leaves the limit possible: within six standard errors below it."""
    m = band.registers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("ra", "rb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            c = expected_collisions(na / m, nb / m)
            estimate = ((a == b).mean(axis=1) - c) / (1 - c)
            limit = percent / 100
            error = np.sqrt(limit * (1 - limit) / np.minimum(m, np.minimum(na, nb)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(estimate >= limit - 6 * error))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(scan, "a binary, b binary")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, band: Banding, percent: int) -> DataFrame:
    """Pairs ``a, b`` (classes) whose full sets are similar enough."""
    side = {s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}")) for s in "ab"}
    near = estimated(pairs.join(side["a"], "a").join(side["b"], "b").where(_size_fits(percent)), band, percent)
    full = {s: sets.select(F.col("cls").alias(s), F.col("codes").alias(f"codes_{s}")) for s in "ab"}
    both = near.join(full["a"], "a").join(full["b"], "b")
    same = F.size(F.array_intersect("codes_a", "codes_b"))
    return both.select("a", "b", same.alias("same"), (F.size("codes_a") + F.size("codes_b")).alias("sum")).where(
        F.lit(100) * F.col("same") >= F.lit(percent) * (F.col("sum") - F.col("same"))
    ).select("a", "b")


#: Members of a hub that one task compares side by side; a hub with more goes through joins.
HUB_ROWS = 10_000
#: Codes that more members of a hub than this have beyond it count as part of what the hub stands for.
COMMON = 32


def members_of_open_hubs(star: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """``hub, cls, root, stray, n, width, extra, lack, members``: the members of hubs that have a stray, a member outside
    the hub's component, each by the codes it has beyond the hub's and the ones it lacks."""
    root = F.coalesce("root", F.col("node"))
    at = roots.select(F.col("node").alias("m"), "root")
    placed = star.join(at.withColumnRenamed("root", "root_m"), star["cls"] == F.col("m"), "left").select("hub", "cls", F.coalesce("root_m", "cls").alias("root"))
    hubs = star.select("hub").distinct().withColumnRenamed("hub", "node").join(roots, "node", "left").select(F.col("node").alias("hub"), root.alias("hub_root"))
    placed = placed.join(hubs, "hub").withColumn("stray", F.col("root") != F.col("hub_root"))
    unfinished = placed.where("stray").select("hub").distinct()
    placed = placed.join(unfinished, "hub", "left_semi")
    both = placed.join(sets.select(F.col("cls").alias("hub"), F.col("codes").alias("core")), "hub").join(sets, "cls")
    members = both.select(
        "hub", "cls", "root", "stray", F.size("codes").alias("n"), F.size("core").alias("width"),
        F.array_except("codes", "core").alias("extra"), F.array_except("core", "codes").alias("lack"),
    )
    return cut(members.join(placed.groupBy("hub").agg(F.count("*").alias("members")), "hub"))


def links_within(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: enough of the links between members of one hub to join what links join, for hubs of a task's size.

    Members have in common the hub's codes without what either lacks, and what both have beyond; a stray's counts of
    shared codes with all members come from the lists of who has which, so similarities are exact and only links that
    join two components leave the task.
    """

    def solve(group: pa.Table) -> pa.Table:
        m = len(group)
        n, width = group["n"].to_numpy(), group["width"][0].as_py()
        lists = {c: group[c].combine_chunks() for c in ("lack", "extra")}
        counts = {c: np.diff(x.offsets.to_numpy()) for c, x in lists.items()}
        have = width - counts["lack"]
        who, code = [], []
        for c, x in lists.items():
            values = x.flatten().to_numpy()
            own, at, times = np.unique(values, return_inverse=True, return_counts=True)
            twice = times[at] > 1
            who.append(np.repeat(np.arange(m), counts[c])[twice])
            code.append(at[twice] + (sum(map(len, code)) and code[0].max() + 1))
        who, code = np.concatenate(who), np.concatenate(code)
        by_code = np.argsort(code, kind="stable")
        listed, start = who[by_code], np.searchsorted(code[by_code], np.arange(code.max() + 2 if len(code) else 1))
        by_who = np.argsort(who, kind="stable")
        mine, first = code[by_who], np.searchsorted(who[by_who], np.arange(m + 1))
        _, part = np.unique(np.array([r for r in group["root"].to_pylist()], dtype=object), return_inverse=True)
        links = []
        for i in np.flatnonzero(group["stray"].to_numpy()):
            lists_of = [listed[start[k] : start[k + 1]] for k in mine[first[i] : first[i + 1]]]
            shared = np.bincount(np.concatenate(lists_of), minlength=m) if lists_of else np.zeros(m, int)
            common = have[i] + have - width + shared
            near = np.flatnonzero((100 * common >= percent * (n[i] + n - common)) & (part != part[i]))
            for j in near:
                if part[j] != part[i]:
                    links.append((int(i), int(j)))
                    part[part == part[j]] = part[i]
        a, b = zip(*links, strict=True) if links else ((), ())
        cls = group["cls"]
        return pa.table({"a": cls.take(pa.array(a, pa.int64())), "b": cls.take(pa.array(b, pa.int64()))})

    return members.groupBy("hub").applyInArrow(solve, "a binary, b binary")


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of members of one hub in different components that may still be similar enough, for hubs of any size.

    A member is described against its hub's codes and those that many members have (together the core): the codes
    it lacks, and the few it has beyond. Two members have at most the core codes of the poorer one in common, and beyond
    the core only codes that occur twice. If they share neither a lacking code nor such a one, their common part is
    exactly the core without both lacks. Pairs that these limits leave possible come out of joins on hub and code;
    one side is always a stray, a member outside the hub's component, so finished groups cost nothing.
    """

    def enough(common: str) -> str:
        return f"{100 + percent} * ({common}) >= {percent} * (na + nb) AND ra <> rb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)"

    beyond = members.select("hub", "cls", F.explode("extra").alias("code"))
    counts = beyond.groupBy("hub", "code").agg(F.count("*").alias("having")).where("having > 1")
    common = counts.where(F.col("having") > COMMON).groupBy("hub").agg(F.collect_set("code").alias("common"))
    twice = beyond.join(counts.where(F.col("having") <= COMMON).drop("having"), ["hub", "code"]).groupBy("hub", "cls").agg(F.collect_list("code").alias("twice"))
    none = F.array().cast("array<bigint>")
    m = members.join(common, "hub", "left").join(twice, ["hub", "cls"], "left").withColumns({"common": F.coalesce("common", none), "twice": F.coalesce("twice", none)})
    m = m.select("hub", "cls", "root", "stray", "n", (F.col("width") + F.size("common")).alias("width"), F.concat("lack", F.array_except("common", "extra")).alias("lack"), "twice")
    m = m.withColumns({"have": F.col("width") - F.size("lack"), "shared": F.size("twice")})
    m = cut(m.where(f"100 * (have + shared) >= {percent} * n"))

    def side(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select("hub", F.col("cls").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("have").alias(f"h{s}"), F.col("shared").alias(f"s{s}"), *more)

    strays = m.where("stray")
    codes = F.explode(F.concat("twice", "lack")).alias("code")
    by_code = side(strays, "a", codes).join(side(m, "b", codes), ["hub", "code"]).where(enough("least(ha, hb) + least(sa, sb)"))
    # Apart everywhere: only members that lack little can be that near.
    near = m.where(f"{100 + percent} * have >= {percent} * (n + {percent} * n / 100)")
    apart = side(near.where("stray"), "a", "width").join(side(near, "b"), "hub").where(enough("ha + hb - width"))
    pairs = by_code.select("a", "b").unionAll(apart.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for every row of ``docs``.

    Rows with the same set are one class. Classes that share a band are compared: first each with the hub of the
    band, its most typical class (whose bands are fullest), then those that are still apart after joining the confirmed
    pairs, within each hub. Pairs that the registers leave possible are confirmed on their full sets
    (100 * common >= ``percent`` * all). ``component_id`` is the smallest ``doc_id`` that links reach, and
    that document is kept. Null and texts without words are linked with nothing; a null ``doc_id`` is never a
    component's name unless all of it is null; rows with the same ``doc_id`` and text share their result.
    Further columns are ignored.
    """
    band = banding(percent)
    d = columns(docs, "doc_id", "text")
    signed = cut(signatures(d, band, shingle))
    classes = signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("regs").alias("regs"))
    classes = cut(classes)
    width = 2 * band.rows
    part = F.sequence(F.lit(0), F.lit(band.bands - 1))
    rows = classes.select("cls", "n", "regs", F.explode(part).alias("k")).select(
        F.xxhash64("k", F.substring("regs", F.col("k") * width + 1, F.lit(width))).alias("key"), "cls", "n"
    )
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = cut(rows.join(shared, "key"))
    typical = rows.groupBy("cls").agg(F.sum("members").alias("typical"))
    leaders = rows.join(typical, "cls").groupBy("key").agg(F.max_by("cls", F.struct("typical", "cls")).alias("a"))
    star = cut(rows.join(leaders, "key").where("cls <> a").select(F.col("a").alias("hub"), "cls").distinct())
    pairs = star.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
    wanted = rows.select("cls").distinct().join(classes, "cls").select("id").distinct()
    texts = d.join(wanted, d["doc_id"].eqNullSafe(wanted["id"]), "left_semi")
    sets = sets_of(texts, shingle).join(rows.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    sets = cut(sets)
    links = cut(confirmed(pairs, classes, sets, band, percent))
    joined = components(links)
    members = members_of_open_hubs(star, joined, sets)
    large = members.where(F.col("members") > HUB_ROWS)
    more = links_within(members.where(F.col("members") <= HUB_ROWS), percent)
    if large.take(1):
        rest = cross_pairs(large.drop("members"), percent).join(pairs, ["a", "b"], "left_anti")
        more = more.unionAll(confirmed(rest, classes, sets, band, percent))
    more = cut(more)
    roots = components(links.unionAll(more)) if more.take(1) else joined
    named = classes.select("cls", "id").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = named.join(names, "root").select("cls", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with all its columns, one document of each group of near-duplicates; of repeated rows one stays, too."""
    found = near_duplicates(docs, percent, shingle).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("_llm_kept"), F.count("*").alias("_llm_rows"))
    found = found.withColumnsRenamed({"doc_id": "_llm_doc", "text_hash": "_llm_text"})
    same = F.col("doc_id").eqNullSafe(F.col("_llm_doc")) & (F.xxhash64("text") == F.col("_llm_text"))
    kept = docs.join(found, same).where("_llm_kept")
    once = kept.where("_llm_rows = 1").select(docs.columns)
    return once.unionAll(kept.where("_llm_rows > 1").dropDuplicates(["doc_id", "text"]).select(docs.columns))
