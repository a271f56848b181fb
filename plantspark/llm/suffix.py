"""Repeated strings of a corpus: sampled suffixes sorted externally, all others induced with their common prefixes.

A suffix array over all bytes is only needed where something repeats. Each run of ``WIDTH`` bytes holds one sampled
position, chosen by the bytes of the run alone (its smallest hashed string of ``SEED`` bytes), so equal runs
have their samples at the same place. Equal surroundings of samples are counted as one; those that share the seed but
differ around it are what is sorted: the engine's external sort, which spills, orders the sampled suffixes, and from
their order and common prefixes those of the positions before them are induced byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.chunks import CHUNK_BYTES, cuts_of, pack, restore, squeeze, total_bytes, unpack
from plantspark.llm.common import columns, cut
from plantspark.llm.shingles import mix

WIDTH = 400
SEED = 64
#: Bytes hashed at a time within a task, and surroundings that are sorted in one step at least.
SLICE = 1 << 19
STEP_ROWS = 8192
#: Surroundings of one seed that a task may hold; a seed with more has its runs compared by hash, row by row.
GROUP_ROWS = 50_000
_APART = np.int16(-10_000)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``SEED`` bytes at each position, by doubling."""
    h, n = _TABLE[data], 1
    while n < SEED:
        h = h[: max(0, len(h) - n)] * _ODD + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h * _ODD


def samples(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ``width`` bytes of ``data``, by its start: the sampled position; and all positions' hashes."""
    h = _seed_hashes(data)
    span = width - SEED + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), h, h
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    block = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(block, axis=1).reshape(-1)
    least = np.minimum(ahead[:n], behind[span - 1 : span - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), h, key


def surroundings(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, int, int, int, int]]:
    """``row, first, last, position, seed hash``: runs starting from first to last (both included) have this sample."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
        lengths = np.array([len(t) for t in texts[start:end]])
        offsets = np.cumsum(lengths) - lengths
        at, h, _ = samples(data, width)
        if len(at):
            # A run must end within its text.
            row = np.repeat(np.arange(end - start), np.maximum(lengths - width + 1, 0))
            inside = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(lengths - width + 1, 0)) - np.maximum(lengths - width + 1, 0), np.maximum(lengths - width + 1, 0))
            runs = offsets[row] + inside
            position = at[runs]
            new = np.flatnonzero(np.r_[True, (position[1:] != position[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, int)
            last = np.r_[new[1:], len(row)] - 1
            for r, a, b, p, seed in zip(
                (row[new] + start).tolist(), inside[new].tolist(), inside[last].tolist(), (position[new] - offsets[row[new]]).tolist(), h[position[new]].view(np.int64).tolist(), strict=True
            ):
                yield r, a, b, p, seed
        start = end


def _texts(body: bytes) -> list[bytes]:
    return [(t or "").encode() for t in unpack(body)["text"].to_pylist()]


class Samples:
    """The samples of a chunk, its distinct surroundings by 128-bit hash and its distinct seeds, both sorted."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        found = list(surroundings(texts, width))
        self.places = [x[:4] for x in found]
        digests = b"".join(xxhash.xxh3_128_digest(texts[r][a : b + width], p - a) for r, a, b, p, _ in found)
        around = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        order = np.lexsort((around[:, 1], around[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (around[order[1:]] != around[order[:-1]]).any(axis=1)
        self.first = order[new]  # the first place of each surrounding (the sort is stable)
        self.around = around[self.first]
        self.kind = np.empty(len(order), np.int64)  # of each sample, its surrounding
        self.kind[order] = np.cumsum(new) - 1
        self.times = np.bincount(self.kind, minlength=len(self.first))
        seeds = np.array([x[4] for x in found], np.int64).view(np.uint64)[self.first]
        self.seeds, self.seed = np.unique(seeds, return_inverse=True)  # of each surrounding, its seed


REQUEST = "chunk long, part int, kind int, n long, codes binary, one binary, two binary"


def requests(chunks: DataFrame, parts: int, width: int) -> DataFrame:
    """What each chunk asks about: its surroundings with their number (kind 0), its seeds with the least and
    greatest surrounding of each (kind 1), in ranges of the hash. However common, each comes once from a chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                s = Samples(_texts(body), width)
                if not len(s.first):
                    continue
                by_seed = np.argsort(s.seed, kind="stable")
                starts = np.searchsorted(s.seed[by_seed], np.arange(len(s.seeds)))
                low, high = (f.reduceat(s.around[by_seed, 0], starts) for f in (np.minimum, np.maximum))
                out = []
                for kind, codes, one, two in ((0, s.around[:, 0], s.around[:, 1], np.minimum(s.times, 2).astype(np.uint8)), (1, s.seeds, low, high)):
                    cuts = cuts_of(codes, parts)
                    for part in np.flatnonzero(np.diff(cuts)):
                        a, b = cuts[part], cuts[part + 1]
                        steps = np.diff(codes[a:b], prepend=np.uint64(0))
                        out.append((chunk, int(part), kind, int(b - a), *map(squeeze, (steps, one[a:b], two[a:b]))))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "part", "kind", "n", "codes", "one", "two"])

    return chunks.mapInArrow(scan, REQUEST)


TWICE, CHOSEN = 1, 2


def answers(asked: DataFrame) -> DataFrame:
    """``chunk, part, kind, n, flags`` in the order asked. Surroundings: occurs twice, and one chunk is chosen to show it.
    Seeds: have several surroundings. A range of hashes is a group of about a chunk's size."""

    def decide(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        kind = rows[0]["kind"]
        codes = np.concatenate([np.cumsum(restore(r["codes"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
        one = np.concatenate([restore(r["one"], r["n"], np.uint64) for r in rows])
        two = np.concatenate([restore(r["two"], r["n"], np.uint64 if kind else np.uint8) for r in rows])
        order = np.argsort(codes, kind="stable") if kind else np.lexsort((one, codes))
        new = np.ones(len(order), bool)
        new[1:] = codes[order[1:]] != codes[order[:-1]]
        if kind == 0:
            new[1:] |= one[order[1:]] != one[order[:-1]]
        starts = np.flatnonzero(new)
        if kind == 0:
            many = np.add.reduceat(two[order].astype(np.int64), starts) > 1
        else:
            many = np.minimum.reduceat(one[order], starts) != np.maximum.reduceat(two[order], starts)
        flags = np.empty(len(order), np.uint8)
        flags[order] = many[np.cumsum(new) - 1] * TWICE + new * CHOSEN
        ends = np.cumsum([0, *(r["n"] for r in rows)])
        named = {c: pa.array([r[c] for r in rows], t) for c, t in (("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()))}
        return pa.table(named | {"flags": pa.array([squeeze(flags[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})

    return asked.groupBy("part", "kind").applyInArrow(decide, "chunk long, part int, kind int, n long, flags binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


FOUND = "chunk long, row int, start int, end int, seed long, before binary, after binary"
_FOUND = pa.schema([("chunk", pa.int64()), *((c, pa.int32()) for c in ("row", "start", "end")), ("seed", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])


def known_and_open(chunks: DataFrame, replies: DataFrame, width: int) -> DataFrame:
    """Spans that surroundings occurring twice cover (``before`` is null), and one row of bytes for each surrounding
    whose seed has others, with ``start`` the sample's position and ``end`` whether it occurs once (1) or is covered (0)."""

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        replied = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["part"]))
        flags = [np.concatenate([restore(r["flags"], r["n"], np.uint8) for r in replied if r["kind"] == k] or [np.zeros(0, np.uint8)]) for k in (0, 1)]
        for chunk, body in zip(left["chunk"].to_pylist(), left["body"].to_pylist(), strict=True):
            texts = _texts(body)
            s = Samples(texts, width)
            twice = (flags[0] & TWICE) > 0
            covered: dict[int, list[tuple[int, int]]] = {}
            for i in np.flatnonzero(twice[s.kind]).tolist() if len(s.kind) else ():
                r, a, b, _ = s.places[i]
                covered.setdefault(r, []).append((a, b + width))
            rows += [(chunk, r, a, b, None, None, None) for r, own in covered.items() for a, b in merged(own)]
            for k in np.flatnonzero(((flags[0] & CHOSEN) > 0) & ((flags[1][s.seed] & TWICE) > 0)).tolist() if len(s.kind) else ():
                r, a, b, p = s.places[s.first[k]]
                seed = int(s.seeds[s.seed[k]].astype(np.int64))
                rows.append((chunk, r, p, int(not twice[k]), seed, texts[r][a:p], texts[r][p : b + width]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, _FOUND.types, strict=True)], schema=_FOUND)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(split, FOUND)


# ------------------------------------------------------------------ induction


def _range_least(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``x[low..high]`` for each pair of bounds, both included, by doubling."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.minimum(x[low], x[high])
    table, n = x, 1
    for k in range(1, int(level.max(initial=0)) + 1):
        table = np.minimum(table[: len(table) - n], table[n:])
        n *= 2
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - n + 1])
    return out


def induce(seed: np.ndarray, data: list[bytes], back: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each surrounding and number t of bytes before the sample: whether the run that starts there occurs twice.

    The surroundings come sorted by seed, then by the bytes from the sample on. ``back`` is where in its
    data the sample is. Going back byte by byte, the order of the longer suffixes follows from the byte and the order of the
    shorter ones, and their common prefixes from the least common prefix in between; a run occurs twice if it has
    ``width`` bytes in common with a neighbour.
    """
    n = len(data)
    length = np.array([len(d) for d in data])
    first_t = back - (length - width)  # runs that start fewer bytes before aren't this sample's
    most = int(back.max())
    right = np.zeros((n, width), np.uint8)
    left = np.zeros((n, most + 1), np.uint8)
    for i, (d, b) in enumerate(zip(data, back.tolist(), strict=True)):
        right[i, : len(d) - b] = np.frombuffer(d, np.uint8, offset=b)
        left[i, 1 : b + 1] = np.frombuffer(d, np.uint8, count=b)[::-1]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(length[1:] - back[1:], length[:-1] - back[:-1]))
    prefix = np.full(n, _APART, np.int16)
    prefix[1:] = np.where(seed[1:] == seed[:-1], common, _APART)
    group = np.cumsum(np.r_[False, seed[1:] != seed[:-1]]).astype(np.int64)
    twice = np.zeros((n, most + 1), bool)
    order = np.arange(n)
    for t in range(most + 1):
        if t:
            live = np.flatnonzero(back[order] >= t)
            if len(live) < len(order):
                prefix = np.minimum.reduceat(prefix[: live[-1] + 1], np.r_[0, live[:-1] + 1])
                order = order[live]
            key = group[order] * 256 + left[order, t]
            step = np.argsort(key, kind="stable")
            key = key[step]
            low, high = np.minimum(step[:-1], step[1:]) + 1, np.maximum(step[:-1], step[1:])
            least = _range_least(prefix, low, high) + np.int16(1) if len(step) > 1 else np.zeros(0, np.int16)
            prefix = np.r_[_APART, np.where(key[1:] == key[:-1], least, _APART)].astype(np.int16)
            order = order[step]
        equal = prefix >= width
        equal[:-1] |= equal[1:].copy()
        twice[order, t] = equal & (first_t[order] <= t)
    return twice


SPAN = "chunk long, row int, start int, end int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.int32()] * 3, strict=True)], names=["chunk", "row", "start", "end"])


def induced_spans(open_rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Spans of runs that occur twice, from surroundings sorted by seed and suffix; whole seeds are taken together."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[dict]) -> pa.RecordBatch:
            back = np.array([len(r["before"]) for r in rows])
            twice = induce(np.array([r["seed"] for r in rows]), [r["before"] + r["after"] for r in rows], back, width)
            out = []
            for i in np.flatnonzero(twice.any(axis=1)):
                r = rows[i]
                if not r["end"]:  # covered as it is
                    continue
                edge = np.flatnonzero(np.diff(np.r_[0, twice[i].astype(np.int8), 0]))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    out.append((r["chunk"], r["row"], r["start"] - (b - 1), r["start"] - a + width))
            return _spans(out)

        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= STEP_ROWS and r["seed"] != held[-1]["seed"]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    keyed = open_rows.repartition("seed").sortWithinPartitions("seed", "after")
    return keyed.mapInArrow(scan, SPAN)


def hashed_spans(open_rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same for seeds with too many surroundings for one task: runs are counted by hash, each a row of its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = r["before"] + r["after"]
                start = r["start"] - len(r["before"])
                runs = range(len(data) - width + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["chunk"]] * len(runs), pa.int64()),
                        pa.array([r["row"]] * len(runs), pa.int32()),
                        pa.array([start + i for i in runs], pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(data[i : i + width]) for i in runs], pa.binary()),
                    ],
                    names=["chunk", "row", "start", "run"],
                )

    runs = open_rows.mapInArrow(scan, "chunk long, row int, start int, run binary")
    twice = runs.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    return runs.join(twice, "run").select("chunk", "row", "start", (F.col("start") + width).cast("int").alias("end"))


# ------------------------------------------------------------------ the operator


def repeated_spans(chunks: DataFrame, parts: int, width: int = WIDTH) -> DataFrame:
    """``chunk, row, start, end`` of byte ranges that only runs occurring twice cover; ranges may overlap."""
    replies = cut(answers(requests(chunks, parts, width)))
    found = cut(known_and_open(chunks, replies, width))
    whole = found.where("before IS NULL").select("chunk", "row", "start", "end")
    rows = found.where("before IS NOT NULL")
    hot = rows.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("seed", F.lit(True).alias("hot"))
    rows = rows.join(hot, "seed", "left")
    small, large = rows.where("hot IS NULL").drop("hot"), rows.where("hot").drop("hot")
    return whole.unionAll(induced_spans(small, width)).unionAll(hashed_spans(large, width))


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row of ``docs``.

    Each byte of the UTF-8 text is removed that a run of ``width`` bytes covers which also starts anywhere else, in this
    row or another (runs may overlap; all are judged on the input). ``spans`` are the removed ranges, longest
    possible, end exclusive; ``kept`` is what remains as binary. Null and empty texts are empty; rows alike repeat
    each other; identifiers are carried, further columns ignored.
    """
    if width < SEED:
        raise ValueError(f"width must be {SEED} at least")
    own = columns(docs, "doc_id", "text")
    chunks = cut(pack(own))
    spans = repeated_spans(chunks, max(1, -(-total_bytes(own) // CHUNK_BYTES)), width)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        by_row: dict[int, list[tuple[int, int]]] = {}
        for row, a, b in zip(right["row"].to_pylist(), right["start"].to_pylist(), right["end"].to_pylist(), strict=True):
            by_row.setdefault(row, []).append((a, b))
        out = []
        for body in left["body"].to_pylist():
            rows = unpack(body)
            texts = [(t or "").encode() for t in rows["text"].to_pylist()]
            gone, kept = [], []
            for i, text in enumerate(texts):
                removed = merged(by_row.get(i, []))
                gone.append([{"start": a, "end": b} for a, b in removed])
                ends = [0, *(x for span in removed for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            out.append(
                pa.table(
                    {
                        "doc_id": rows["doc_id"],
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "n_removed": pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                        "spans": pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        "kept": pa.array(kept, pa.binary()),
                    }
                )
            )
        return pa.concat_tables(out)  # each chunk of spans has its body

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(remove, schema)
