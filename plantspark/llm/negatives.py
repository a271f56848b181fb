"""Hard-negative mining: Hilbert-ordered blocks of vectors in Parquet, chosen by the bounds of their zone maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantspark.llm.common import columns, stored

#: Rows of a block, anchors of a pack, zone maps of a page.
BLOCK, PACK, PAGE = 1024, 128, 256
#: Windows of anchors whose best scores a task remembers, so as not to send on what cannot be among the first.
SENT = 100_000
#: Bits of a dimension in the Hilbert index.
BITS = 2
#: Components must stay below this after scaling, so that any score fits 64 bits (up to 8,192 dimensions).
MOST = 1 << 25
UNKNOWN = np.iinfo(np.int64).min

#: A block: its zone map (labels with their counts, least and most of each dimension) and its rows, as bytes of whole numbers.
ZONE = ["label_of", "label_n", "lo", "hi"]
ROWS = ["ids", "labels", "anchors", "vectors"]
BLOCK_SCHEMA = ", ".join(["block_id long", *(f"{c} binary" for c in ZONE + ROWS)])
PACK_SCHEMA = "pack_id long, ids binary, labels binary, vectors binary, least binary"


# ------------------------------------------------------------------ order


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of ``cells`` (whole numbers below 2 to ``bits``) on the Hilbert curve, as bytes in its order.

    Axes are turned to the transposed index by rotating and reflecting from the highest bit down, all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(high, p, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = [(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def _valid(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """``vec_id, label, is_anchor, x``: rows that take part, their components scaled to whole numbers."""
    own = columns(vectors, "vec_id", "embedding", "label")
    scaled = F.transform("embedding", lambda c: F.floor(256 * c.cast("double")).cast("int"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < MOST // 256))
    return own.where(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        "vec_id", label.cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), scaled.alias("x")
    )


def _spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and standard deviation of each dimension (as many numbers as dimensions, nothing else, reach the driver)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            dims = max(np.diff(lists.offsets.to_numpy()), default=0)
            x = _padded(lists, dims).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims + 1), pa.int32()), pa.array(np.full(dims + 1, len(x)), pa.int64()), pa.array(np.append(x.sum(0), 0.0)), pa.array(np.append((x * x).sum(0), 0.0))],
                names=["dim", "n", "s", "ss"],
            )

    parts = rows.select("x").mapInArrow(scan, "dim int, n long, s double, ss double")
    found = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).orderBy("dim").collect()
    if not found:
        return None
    total = max(r["n"] for r in found)
    own = found[:-1] or found
    mean = np.array([r["s"] / total for r in own])
    return mean, np.sqrt(np.maximum(np.array([r["ss"] / total for r in own]) - mean**2, 0)) + 1e-9


def _keyed(rows: DataFrame, middle: np.ndarray, spread: np.ndarray) -> DataFrame:
    """``rows`` as bytes, with the Hilbert key of their cell in a grid of two standard deviations around the mean."""
    dims, cells = len(middle), 1 << BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column("x"), dims)
            at = np.clip(((x - middle) / spread + 2) * (cells / 4), 0, cells - 1).astype(np.uint32)
            keys, vectors = pa.array(hilbert_keys(at), pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "is_anchor")), keys, vectors], names=["vec_id", "label", "is_anchor", "key", "vector"])

    return rows.mapInArrow(scan, "vec_id long, label int, is_anchor boolean, key binary, vector binary")


def _padded(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` whole numbers; shorter lists end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int32)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _binary(schema: list[str], first: int, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], names=schema)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _blocks(keyed: DataFrame, dims: int) -> DataFrame:
    """Runs of ``BLOCK`` rows along the curve, one row each with its zone map. Rows that repeat wholly lie side by side: one stays."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        last = None

        def block() -> pa.RecordBatch:
            ids, labels, anchors = (np.array([r[i] for r in held], kind) for i, kind in enumerate((np.int64, np.int32, np.uint8)))
            x = np.frombuffer(b"".join(r[3] for r in held), np.int32).reshape(len(held), dims)
            of, n = np.unique(labels, return_counts=True)
            zone = [of.astype(np.int32), n.astype(np.int32), x.min(0), x.max(0)]
            return _binary(_names(BLOCK_SCHEMA), first + seq, [v.tobytes() for v in (*zone, ids, labels, anchors, x)])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "is_anchor", "vector")), strict=True):
                if row == last:
                    continue
                last = row
                held.append(row)
                if len(held) == BLOCK:
                    yield block()
                    held, seq = [], seq + 1
        if held:
            yield block()

    ordered = keyed.repartitionByRange("key", "vec_id", "label", "vector").sortWithinPartitions("key", "vec_id", "label", "vector")
    return ordered.select("vec_id", "label", "is_anchor", "vector").mapInArrow(scan, BLOCK_SCHEMA)


# ------------------------------------------------------------------ scores and bounds


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of ``a`` and ``b``; by floating point where that is exact."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that a row of ``a`` can score with anything between ``lo`` and ``hi`` (anchors by blocks), rounded outwards."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    lo, hi = lo.T.astype(np.float64), hi.T.astype(np.float64)
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    return least - 1 - 1e-9 * np.abs(least), most + 1 + 1e-9 * np.abs(most)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller identifier."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _rows(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["labels"], np.int32), np.frombuffer(row["vectors"], np.int32).reshape(len(ids), dims)


def _still_first(sent: dict, key: tuple, score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, those that ``k`` better ones that this task has sent on for ``key`` do not rule out."""
    least = sent.get(key)
    if least is not None and len(least) == k:
        at = at[score[at] >= least[0]]
    return at


def _note(sent: dict, key: tuple, scores: np.ndarray, k: int) -> None:
    sent[key] = np.sort(np.concatenate([sent.get(key, scores[:0]), scores]))[-k:]


def _packs(blocks: DataFrame, dims: int, positives: int) -> DataFrame:
    """Anchors in packs of neighbours along the curve, each with a score that its last positive reaches at least.

    That is the score of the last one among the anchor's own block; without enough of them it is unknown.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def pack() -> pa.RecordBatch:
            return _binary(_names(PACK_SCHEMA), first + seq, [np.concatenate([p[i] for p in held]).tobytes() for i in range(4)])

        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = _rows(row, dims)
                at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
                for some in np.split(at, range(PACK, len(at), PACK)) if len(at) else ():
                    score, least = _scores(x[some], x), np.full(len(some), UNKNOWN)
                    for i, j in enumerate(some):
                        own = score[i][(labels == labels[j]) & (ids != ids[j])]
                        if len(own) >= positives:
                            least[i] = np.partition(own, len(own) - positives)[len(own) - positives]
                    if size + len(some) > PACK:
                        yield pack()
                        seq, held, size = seq + 1, [], 0
                    held.append((ids[some], labels[some], x[some].reshape(-1), least))
                    size += len(some)
        if held:
            yield pack()

    return blocks.select(*ROWS).mapInArrow(scan, PACK_SCHEMA)


# ------------------------------------------------------------------ choosing and reading blocks

#: Of a pack and the zone maps of some blocks: anchors by blocks, true where the anchor must read the block.
Choice = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _needed(packs: DataFrame, pages: DataFrame, n_pages: int, dims: int, choose: Choice) -> DataFrame:
    """``pack_id, block_id``: blocks that some anchor of the pack must read.

    Every pack meets every page of zone maps (not the blocks themselves), as each anchor is asked against all rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims)
                labels, zones = np.frombuffer(row["labels"], np.int32), row["zones"]
                lo, hi = (np.frombuffer(b"".join(z[c] for z in zones), np.int32).reshape(-1, dims) for c in ("lo", "hi"))
                least, most = _bounds(a, lo, hi)
                own, every = np.zeros(least.shape, np.int64), np.zeros(len(zones), np.int64)
                for i, z in enumerate(zones):
                    of, n = np.frombuffer(z["label_of"], np.int32), np.frombuffer(z["label_n"], np.int32)
                    at = np.minimum(np.searchsorted(of, labels), len(of) - 1)
                    own[:, i], every[i] = np.where(of[at] == labels, n[at], 0), n.sum()
                ids = np.array([z["block_id"] for z in zones], np.int64)[choose(row, least, most, own, every).any(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["pack_id"]), pa.int64()), pa.array(ids)], names=["pack_id", "block_id"])

    spread = packs.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
    return spread.join(pages, "page").drop("page").mapInArrow(scan, "pack_id long, block_id long")


def _read(needed: DataFrame, packs: DataFrame, blocks: DataFrame, dims: int, pick: Callable, schema: str) -> DataFrame:
    """What ``pick`` finds in the scores of each pack with each of its blocks; a task holds one pack and one block at a time."""
    names = _names(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict = {}
        for batch in batches:
            for i in range(len(batch)):
                if len(sent) > SENT:
                    sent.clear()
                row = batch.slice(i, 1).to_pylist()[0]
                ids, labels, x = _rows({c: row[f"block_{c}"] for c in ROWS}, dims)
                a = np.frombuffer(row["vectors"], np.int32).reshape(-1, dims)
                found = pick(row, _scores(a, x), ids, labels, sent)
                if found:
                    arrays = [np.concatenate(v) for v in zip(*found, strict=True)]
                    packed = [np.full(len(arrays[0]), row["pack_id"]), *arrays]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in packed], names=names)

    payload = blocks.select("block_id", *[F.col(c).alias(f"block_{c}") for c in ROWS])
    return needed.join(packs, "pack_id").join(payload, "block_id").mapInArrow(scan, schema)


def _ranked(found: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; ``label`` and ``is_anchor`` are expressions over them. Components count as
    floor(256 x), scores are whole inner products, higher first, ties by smaller ``vec_id``. An anchor's positives are its
    first ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels come whose score
    lies within the two percentages of the positive's, both included.

    Rows are ordered along a Hilbert curve, split by range, and written to the shared folder as Parquet blocks of 1,024
    with the least and most of each dimension. Anchors travel in packs of at most 128. Interval arithmetic over the zone
    maps bounds an anchor's scores in a block; blocks that cannot hold one of its positives, then those that meet no
    window of its positives, are not read for it. The order and the zone maps decide only how much is read: on
    vectors without any clusters, most blocks are. No task holds more than some 64 MB of packs and blocks.

    Rows with a null identifier, label or vector take no part, nor those with a null, non-finite or huge component (131,072
    or more: scores would leave 64 bits). Shorter vectors count as ending in zeros, an empty one as all zeros. Rows that
    repeat wholly count once; rows that share an identifier but differ are rows of their own, and none of them is "other"
    to an anchor of that identifier. An anchor without a positive, or a positive without a negative, has no row; with
    fewer than asked, all come. An empty table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, label, is_anchor)
    grid = _spread(rows)
    if grid is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = len(grid[0])
    blocks = stored(spark, _blocks(_keyed(rows, *grid), dims), "blocks")
    packs = stored(spark, _packs(blocks, dims, positives), "packs")
    n_pages = -(-blocks.count() // PAGE)
    zones = blocks.select(F.expr(f"cast(pmod(xxhash64(block_id), {n_pages}) AS int)").alias("page"), F.struct("block_id", *ZONE).alias("zone"))
    pages = stored(spark, zones.groupBy("page").agg(F.collect_list("zone").alias("zones")), "pages")

    def may_be_positive(pack: dict, least: np.ndarray, most: np.ndarray, own: np.ndarray, every: np.ndarray) -> np.ndarray:
        return (own > 0) & (most >= np.frombuffer(pack["least"], np.int64)[:, None])

    def own_label(pack: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, sent: dict) -> list:
        found = []
        for i, (anchor, mine) in enumerate(zip(np.frombuffer(pack["ids"], np.int64), np.frombuffer(pack["labels"], np.int32), strict=True)):
            key = (pack["pack_id"], i)
            at = _still_first(sent, key, score[i], np.flatnonzero((labels == mine) & (ids != anchor)), positives)
            at = at[_first(score[i][at], ids[at], positives)]
            if len(at):
                _note(sent, key, score[i][at], positives)
                found.append((np.full(len(at), i), np.full(len(at), anchor), ids[at], score[i][at]))
        return found

    needed = _needed(packs, pages, n_pages, dims, may_be_positive)
    near = _read(needed, packs, blocks, dims, own_label, "pack_id long, place long, anchor_id long, positive_id long, positive_score long")
    near = _ranked(near, ["pack_id", "place"], "positive_score", "positive_id", positives)
    near = near.groupBy("pack_id").agg(F.collect_list(F.struct("place", "anchor_id", "positive_id", "positive_score", F.col("rank").cast("long").alias("nth"))).alias("near"))
    asked = stored(spark, packs.drop("least").join(near, "pack_id"), "asked")

    def windows(pack: dict) -> tuple[np.ndarray, ...]:
        place, score = (np.array([w[c] for w in pack["near"]], np.int64) for c in ("place", "positive_score"))
        return place, -((-least_percent * score) // 100), (most_percent * score) // 100

    def meets_window(pack: dict, least: np.ndarray, most: np.ndarray, own: np.ndarray, every: np.ndarray) -> np.ndarray:
        place, low, high = windows(pack)
        return (own < every)[place] & (most[place] >= low[:, None]) & (least[place] <= high[:, None]) & (low <= high)[:, None]

    def other_label(pack: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, sent: dict) -> list:
        found, mine = [], np.frombuffer(pack["labels"], np.int32)
        for w, i, low, high in zip(pack["near"], *windows(pack), strict=True):
            key = (pack["pack_id"], i, w["nth"])
            at = np.flatnonzero((score[i] >= low) & (score[i] <= high) & (labels != mine[i]))
            at = _still_first(sent, key, score[i], at, negatives)
            at = at[_first(score[i][at], ids[at], negatives)]
            if len(at):
                _note(sent, key, score[i][at], negatives)
                found.append((*(np.full(len(at), w[c]) for c in ("place", "nth", "anchor_id", "positive_id", "positive_score")), ids[at], score[i][at]))
        return found

    needed = _needed(asked, pages, n_pages, dims, meets_window)
    far = _read(needed, asked, blocks, dims, other_label, "pack_id long, place long, nth long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = _ranked(far, ["pack_id", "place", "nth"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
