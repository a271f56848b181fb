"""Benchmark decontamination: near word pairs find passages, local alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantspark.llm.common import columns

WORDS = re.compile(r"\w+")
#: Items under so many words are not searched for.
LEAST = 4
#: A seed is two words at one of these distances, in the item and in the text.
DISTANCES = (1, 2)
#: Places of an item whose seeds more items of a block hold than this may go, up to half of the hits it needs.
COMMON = 64
#: Alignment scores in words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage is a copy if its score reaches this share of the best possible for the item, or for
#: ``LONG`` words of a longer item; items under ``SHORT`` words must fit almost wholly.
SIMILARITY, LONG, SHORT, SHORT_SIMILARITY = 0.5, 50, 10, 0.9
#: Bytes of test items that travel to the tasks at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20


def tokens(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _pairs(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of a text of known (from 0) and unknown words (-1), as numbers, and the place each starts at."""
    codes, places = [], []
    for d in DISTANCES:
        a, b = ids[:-d], ids[d:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        codes.append(a[at] * size + b[at])
        places.append(at)
    return np.concatenate(codes), np.concatenate(places)


@dataclass
class Items:
    """A block of test items: words as numbers, the items that hold each seed, and for each the hits and the words of a text that a copy has."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    hits: np.ndarray
    reach: np.ndarray


def _items(rows: list) -> Items:
    """An alignment of m matches has m - 1 steps from one to the next. A step with at most one error is a seed at a place of its own in
    item and text; any other costs 2 or more, so a score of s needs s / 2 - 1 seeds, and errors end it within 3 words - s.
    """
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens(r["text"])], np.int64) for r in rows]
    size = max(1, len(vocabulary))
    need = np.array([needed(len(w)) for w in words])
    hits = np.maximum(1, np.ceil(need / MATCH - 1)).astype(np.int64)
    reach = np.array([3 * len(w) for w in words], np.int64) - np.ceil(need).astype(np.int64)
    code, item, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, w in enumerate(words):
        if len(w) >= LEAST:
            c, at = _pairs(w, size)
            code.append(c)
            item.append(np.full(len(c), i))
            place.append(at)
    code, item, place = map(np.concatenate, (code, item, place))
    held = np.unique(np.stack([code, item]), axis=1)[0]
    own, n = np.unique(held, return_counts=True)
    common = n[np.searchsorted(own, code)] > COMMON
    keep = np.ones(len(code), bool)
    for i in np.unique(item[common]):  # each place that goes costs a copy one hit at most
        mine = np.flatnonzero(item == i)
        gone = np.unique(place[mine[common[mine]]])[: hits[i] // 2]
        keep[mine[np.isin(place[mine], gone)]] = False
        hits[i] -= len(gone)
    code, item = np.unique(np.stack([code[keep], item[keep]]), axis=1)
    own, first = np.unique(code, return_index=True)
    return Items([r["item_id"] for r in rows], words, vocabulary, own, np.append(first, len(code)), item, hits, reach)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the word of the passage it ends at; one row of the table at a time."""
    ramp = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best = end = 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + ramp) - ramp
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def needed(length: int) -> float:
    return MATCH * (SHORT_SIMILARITY * length if length < SHORT else SIMILARITY * min(length, LONG))


def hits_in(text: str | None, items: Items) -> list[tuple[int, int, int, float, int]]:
    """``item, seeds, score, similarity, last word`` of every item that the text holds a copy of, the best copy each."""
    if not len(items.codes):
        return []
    get = items.vocabulary.get
    ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
    if len(ids) < LEAST:
        return []
    codes, at = _pairs(ids, len(items.vocabulary))
    found = np.minimum(np.searchsorted(items.codes, codes), len(items.codes) - 1)
    same = items.codes[found] == codes
    found, at = found[same], at[same]
    n = items.first[found + 1] - items.first[found]
    which = items.item[np.repeat(items.first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    seeds = np.unique(which * len(ids) + np.repeat(at, n))  # a place of the text counts once for an item
    which, at = np.divmod(seeds, len(ids))
    last = np.arange(len(seeds)) + items.hits[which] - 1
    k = np.flatnonzero(last < len(seeds))
    k = k[(which[last[k]] == which[k]) & (at[np.minimum(last[k], len(seeds) - 1)] - at[k] <= items.reach[which[k]])]
    out = []
    for i in np.unique(which[k]):
        words, reach = items.words[i], int(items.reach[i])
        mine = k[which[k] == i]
        best, end = (0, 0), -1
        starts, stops = np.maximum(0, at[last[mine]] - reach), at[mine] + reach + 1
        j = 0
        while j < len(mine):  # passages that touch are aligned together
            start, end = int(starts[j]), int(stops[j])
            while j < len(mine) and starts[j] <= end:
                start, end = min(start, int(starts[j])), max(end, int(stops[j]))
                j += 1
            score, stop = align(words, ids[start:end])
            best = max(best, (score, start + stop))
        if best[0] >= needed(len(words)):
            out.append((int(i), int((which == i).sum()), best[0], best[0] / (MATCH * len(words)), best[1]))
    return out


def blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The test items with their seeds, in blocks of about ``block_bytes``; each holds all of its items."""
    bench = columns(benchmark, "item_id", "text").where("text IS NOT NULL")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    context = docs.sparkSession.sparkContext
    for b in range(n):
        items = _items(bench.where(part == b).collect() if n > 1 else bench.collect())
        yield context.broadcast(items)


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_seeds, score, similarity, last_word``: one row for each row of ``docs`` and item it holds a copy of.

    Seeds are all pairs of words of an item at a distance of one or two. Each passage with as many of them as a copy must
    have is aligned with the item (match 2, mismatch and gap -1), so the result is that of aligning all pairs whole. The items go to the tasks in blocks of bounded size,
    and the rows of ``docs`` stay where they are. Null, empty and short texts and items (under four words) have no copy;
    repeated items and rows each count; null identifiers are carried, further columns ignored.
    """
    d = columns(docs, "doc_id", "text")
    item = columns(benchmark, "item_id").schema["item_id"]
    schema = T.StructType(
        [d.schema["doc_id"], item, *(T.StructField(c, T.LongType()) for c in ("n_seeds", "score")), T.StructField("similarity", T.DoubleType()), T.StructField("last_word", T.LongType())]
    )
    out = None
    for block in blocks(d, benchmark):

        def scan(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            items = block.value
            for batch in batches:
                rows = [(r, *hit) for r, text in enumerate(batch.column("text")) for hit in hits_in(text.as_py(), items)]
                at, which, seeds, score, similarity, last = zip(*rows, strict=True) if rows else ((),) * 6
                ids = pa.array(items.ids) if items.ids else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(at, pa.int64())),
                        ids.take(pa.array(which, pa.int64())),
                        pa.array(seeds, pa.int64()),
                        pa.array(score, pa.int64()),
                        pa.array(similarity, pa.float64()),
                        pa.array(last, pa.int64()),
                    ],
                    names=schema.names,
                )

        found = d.mapInArrow(scan, schema)
        out = found if out is None else out.unionAll(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without rows that hold a copy of an item; nothing is shuffled."""
    at = next(i for i, c in enumerate(docs.columns) if c == "text")
    for block in blocks(columns(docs, "text"), benchmark):

        def scan(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not hits_in(t.as_py(), block.value) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
