import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantspark.llm import negatives
from plantspark.llm.negatives import hard_negatives, hilbert_keys


def plain(rows, every=100, k=5, n=10, low=30, high=90):
    own = set()
    for v, x, label in rows:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.add((v, label, tuple(math.floor(256 * float(c)) for c in x)))
    out = []
    for v, label, x in own:
        if v % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), w, m) for w, m, y in own if w != v]
        near = sorted((-s, w) for s, w, m in scored if m == label)[:k]
        for s, p in near:
            hard = sorted((-t, w) for t, w, m in scored if m != label and low * -s <= 100 * t <= high * -s)[:n]
            out += [(v, p, r + 1, w, -s, -t) for r, (t, w) in enumerate(hard)]
    return sorted(out)


def run(spark, rows, every=100, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, RANK int").repartition(4)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("label"), F.col("vec_id") % every == 0, **more).collect())


def vectors(n, dims=6, seed=1, clusters=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [(i, [float(np.float32(c + r.gauss(0, 0.4))) for c in centres[r.randrange(clusters)]], r.randrange(4)) for i in range(n)]


@pytest.fixture()
def small(monkeypatch):
    for name, value in (("BLOCK", 16), ("PACK", 3), ("PAGE", 4)):
        monkeypatch.setattr(negatives, name, value)


def test_as_by_all_scores(spark, small):
    rows = vectors(600)
    got = run(spark, rows, every=20)
    assert got == plain(rows, every=20) and len(got) > 200
    assert run(spark, rows, every=50, positives=2, negatives=3, least_percent=10, most_percent=60) == plain(rows, 50, 2, 3, 10, 60)


def test_usual_blocks(spark):
    rows = vectors(3000, dims=16)
    assert run(spark, rows) == plain(rows)


def test_copies_ties_and_repeated_rows(spark, small):
    rows = vectors(120)
    hot = [(1000 + i, rows[3][1], i % 3) for i in range(150)]
    rows = rows + hot + rows[:40] + hot[:20] + [(5, rows[6][1], 1), (5, rows[7][1], 1)]
    assert run(spark, rows, every=10) == plain(rows, every=10)


def test_rows_that_take_no_part(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = vectors(80) + [
        (None, [1.0] * 6, 1), (200, None, 1), (300, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (400, [nan] * 6, 1), (500, [inf] + [0.0] * 5, 1),
        (600, [1.0] * 6, None), (700, [-inf] * 6, 0),
    ]
    assert run(spark, rows, every=10) == plain(rows, every=10)
    huge = rows + [(800, [2e5] * 6, 1), (900, [3e38] * 6, 1)]
    assert run(spark, huge, every=10) == plain(rows, every=10)
    large = rows + [(810, [1e5] * 6, 1), (820, [-9e4] * 6, 2)]
    assert run(spark, large, every=10) == plain(large, every=10)


def test_short_long_and_empty_vectors(spark, small):
    rows = vectors(60) + [(100, [0.5, 0.5], 1), (110, [], 2), (120, [1.0] * 9, 1)]
    assert run(spark, rows, every=10) == plain(rows, every=10)
    assert run(spark, [(i, [], i % 2) for i in range(6)], every=3) == plain([(i, [], i % 2) for i in range(6)], every=3)


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.0], 2), (3, [-1.0, 0.0], 2)]
    assert run(spark, rows) == plain(rows) == [(0, 1, 1, 2, 65536, 32768)]


def test_curve_visits_each_cell_next_to_the_last():
    for dims, bits in ((2, 3), (3, 2), (5, 2)):
        n = 1 << bits
        cells = np.array(np.meshgrid(*[range(n)] * dims, indexing="ij")).reshape(dims, -1).T
        order = np.argsort(np.array(hilbert_keys(cells, bits)))
        assert len(set(hilbert_keys(cells, bits))) == len(cells)
        assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    r = np.random.default_rng(3)
    a, x = r.integers(-300, 300, (7, 9)), r.integers(-300, 300, (40, 9))
    low, high = negatives._bounds(a, x.min(0)[None], x.max(0)[None])
    s = negatives._scores(a, x)
    assert (low[:, 0] <= s.min(1)).all() and (s.max(1) <= high[:, 0]).all()


def test_zone_maps_leave_blocks_unread(spark, small):
    rows = [(i + 50, [float(i // 100 == g) * 0.9 for g in range(10)], i % 3) for i in range(1000)]
    seen = []
    read = negatives._read

    def watched(needed, *rest):
        seen.append(needed.distinct().count())
        return read(needed, *rest)

    negatives._read = watched
    try:
        got = run(spark, rows, positives=2)
    finally:
        negatives._read = read
    assert got == plain(rows, k=2)
    assert max(seen) < 4 * 63 / 3
