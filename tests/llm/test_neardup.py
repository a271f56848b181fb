import random

import numpy as np
import pytest

from plantspark.llm import graph, neardup
from plantspark.llm.shingles import Words, shingle_set
from tests.llm import plain
from tests.llm.conftest import EDGES, prose


def edited(text, seed, n):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
    return " ".join(w)


def corpus(seed):
    rows = [(i, prose(seed + i, 8 + 9 * i)) for i in range(12)]
    for i in range(4, 12):
        rows += [(100 + 10 * i + k, edited(rows[i][1], k, 1 + k % 3)) for k in range(6)]
    chain, base = [], prose(seed + 77, 260).split()
    for k in range(10):  # each links with the next only
        chain.append((900 - k, " ".join(base[8 * k : 8 * k + 160])))
    rows += chain + [(950, rows[7][1].upper()), (951, rows[7][1].replace(" ", "\n\t"))]
    return rows + EDGES


@pytest.mark.parametrize("percent", [80, 85])
def test_against_all_pairs(docs, percent):
    rows = corpus(percent)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(rows, spread=True), percent).collect())
    want = sorted((d or 0, *x) if x[0] else (d or 0, 0, d) for (d, _), x in zip(rows, plain.near_groups(rows, percent), strict=True))
    assert [(a, b, c or 0) for a, b, c in got] == [(a, b, c or 0) for a, b, c in want]


def test_keeps_one_of_each_group(docs):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (3, edited(prose(1, 50), 1, 1)), (4, prose(2, 50)), (4, prose(2, 50)), (5, None), (None, prose(3, 9)), (6, "")]
    kept = neardup.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6]
    assert neardup.keep_one(docs([])).count() == 0


def test_registers_agree_as_often_as_sets_are_alike():
    m = neardup.banding(85).registers
    probes = neardup._probe_table(m)
    r = np.random.default_rng(5)
    for size in (8, 60, 2000):
        hits = []
        for _ in range(60):
            common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (size, max(1, size // 10), max(1, size // 10)))
            x, y = neardup.registers([np.r_[common, a], np.r_[common, b]], m, probes)
            hits.append((x == y).mean())
        true = size / (size + 2 * max(1, size // 10))
        assert abs(np.mean(hits) - true) < 0.06


def test_unrelated_registers_collide_as_expected():
    m, r = 252, np.random.default_rng(6)
    probes = neardup._probe_table(m)
    sets = [r.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(80)]
    regs = neardup.registers(sets, m, probes)
    seen = np.mean([(regs[i] == regs[i + 1]).mean() for i in range(0, 80, 2)])
    want = neardup.expected_collisions(np.array([3000 / m]), np.array([3000 / m]))[0]
    assert abs(seen - want) < 5e-4


def test_shingle_sets_have_the_right_size():
    w = Words()
    for text in ("", None, "a", "a b c d", "A b c d e", "a b c d e f a b c d e", " ".join(["x"] * 50)):
        assert len(shingle_set(w.codes(text), 5)) == len(plain.shingles(text))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hub_rows", [10_000, 3])
def test_large_group_of_copies_that_are_mostly_apart(docs, monkeypatch, hub_rows):
    """Copies with up to six edits of one text: only few pairs are near, and some link through shared edits alone."""
    monkeypatch.setattr(neardup, "HUB_ROWS", hub_rows)
    base = prose(5, 160)
    rows = [(i, edited(base, 50 + i, i % 7)) for i in range(1, 120)]
    for k in range(6):
        far = edited(base, 900 + k, 8)
        rows += [(300 + 10 * k + j, edited(far, 1000 + j, 1)) for j in range(4)]
    for part in (rows, [r for r in rows if r[0] % 7]):
        got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs(part), 85).collect())
        assert got == sorted((d, c) for (d, _), (_, c) in zip(part, plain.near_groups(part, 85), strict=True))
