import numpy as np
import pytest

from plantspark.llm import suffix
from tests.llm import plain
from tests.llm.conftest import EDGES, prose


def compare(docs, rows, width):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.drop_repeats(docs(rows, spread=True), width).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((d or 0, len(t), *x) for (d, _), t, x in zip(rows, texts, plain.repeats(texts, width), strict=True))
    assert got == want
    return sum(x[2] for x in got)


def corpus(seed):
    passage, long = prose(seed, 60), prose(seed + 1, 150)
    rows = [(i, f"{prose(seed + 10 + i, 30)} {passage} {prose(seed + 60 + i, 20)}") for i in range(12)]
    rows += [(20 + i, f"{long[i * 7 :]}é{prose(seed + 90 + i, 15)}") for i in range(5)]
    return rows + [(40, long + long), (41, "ab" * 400), (42, "z" * 700), (43, "z" * 130), (44, passage), (45, passage)]


@pytest.mark.parametrize("width", [64, 100, 400])
def test_against_every_run(docs, width):
    assert compare(docs, corpus(width), width) > 0


def test_edges(docs):
    edges = [(d, t[:3000] if t else t) for d, t in EDGES]
    compare(docs, edges, 80)
    assert suffix.drop_repeats(docs([])).count() == 0
    with pytest.raises(ValueError):
        suffix.drop_repeats(docs([]), 10)


def test_seeds_with_very_many_surroundings(docs, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_ROWS", 2)
    assert compare(docs, corpus(7), 100) > 0


def test_steps_of_few_rows(docs, monkeypatch):
    monkeypatch.setattr(suffix, "STEP_ROWS", 3)
    monkeypatch.setattr(suffix, "SLICE", 500)
    assert compare(docs, corpus(8), 100) > 0


def test_samples_follow_the_run_alone():
    a, b = prose(1, 100).encode(), prose(2, 80).encode()
    one, _, _ = suffix.samples(np.frombuffer(b + a, np.uint8), 120)
    two, _, _ = suffix.samples(np.frombuffer(a, np.uint8), 120)
    assert np.array_equal(one[len(b) :] - len(b), two)


def test_range_least():
    r = np.random.default_rng(3)
    x = r.integers(0, 50, 40).astype(np.int16)
    low = r.integers(0, 40, 200)
    high = np.minimum(39, low + r.integers(0, 40, 200))
    assert suffix._range_least(x, low, high).tolist() == [x[a : b + 1].min() for a, b in zip(low, high, strict=True)]
