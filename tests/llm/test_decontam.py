import random

import numpy as np
import pytest

from plantspark.llm import decontam
from tests.llm.conftest import EDGES, prose


def test_alignment_against_the_whole_table():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 14))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == max(map(max, h))


def edited(text, every, seed=0):
    w = text.split()
    for k in range(seed % every, len(w), every):
        w[k] = f"new{k}"
    return " ".join(w)


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 300])
def test_finds_copies_and_leaves_the_rest(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (block,))
    items = [(i, prose(500 + i, 30 + i)) for i in range(8)] + [(20, "one two three"), (21, None), (22, ""), (23, prose(900, 400)), (None, prose(901, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    around = [prose(600 + i, 60) for i in range(40)]
    rows = [(i, f"{around[i]} {items[i][1]} {around[i + 20]}") for i in range(8)]
    rows += [(10 + i, f"{around[i]} {edited(items[i][1], 6, i)} {around[i + 8]}") for i in range(8)]
    rows += [(30, items[0][1].upper().replace(" ", ", ")), (31, f"{items[1][1]} and {items[2][1]}"), (32, around[0] + " " + " ".join(items[11][1].split()[100:180])), (33, f"x {items[12][1]}")]
    rows += [(50 + i, f"{around[i]} {around[39 - i]}") for i in range(12)] + [(70, " ".join(items[3][1].split()[:8]) + " " + around[3]), (71, "one two three four"), *EDGES]
    got = {(r.doc_id, r.item_id) for r in decontam.find_copies(docs(rows, spread=True), bench).collect()}
    assert got == {(i, i) for i in range(8)} | {(10 + i, i) for i in range(8)} | {(30, 0), (31, 1), (31, 2), (32, 23), (33, None)}
    left = decontam.remove_contaminated(docs(rows), bench)
    assert left.count() == len(rows) - 20 and left.columns == docs(rows).columns


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_copies(docs([(1, "a b c d e")]), bench).count() == 0
    assert decontam.find_copies(docs([]), spark.createDataFrame([(1, prose(1, 9))], "item_id long, text string")).count() == 0
    assert decontam.remove_contaminated(docs([(1, "a")]), bench).count() == 1


def whole(item, text):
    """The best local alignment of all words."""
    row, best = [0] * (len(text) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


def test_edited_copies_against_aligning_all_pairs():
    """Every third or fourth word replaced, dropped or followed by another, in long, short and much copied items of common words."""
    r = random.Random(4)
    common = prose(7, 12).split()
    items = [" ".join(r.choice(common) if r.random() < share else prose(r.random(), 1) for _ in range(n)) for n in (4, 6, 9, 12, 20, 33, 60, 130) for share in (0.2, 0.6, 1.0)]
    texts = [prose(r.random(), 80) for _ in range(5)] + [" ".join(r.choices(common, k=150)) for _ in range(5)]
    for item in items:
        for every, how in ((4, "new"), (3, "new"), (4, "gone"), (2, "more"), (1, "more"), (3, "gone"), (5, "new")):
            w = [x for k, y in enumerate(item.split()) for x in ([y] if (k + 1) % every else {"new": ["zz"], "gone": [], "more": [y, "zz"]}[how])]
            texts.append(f"{prose(r.random(), 20)} {' '.join(w)} {prose(r.random(), 20)}")
    rows = [{"item_id": i, "text": t} for i, t in enumerate(items)]
    for block in (rows, rows + [{"item_id": 100 + i, "text": f"{items[5]} {i}"} for i in range(70)]):  # the second has seeds of many items
        index = decontam._items(block)
        assert (index.hits[5] < decontam._items(rows).hits[5]) == (block is not rows)
        for text in texts if block is rows else texts[::6]:
            words = decontam.tokens(text)
            got = {i: score for i, _, score, _, _ in decontam.hits_in(text, index) if i < len(items)}
            scores = {i: whole(decontam.tokens(t), words) for i, t in enumerate(items)}
            assert got == {i: x for i, x in scores.items() if x >= decontam.needed(len(items[i].split()))}


def test_copies_of_common_items_are_found(spark, docs):
    """Many edited copies of one item: its words are frequent in the corpus then."""
    item = prose(41, 40)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, f"{prose(i, 9)} {edited(item, 4, i)}") for i in range(60)]
    assert decontam.find_copies(docs(rows), bench).count() == 60
