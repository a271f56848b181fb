import numpy as np
import pyarrow as pa
import pytest

from plantspark.llm import lm
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.conftest import EDGES, prose


@pytest.mark.parametrize("order,chunk", [(1, 1 << 20), (2, 300), (3, 2000)])
def test_against_plain_counts(docs, order, chunk):
    rows = [(i, " ".join(prose(i % 7 + k, 9) for k in range(3)).title()) for i in range(40)] + [(90, "x x x x x"), (91, "y")] + [(d, t[:500] if t else t) for d, t in EDGES]
    held = [plain.fold(d, 7) == 2 for d, _ in rows]
    df = docs(rows, spread=True).withColumn("out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))
    got = lm.score_texts(df, "out", order=order, prior=3.0, chunk_bytes=chunk).collect()
    want = plain.language_model(rows, held, order, 3.0)
    assert len(got) == len(rows)
    a = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got)
    b = sorted((d or 0, *w, h) for (d, _), w, h in zip(rows, want, held, strict=True))
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and x[6] == y[6]
        assert x[4] == pytest.approx(y[4]) and x[5] == pytest.approx(y[5])


def test_probabilities_sum_to_one(docs):
    """Over the words of the corpus, the end and one word that it lacks."""
    rows = [(1, "a b a c"), (2, "b a"), (3, "c c a")]
    vocabulary = ["a", "b", "c", "zzz"]
    ask = [(10 + i, f"a {w}") for i, w in enumerate(vocabulary)] + [(20, "a")]
    df = docs(rows + ask).withColumn("out", F.col("doc_id") >= 10)
    score = {r.doc_id: r.score for r in lm.score_texts(df, "out").collect()}
    one = {r.doc_id: r.score for r in lm.score_texts(docs([*rows, (10, "a"), (11, "")]).withColumn("out", F.col("doc_id") >= 10), "out").collect()}
    # log p("a", w, end) = log p(a) + log p(w | a) + log p(end | w)
    counts = {"a": 4, "b": 2, "c": 3, "zzz": 0}
    ends = {"a": 2, "b": 0, "c": 0, "zzz": 0}  # ends follow: a twice, c once
    ends["c"] = 1
    uni_end = (3 + 1) / (12 + 4 + 1)
    p_end = {w: (ends[w] + lm.PRIOR * uni_end) / (counts[w] + lm.PRIOR) for w in vocabulary}
    p_a = 10 ** one[10] / p_end["a"]
    total = sum(10 ** score[10 + i] / p_end[w] for i, w in enumerate(vocabulary)) / p_a + p_end["a"]
    assert total == pytest.approx(1)


def test_empty_table(docs):
    assert lm.score_texts(docs([]).withColumn("out", F.lit(None).cast("boolean")), "out").count() == 0


def test_no_training_rows(docs):
    r = lm.score_texts(docs([(1, "a b")]).withColumn("out", F.lit(True)), "out").first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_carries_its_state(monkeypatch, order):
    """States, failure arcs and the walk, also of texts in pieces, against plain counts."""
    monkeypatch.setattr(lm, "PIECE", 5)
    rows = [(i, " ".join("abcd"[(i * k * k + k // 3) % 4] for k in range(3 + 4 * i))) for i in range(9)] + [(20, "a zz b c zz a b"), (21, "")]
    held = [d >= 7 for d, _ in rows]
    grams = lm.Grams(pa.table({"text": [t for _, t in rows]}), order)
    train = ~np.array(held)
    totals = [np.bincount(grams.at[k][train[grams.text[grams.full[k]]]], minlength=len(grams.codes[k])).astype(np.uint64) for k in range(order)]
    model = lm.Automaton(grams, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 3.0)
    assert len(model.fail) == 1 + sum(int((t > 0).sum()) for t in totals[:-1]) and len(model.key) == sum(int((t > 0).sum()) for t in totals[1:])
    base, own = lm.traverse(grams, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 3.0)
    for i, w in enumerate(plain.language_model(rows, held, order, 3.0)):
        assert base[grams.text == i].sum() == pytest.approx(w[3]) and own[grams.text == i].sum() == pytest.approx(w[4])
