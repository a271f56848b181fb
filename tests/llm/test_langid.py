import itertools

import numpy as np
from pyspark.sql import functions as F

from plantspark.llm import langid
from plantspark.llm.queries import QUERIES
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right >= 0.97 * n


def test_best_path_is_the_best():
    r = np.random.default_rng(1)
    length = np.array([5, 1, 4, 6])
    scores = r.normal(size=(16, 3)).astype(np.float32) * 3
    first = np.cumsum(length) - length
    path = langid.switching_paths(scores, first, length, 2.0)
    for a, n in zip(first, length, strict=True):

        def value(p, a=a, n=n):
            return sum(scores[a + i, p[i]] for i in range(n)) - 2.0 * sum(p[i] != p[i - 1] for i in range(1, n))

        best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
        assert abs(value(path[a : a + n]) - best) < 1e-4


def model(spark):
    rows = [("en", "the house and the garden with the trees"), ("de", "das Haus und der Garten mit den Bäumen"), ("ru", "дом и сад с деревьями"), (None, "x"), ("en", None)]
    return langid.fit(spark.createDataFrame(rows * 3, "lang string, text string"))


def test_mixed_text_and_scripts(spark, docs):
    text = "the garden with the house. Дом и сад. das Haus und der Garten mit"
    r = langid.identify(docs([(1, text)]), model(spark)).first()
    assert [s.lang for s in r.spans] == ["en", "ru", "de"]
    assert text[r.spans[1].start : r.spans[1].end] == "Дом и сад"
    assert 0 < r.score < 1


def test_edges(spark, docs):
    rows = [*EDGES, (40, "123 ... !"), (41, "漢字")]
    got = langid.identify(docs(rows), model(spark)).collect()
    assert len(got) == len(rows)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {None, 1, 2, 3, 40} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs([]), model(spark)).count() == 0
    none = langid.fit(docs([]))
    assert {r.lang_pred for r in langid.identify(docs(rows), none).collect()} == {"und"}


def test_rejects_only_what_has_no_language(spark, docs):
    rows = [(1, "the house"), (2, "12 34"), (3, None), (4, "das Haus und the garden")]
    kept = langid.keep_identified(docs(rows), model(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4] and kept.columns == docs(rows).columns


def test_more_languages_than_a_byte_counts():
    r = np.random.default_rng(1)
    scores = r.normal(0, 1, (40, 300))
    scores[:20, 280] += 9
    scores[20:, 299] += 9
    got = langid.switching_paths(scores, np.array([0, 20]), np.array([20, 20]))
    assert (got[:20] == 280).all() and (got[20:] == 299).all()
