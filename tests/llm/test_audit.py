import re
from collections import Counter
from itertools import permutations

from plantspark.llm import audit
from tests.llm.conftest import EDGES, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """Every order walked document by document."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shares = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in permutations("ABCDE"):
            alive = [x[1:] for x in docs if x[0] == part]
            own = list(alive)
            for k, f in enumerate(order):
                lost = [x for x in alive if f in x[0]]
                gone = sum(f in x[0] for x in own) - len(lost)
                alive = [x for x in alive if f not in x[0]]
                only = sum(x[0] == {f} for x in own)
                out[part, "".join(order), k + 1] = [len(alive), len(lost), gone, only, sum(x[1] for x in lost), sum(x[2] for x in lost)]
                shares[part, f] += len(lost)
    return sorted((p, o, k, *v, shares[p, o[k - 1]]) for (p, o, k), v in out.items())


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, MASK int").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, good string")
    found = audit.audit_filters(docs, marks)
    return sorted(tuple(r) for r in found.drop("filter").collect())


def test_every_order_as_walked_document_by_document(spark):
    texts = [prose(i, 60 + 20 * (i % 5)) + ("" if i % 3 else " #tag") for i in range(30)] + ["SHOUT " * 120, "Mixed Case words " * 40]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7], "en") for i in range(25)] + [(3, texts[0], "fr"), (3, texts[3], "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (5, None, None)]
    labels = [(d, q, None if x is None else int(x)) for d, q, x in labels]
    got = run(spark, rows, labels)
    assert got == plain(rows, labels)
    assert {g[0] for g in got} == {"", "en", "de", "fr"} and len(got) == 4 * 600
    kept = {(p, k): n for p, _, k, n, *_ in got if k == 5}
    assert len(kept) == 4


def test_nulls_long_texts_repeated_rows(spark):
    rows = [(d, t, "en" if i % 2 else None) for i, (d, t) in enumerate(EDGES)]
    assert run(spark, rows, [(4, 1, 1)]) == plain(rows, [(4, 1, 1)])


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", "en")], []) == plain([(1, "a", "en")], [])


def test_other_filters_and_their_number(spark):
    d = spark.createDataFrame([(1, "one two", "en"), (2, "one two", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit_filters(d, none, {"S": "n_words < 5"}, "C").orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails) for r in got] == [
        ("CS", 1, 1, 1, 0, 0), ("CS", 2, 0, 1, 1, 1), ("SC", 1, 0, 2, 0, 1), ("SC", 2, 0, 0, 1, 0),
    ]
