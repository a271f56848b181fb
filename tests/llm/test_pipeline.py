import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantspark.llm import quality
from plantspark.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_pipeline_against_plain_python(spark, table):
    def tokens(text):
        return re.findall(r"\w+", text.lower())

    rows = [(d, t) for d, t in table if re.search(r"[^\W\d_]", t or "")]
    rows = [(d, x[0]) for (d, _), x in zip(rows, plain.line_dedup(rows), strict=True)]
    rows = [r for r, (n, c) in zip(rows, plain.near_groups(rows, 80), strict=True) if not n or r[0] == c]
    items = [f" {' '.join(tokens(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(i in f" {' '.join(tokens(t))} " for i in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((d, t, len(t)) for d, t in rows)
    assert len({r.position for r in got}) == len(got)


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, POSITION string, kept string"
    data = [(None, None, None, None, None, None, None), (1, "", None, "a", 0, "p", "k"), (2, prose(1, 30), "en", None, 9, None, None), (2, prose(1, 30), "en", None, 9, None, None), (3, "z" * 100_000, None, "b", 1, "", "")]
    for rows in (data, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            want = [c for c in docs.columns if name != "mixed" or c != "POSITION"]
            assert out.columns[: len(want)] == want
            out.collect()


def test_queries_carry_whole_results(spark, table):
    """Rows, digests and counts of the queries on the small table, against plain Python."""
    texts = dict(table)
    got = {r.doc_id: r for r in QUERIES["op2_suffix_dedup"](spark, SF).collect()}
    data = [(t or "").encode() for _, t in table]
    for (d, _), b, (gone, spans, kept) in zip(table, data, plain.repeats(data, 400), strict=True):
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), gone, spans, plain.sha(kept))
    for r in QUERIES["op5_personal_data"](spark, SF).collect():
        base = plain.personal(texts[r.doc_id])
        kinds = ("email", "ip", "card", "phone")
        assert r.base_sha256 == plain.sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
    want = plain.near_groups(table, 85)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_near_duplicates"](spark, SF).collect()}
    assert near == {d: w for (d, _), w in zip(table, want, strict=True)}
    held = [plain.fold(d, 7) == 2 for d, _ in table]
    scored = {r.doc_id: r for r in QUERIES["op7_lm_score"](spark, SF).collect()}
    for (d, _), h, w in zip(table, held, plain.language_model(table, held, 3, 8.0), strict=True):
        r = scored[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *w[:3])
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_rules_agree_with_labels(spark):
    """Documents labelled good pass the rules; most of the bad ones fail."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(quality.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")), "doc_id").where("n_words >= 20")
    n = {(r.quality, r.kept): r["count"] for r in labels.groupBy("quality", F.col("kept")).count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.2 * n[0, False]
