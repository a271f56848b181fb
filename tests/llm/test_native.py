import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantspark.llm import lines, mixing, quality
from tests.llm import plain
from tests.llm.conftest import EDGES, prose


def test_line_dedup(docs):
    shared, upper = prose(1, 8), prose(1, 8).upper()
    rows = [(i, f"{prose(i + 10, 5)}\n  {shared if i % 2 else upper}\t\nshort\n{prose(i + 50, 3)}") for i in range(6)]
    rows += [(9, shared), (9, shared), (None, shared), (10, "\n".join([shared] * 3)), *EDGES]
    got = lines.drop_common_lines(docs(rows)).collect()
    want = sorted(map(repr, ((d, *x) for (d, _), x in zip(rows, plain.line_dedup(rows), strict=True))))
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got) == want
    assert lines.drop_common_lines(docs([])).count() == 0


def test_line_dedup_keeps_columns_but_its_own(spark):
    df = spark.createDataFrame([(1, "a", 7, "x", "y")], "doc_id int, text string, n_lines int, pos string, h1 string")
    got = lines.drop_common_lines(df)
    assert got.columns == ["doc_id", "text", "pos", "h1", "n_lines", "n_dropped"]
    assert got.collect()[0].n_lines == 1


def test_quality_counts(docs):
    block = prose(3, 12)
    rows = [*EDGES, (20, f"{block} {block} tail"), (21, f"{prose(4, 40)}\nsame line\nsame line\n \n "), (22, " ".join(["ha"] * 30)), (23, f"{block} {prose(5, 9)} {block}")]
    rows += [(30 + n, " ".join(["w"] * n)) for n in range(6, 12)]
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in quality.apply_rules(docs(rows)).collect())
    assert got == sorted((d or 0, *plain.quality(t)) for d, t in rows)


def test_quality_rules(docs):
    good = "the cat and the dog of the house went with " + prose(1, 30)
    bad = {10: "the of " + "### $$$ " * 20, 11: (prose(2, 10) + " ") * 5, 12: "THE!! CAT!! OF!! " + prose(2, 30).replace(" ", "!! ")}
    got = {r.doc_id: r for r in quality.apply_rules(docs([(1, good), *bad.items(), (2, None)])).collect()}
    assert got[1].kept and not got[1].failed_rules
    assert not any(got[d].kept for d in (*bad, 2))
    assert got[11].base_failed and got[10].failed_rules and not got[12].base_failed
    assert quality.apply_rules(docs([]), ()).count() == 0


def test_no_user_function_on_native_paths(docs):
    d = docs(EDGES)
    for df in (quality.apply_rules(d), lines.drop_common_lines(d), mixing.mix(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_fair_order_stays_within_a_block(quota):
    quotas = {f"s{i:02}": q for i, q in enumerate(quota)}
    order, slots = plain.fair_order(quotas), sum(quota)
    done = dict.fromkeys(quotas, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] * slots - t * q) < slots for x, q in quotas.items())


def test_schedule_is_the_fair_order(spark):
    weights = {"a": 50, "b": 25, "c": 24, "d": 1, None: 7}
    df = spark.createDataFrame(list(weights.items()), "source string, weight long")
    total = sum(weights.values())
    quotas = {("" if s is None else s): max(1, w * 200 // total) for s, w in weights.items()}
    got = [r.source or "" for r in mixing.schedule(df, 200).orderBy("slot").collect()]
    assert got == plain.fair_order(quotas)


def test_mix_places_every_row_once(docs):
    rows = [(i, "t") for i in range(700)] + [(3, "t"), (None, None)]
    got = mixing.mix(docs(rows), block=4, round_slots=50).collect()
    assert len(got) == len(rows) == len({r.position for r in got})
    assert all(r.release <= r.slot < r.deadline for r in got)
    ranked = mixing.rank_in_source(docs(rows), ranges=8).collect()
    for s in ("src0", "src1"):
        assert sorted(r["rank"] for r in ranked if r.source == s) == list(range(sum(r.source == s for r in ranked)))
    assert mixing.mix(docs([])).count() == 0


def test_mix_with_given_weights(spark, docs):
    weights = spark.createDataFrame([("src0", 3), ("src1", 1), ("gone", 9)], "source string, weight long")
    got = sorted(mixing.mix(docs([(i, "t") for i in range(400)]), weights, block=2, round_slots=4).collect(), key=lambda r: r.position)
    for n in range(8, 200, 8):
        share = sum(r.source == "src0" for r in got[:n])
        assert abs(share - 0.75 * n) < 2


def test_exact_order_stays_within_a_block_of_the_given_weights():
    """A hot source, a tiny one, over 1,000 sources and fractional weights, over the whole length."""
    hot = [139_580, *[45_285] * 19]
    many = [1 + i % 10 for i in range(1500)]
    for weights, lengths in ((hot, [w // 10 for w in hot]), ([10_000, 1, 4999], [10_000, 1, 4999]), (many, [3 * w for w in many]), (mixing.whole_numbers(["0.3", "0.45", "0.0001", "1E-3"]), [3000, 4500, 1, 10])):
        total, done, last = sum(weights), [0] * len(weights), min(n * sum(weights) // w for n, w in zip(lengths, weights, strict=True))
        for t, (k, nth, slot, release, deadline) in enumerate(mixing.fair_slots(weights, lengths), 1):
            assert nth == done[k] and release == nth * total // weights[k] and release <= slot < deadline == -(-(nth + 1) * total // weights[k])
            done[k] += 1
            if slot < last and t % 7 == 0:
                assert t == slot + 1 and all(abs(d * total - t * w) < total for d, w in zip(done, weights, strict=True))
        assert done == lengths


def test_mix_follows_unrounded_weights(spark):
    """By position, each source is less than a block from its weight, in rounds and over the whole length."""
    n = {"hot": 3000, "tiny": 4, "other": 1500}
    df = spark.createDataFrame([(f"{s}{i}", s) for s, c in n.items() for i in range(c)], "doc_id string, source string")
    for given in ({"hot": 0.67, "tiny": 0.0005, "other": 0.3295}, {"hot": 2.0, "tiny": 0.001, "other": 1.0}, {"hot": 5.0, "tiny": 1.0, "other": 2.0}):
        weights = spark.createDataFrame(list(given.items()), "source string, weight double")
        got = sorted(mixing.mix(df, weights, block=1).collect(), key=lambda r: r.position)
        assert len(got) == sum(n.values()) == len({r.position for r in got}) and all(r.release <= r.slot < r.deadline for r in got)
        done, total = dict.fromkeys(n, 0), sum(given.values())
        last = min(c * total / given[s] for s, c in n.items())
        for t, r in enumerate(got, 1):
            done[r.source] += 1
            assert t > last or all(abs(done[s] - t * w / total) < 1 + 1e-9 for s, w in given.items())


@pytest.mark.parametrize("sizes", [[1], [33, 1], [2000, 7, 300, 1], [40] * 25])
def test_mix_keeps_to_unrounded_weights(docs, sizes):
    """Every block within its window, and at any slot each source less than a block from its share while it lasts."""
    rows = [(k * 10_000 + i, "t") for k, n in enumerate(sizes) for i in range(n)]
    df = docs(rows).withColumn("source", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 10_000).cast("string")))
    got = sorted(mixing.mix(df).collect(), key=lambda r: r.position)
    assert len(got) == len(rows) == len({r.position for r in got})
    assert all(r.release <= r.slot < r.deadline or r.slot >= r.release for r in got)
    weight = {f"s{k}": math.ceil(math.sqrt(n)) for k, n in enumerate(sizes)}
    total, blocks = sum(weight.values()), {f"s{k}": -(-n // 32) for k, n in enumerate(sizes)}
    starts = {}
    for r in got:
        starts.setdefault((r.source, r.block), r.slot)
    horizon = min(blocks[s] * total // w for s, w in weight.items())
    for t in range(1, min(horizon, 400) + 1):
        for s, w in weight.items():
            done = sum(1 for (x, _), at in starts.items() if x == s and at < t)
            assert abs(done - t * w / total) < 1
