"""Chains of annotations against a walk up each chain."""

import random

import pytest

from plantspark.operators.inheritance import CircularInheritanceError, inherit_chains, inheritance_problems

SCHEMA = "node string, sensor string, unit string, role string"


def walk(notes, parents):
    """Resolved rows and circle nodes, node by node."""
    up, rows, bad = {}, {}, {}
    for n, p in sorted(((n, p) for n, p in parents if n is not None), key=lambda x: (x[1] is None, x[1] or "")):
        if up.get(n) is None:
            up[n] = p
    for n in {n for n, *_ in notes} | set(up):
        chain, at = [], n
        while at is not None and at not in chain:
            chain.append(at)
            at = up.get(at)
        if at is not None:
            bad[n] = "circle" if at == n else "below_circle"
            continue
        for a in chain or [n]:
            for m, s, unit, role in notes:
                if m == a:
                    old = rows.get((n, s), (None, None))
                    rows[n, s] = (old[0] if old[0] is not None else unit, old[1] if old[1] is not None else role)
    return sorted(((n, s, *v) for (n, s), v in rows.items()), key=str), bad


def run(spark, notes, parents, **options):
    found, problems = inherit_chains(spark.createDataFrame(notes, SCHEMA), spark.createDataFrame(parents, "node string, parent string"), on_circle="report", **options)
    return sorted((tuple(r) for r in found.collect()), key=str), sorted((tuple(r) for r in problems.collect()), key=str)


def test_deep_chains_trees_and_circles(spark):
    rnd = random.Random(3)
    parents = [(f"n{i}", f"n{i - 1}" if i % 37 else None) for i in range(111)]
    parents += [(f"t{i}", f"t{rnd.randrange(i)}" if i else "n36") for i in range(40)]
    parents += [("c0", "c2"), ("c1", "c0"), ("c2", "c1"), ("d0", "c1"), ("d1", "d0"), ("self", "self"), ("e", "self")]
    nodes = [n for n, _ in parents]
    notes = [(n, s, rnd.choice([None, f"u{n}"]), rnd.choice([None, None, f"r{n}"])) for n in nodes for s in ("kw", "temp", None) if rnd.random() < 0.3]
    got, problems = run(spark, notes, parents)
    want, bad = walk(notes, parents)
    assert got == want and len(got) > 250
    assert problems == sorted(((n, k, "E407") for n, k in bad.items()), key=str) and bad["self"] == "circle" and bad["d1"] == "below_circle"


def test_raises_on_circles(spark):
    notes = spark.createDataFrame([("a", "kw", "x", None)], SCHEMA)
    with pytest.raises(CircularInheritanceError, match="E407: 2 nodes"):
        inherit_chains(notes, spark.createDataFrame([("a", "b"), ("b", "a")], "node string, parent string"))


def test_unknown_and_several_parents_nulls_and_nodes_without_parents(spark):
    parents = [("a", "gone"), ("b", "a"), ("b", "z"), ("b", "a"), ("f", None), (None, "a"), ("z", None)]
    notes = [("gone", "kw", "W", None), ("a", "temp", None, "p"), ("x", "kw", "V", "q"), (None, "kw", "N", None)]
    got, problems = run(spark, notes, parents)
    assert got == sorted([*walk([n for n in notes if n[0]], parents)[0], (None, "kw", "N", None)], key=str)
    assert ("b", "kw", "W", None) in got and ("x", "kw", "V", "q") in got
    assert problems == [("a", "unknown_parent", None), ("b", "several_parents", None)]


def test_empty_tables(spark):
    assert run(spark, [], []) == ([], [])
    assert run(spark, [("a", "kw", None, None)], []) == ([("a", "kw", None, None)], [])
    assert inheritance_problems(spark.createDataFrame([("a", None)], "node string, parent string")).count() == 0


def test_rounds_go_with_the_logarithm_of_the_depth(spark, monkeypatch):
    from plantspark.operators import inheritance

    calls, stored = [], inheritance.stored
    monkeypatch.setattr(inheritance, "stored", lambda df, name: calls.append(name) or stored(df, name))
    run(spark, [("n0", "kw", "W", None)], [(f"n{i}", f"n{i - 1}" if i else None) for i in range(65)])
    assert calls.count("annotations") <= 8


def test_no_table_of_nodes_is_broadcast(spark, monkeypatch):
    """Whatever their size: broadcast nodes go through the driver, round by round."""
    from plantspark.operators import inheritance

    plans, stored = [], inheritance.stored
    monkeypatch.setattr(inheritance, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stored(df, name))
    parents = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(9)] + [("c", "c")]
    assert len(run(spark, [("n0", "kw", "W", None)], parents)[0]) == 9
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "BroadcastExchange" in p]
