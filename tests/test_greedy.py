"""Greedy selection over chains of candidates that wait for each other, and components."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators import greedy
from ledgerloom.operators.components import components


def walk(rows):
    used, out = set(), set()
    for _, key, members in sorted(rows):
        if used.isdisjoint(members):
            used |= set(members)
            out.add(key)
    return out


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(400)]
    root = {}
    for x, y in edges:
        root.setdefault(x, x), root.setdefault(y, y)
    for _ in range(500):
        for x, y in edges:
            root[x] = root[y] = min(root[x], root[y])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "x int, y int")).collect()} == root


def counted(monkeypatch):
    calls = []
    real = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df: calls.append(1) or real(df))
    return calls


def test_pairs_of_a_long_chain(spark, monkeypatch):
    """10,000 pairs each of which waits for the one before it."""
    n, calls = 10_000, counted(monkeypatch)
    edges = [(f"g{i}", f"s{i}", 2 * i) for i in range(n)] + [(f"g{i + 1}", f"s{i}", 2 * i + 1) for i in range(n)]
    got = greedy.greedy_pairs(spark.createDataFrame(edges, "a string, b string, k int"), ["k"])
    assert {tuple(x) for x in got.collect()} == {(f"g{i}", f"s{i}") for i in range(n)} and len(calls) < 20


@pytest.mark.parametrize("bound", [10**6, 30])
def test_groups_of_chains(spark, bound):
    """Components on both sides of the bound."""
    r = random.Random(8)
    rows = [(i, f"c{i}", [f"m{i}", f"m{i + 1}"]) for i in range(36)] + [(r.randint(0, 200), f"x{i}", [f"n{i}", f"n{i + 1}", f"n{i + 2}"]) for i in range(25)] + [(200 - i, f"y{i}", [f"o{i // 4}", f"o{i // 4 + 1}"]) for i in range(25)]
    df = spark.createDataFrame([(k, m, i) for i, k, m in rows], "key string, members array<string>, k int")
    assert {x.key for x in greedy.greedy_groups(df, ["k"], bound=bound).collect()} == walk(rows)
    assert greedy.greedy_groups(df.limit(0), ["k"]).count() == 0


def test_pairs_with_small_components_only_in_rounds(spark):
    r = random.Random(2)
    edges = sorted({(f"g{r.randint(0, 30)}", f"s{r.randint(0, 30)}") for _ in range(120)})
    rows = [(k, e, [f"a{e[0]}", f"b{e[1]}"]) for k, e in enumerate(r.sample(edges, len(edges)))]
    df = spark.createDataFrame([(*e, k) for k, e, _ in rows], "a string, b string, k int")
    for bound in (10**6, 2):
        assert {tuple(x) for x in greedy.greedy_pairs(df, ["k"], bound=bound).collect()} == walk(rows)


def test_unused_rows_without_a_table_of_the_ids(spark):
    """Repeated ids take a row once, and no aggregation holds the distinct ones in a task's memory."""
    from ledgerloom.operators.greedy import unused

    pool = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    matches = spark.createDataFrame([(["a", "b"],), (["b", "b"],), ([],), (None,)], "ids array<string>")
    left = unused(pool, "id", matches, "ids")
    assert sorted(left.collect(), key=str) == sorted([("c",), (None,)], key=str)
    assert "Aggregate" not in left._jdf.queryExecution().executedPlan().toString()
