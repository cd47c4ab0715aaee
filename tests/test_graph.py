"""Components and levels against plain searches, on graphs with cycles, and what a limit of rounds does."""

import random

import pytest

from lodestone.operators import graph as G


def graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)})


def plain_components(edges):
    top = {n: n for e in edges for n in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {n: find(n) for n in top}


def plain_levels(edges):
    nodes = {n for e in edges for n in e}
    level, left = {}, set(edges)
    k = 0
    while free := {n for n in nodes if n not in level and not any(d == n for _, d in left)}:
        level.update(dict.fromkeys(free, k))
        left = {(a, b) for a, b in left if a not in free}
        k += 1
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("seed, nodes, edges", [(1, 60, 30), (2, 40, 60), (3, 12, 40)])
def test_components_and_levels(spark, seed, nodes, edges):
    e = graph(seed, nodes, edges)
    df = spark.createDataFrame(e, "src long, dst long")
    assert {r.node: r.component for r in G.components(df).collect()} == plain_components(e)
    assert {r.node: r.level for r in G.topological_levels(df).collect()} == plain_levels(e)


def test_a_long_chain_and_limits(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert {r.node: r.distance for r in G.reach(df, spark.sql("SELECT 0L AS node")).collect()} == {i: i for i in range(13)}
    assert G.reach(df, spark.sql("SELECT 0L AS node"), depth=3).count() == 4
    with pytest.raises(ValueError, match="after 3 rounds"):
        G.topological_levels(df, rounds=3)
