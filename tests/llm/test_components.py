from __future__ import annotations

import random

from hostvane.llm.components import components, with_component


def found(spark, edges):
    return dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))


def test_chain_star_loops_and_nulls(spark):
    chain = [(i, i + 1) for i in range(12)]
    star = [(100, 200 + i) for i in range(50)]
    odd = [(500, 500), (None, 3), (3, None), (None, None), (7, 6), (6, 7), (7, 6)]
    got = found(spark, chain + star + odd)
    want = {i: 0 for i in range(13)} | {100: 100} | {200 + i: 100 for i in range(50)}
    assert got == want


def test_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found(spark, edges) == label


def test_no_edges(spark):
    assert found(spark, []) == {}
    nodes = spark.createDataFrame([("a",), (None,)], "node string")
    edges = spark.createDataFrame([], "a string, b string")
    assert sorted(map(tuple, with_component(nodes, edges, "node").collect()), key=str) == [("a", "a"), (None, None)]
